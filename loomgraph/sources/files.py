"""File sources: tabular files, HTML, DOCX, XLSX and PDF as document elements; stored JSON documents; configuration.

Files are read as bytes on the executors and parsed there, one file a call; what a parser gives are rows, so nothing is
gathered on the driver. Parsers use the standard library; PDF needs pdfplumber and says so if it is missing.
"""

from __future__ import annotations

import csv
import html
import io
import json
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..functions import ids, text as T
from ..session import prepare

ELEMENT = "pos int, key int, parent int, element_type string, title string, content string, content_html string, section_path string, page_number int, sort_order int, row_index int"
NAMES = [c.split()[0] for c in ELEMENT.split(", ")]
KINDS = {".csv": "csv", ".tsv": "tsv", ".xlsx": "xlsx", ".pdf": "pdf", ".docx": "docx", ".html": "html", ".htm": "html", ".md": "markdown"}


def route(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    if ext not in KINDS:
        raise ValueError(f"unsupported file type: {path}")
    return KINDS[ext]


class Elements:
    """Collects rows; headings form a stack that gives section paths and parents."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.stack: list[tuple[int, str]] = []

    def add(self, kind: str, title=None, content=None, markup=None, parent=None, page=None, row_index=None, sort=None, top: bool = False) -> int:
        """Adds a row; its parent is the one given, else (unless it is a top one) the last heading."""
        key = len(self.rows)
        up = parent if parent is not None or top else (self.stack[-1][0] if self.stack else None)
        path = "/".join(t for _, t in self.stack) or None
        self.rows.append((key, key, up, kind, title, content, markup, path, page, key if sort is None else sort, row_index))
        return key

    def heading(self, level: int, title: str, page=None) -> int:
        del self.stack[max(level - 1, 0) :]
        up = self.stack[-1][0] if self.stack else None
        key = len(self.rows)
        self.stack.append((key, title))
        return self.add("section", title=title, content=title, parent=up, page=page, top=True)


#: Fixed: tags whose start ends an open paragraph, tags without an end, and table parts that end others.
ENDS_PARAGRAPH = frozenset("p div h1 h2 h3 h4 h5 h6 table ul ol dl pre form hr article section header footer nav aside main blockquote address fieldset center".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_CELL = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}


class HtmlReader(HTMLParser):
    """Nodes (headings, paragraphs, tables, images) in order of their start tags, each with the strings in it.

    A node's text is its strings, trimmed, joined by spaces. Headings and paragraphs within a table are part of it; nested tables
    and images are nodes of their own too.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []  # nodes that take strings
        self.tags: list[tuple[str, dict | None]] = []  # open tags, with their node
        self.tables: list[dict] = []
        self.skip = 0

    def mark(self, text: str) -> None:
        for t in self.tables:
            t["markup"].append(text)

    def shut(self, at: int) -> None:
        """Ends the open tags from place at on."""
        while len(self.tags) > at:
            tag, node = self.tags.pop()
            self.mark(f"</{tag}>")
            if node is not None:
                self.open.remove(node)
                if node["tag"] == "table":
                    self.tables.remove(node)

    def end_open(self, names, stop) -> None:
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i][0] in names:
                self.shut(i)
                return
            if self.tags[i][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self.end_open(("p", "h1", "h2", "h3", "h4") if tag[0] == "h" and tag[1:].isdigit() else ("p",), ("table", "td", "th"))
        for _ in ENDS_CELL.get(tag, ()):
            self.end_open(ENDS_CELL[tag], ("table",))
        node = None
        if tag == "table" or tag in ("h1", "h2", "h3", "h4", "p") and not self.tables:
            node = {"tag": tag, "text": [], "markup": []}
        elif tag == "img":
            a = dict(attrs)
            self.nodes.append({"tag": tag, "text": [x.strip() for x in (a.get("src") or "", a.get("alt") or "")]})
        if node is not None:
            self.nodes.append(node)
            self.open.append(node)
            if tag == "table":
                self.tables.append(node)
        named = "".join(f' {k}="{html.escape(v or "", quote=False).replace(chr(34), "&quot;")}"' for k, v in attrs)
        self.mark(f"<{tag}{named}/>" if tag in EMPTY_TAGS else f"<{tag}{named}>")
        if tag not in EMPTY_TAGS:
            self.tags.append((tag, node))
            self.skip += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i][0] == tag:
                self.skip = max(0, self.skip - (tag in ("script", "style", "template")))
                return self.shut(i)
            if self.tags[i][0] == "table":
                return None

    def handle_data(self, data):
        if self.skip:
            return
        self.mark(html.escape(data, quote=False))
        for node in self.open:
            node["text"].append(data.strip())


def parse_html(raw: bytes, name: str = "") -> list[tuple]:
    reader = HtmlReader()
    reader.feed(raw.decode("utf-8", "ignore"))
    reader.close()
    reader.shut(0)
    out = Elements()
    for node in reader.nodes:
        text = " ".join(x for x in node["text"] if x).strip()
        if node["tag"] == "table":
            out.add("table", content=text, markup="".join(node["markup"]))
        elif not text:
            continue
        elif node["tag"] == "img":
            out.add("image_ref", content=text)
        elif node["tag"] == "p":
            out.add("paragraph", content=text)
        else:
            out.heading(int(node["tag"][1]), text)
    return out.rows


def sniff(sample: str) -> str:
    """The delimiter among comma, tab, bar and semicolon; a comma if none is clear."""
    try:
        return csv.Sniffer().sniff(sample, ",\t|;").delimiter
    except csv.Error:
        return ","


def table_rows(raw: bytes, name: str) -> list[list[str]]:
    text = raw.decode("utf-8-sig", "replace").lstrip("﻿")
    delimiter = "\t" if name.lower().endswith(".tsv") else sniff(text[:4096])
    return [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if any(c.strip() for c in r)]


def table_elements(rows: list[list[str]], out: Elements) -> None:
    if not rows:
        raise ValueError("the table has no header")
    header = [h.strip() for h in rows[0]]
    top = out.add("table", content=", ".join(header), markup="<table><thead><tr>" + "".join(f"<th>{h}</th>" for h in header) + "</tr></thead></table>", sort=0)
    for i, r in enumerate(rows[1:], 1):
        out.add("table_row", content="; ".join(f"{h}={v.strip()}" for h, v in zip(header, r)), parent=top, row_index=i - 1, sort=i)


def parse_tabular(raw: bytes, name: str = "") -> list[tuple]:
    out = Elements()
    table_elements(table_rows(raw, name), out)
    return out.rows


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sheet_rows(raw: bytes) -> list[list[list[str]]]:
    """The rows of every sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = []
        for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            rows = []
            for r in ElementTree.fromstring(z.read(n)).iter(f"{SHEET}row"):
                cells: dict[int, str] = {}
                for c in r.iter(f"{SHEET}c"):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    v = c.find(f"{SHEET}v")
                    value = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
                row = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                if any(x.strip() for x in row):
                    rows.append(row)
            sheets.append(rows)
    return sheets


def parse_xlsx(raw: bytes, name: str = "") -> list[tuple]:
    out = Elements()
    for rows in sheet_rows(raw):
        if rows:
            table_elements(rows, out)
    return out.rows


def parse_docx(raw: bytes, name: str = "") -> list[tuple]:
    out = Elements()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t")).strip()
    for block in body if body is not None else []:
        if block.tag == f"{WORD}p":
            text = words(block)
            style = block.find(f"{WORD}pPr/{WORD}pStyle")
            level = re.fullmatch(r"Heading ?([1-3])", style.get(f"{WORD}val") or "") if style is not None else None
            if text and level:
                out.heading(int(level[1]), text)
            elif text:
                out.add("paragraph", content=text)
        elif block.tag == f"{WORD}tbl":
            rows = [[words(c) for c in r.iter(f"{WORD}tc")] for r in block.iter(f"{WORD}tr")]
            marked = ["<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in rows]
            top = out.add("table", title=os.path.splitext(os.path.basename(name))[0] or None, content=" | ".join(" ".join(c for c in r if c) for r in rows).strip(), markup="<table>" + "".join(marked) + "</table>")
            for i, r in enumerate(rows):
                if any(r):
                    out.add("table_row", content=" | ".join(c for c in r if c), markup=marked[i], parent=top, row_index=i)
    return out.rows


NUMBERED = re.compile(r"^\d+(?:\.\d+)*\.?\s+[A-Z]")


def lines_of_words(words: list[dict], tolerance: float = 3.0) -> list[list[dict]]:
    """Words of a page as lines: a word joins the line while its top is near the running mean of tops."""
    lines: list[list[dict]] = []
    top = None
    for w in sorted(words, key=lambda w: (w["top"], w["x0"])):
        if top is None or abs(w["top"] - top) > tolerance:
            lines.append([])
            top = w["top"]
        else:
            top = (top + w["top"]) / 2
        lines[-1].append(w)
    return lines


def is_heading(text: str, size: float, median: float) -> bool:
    loud = text.isupper() and len(text) < 100
    return bool(text) and (size >= 1.2 * median or bool(NUMBERED.match(text)) or loud or text.endswith(":") and len(text) < 120)


def heading_level(text: str, size: float, median: float) -> int:
    if NUMBERED.match(text):
        return min(text.split()[0].rstrip(".").count(".") + 1, 4)
    if text.isupper():
        return 1
    ratio = size / median if median else 1
    return 1 if ratio >= 1.6 else 2 if ratio >= 1.35 or text.endswith(":") else 3


def page_elements(out: Elements, page: int, text: str, words: list[dict]) -> None:
    """A page element, then headings and paragraphs; a paragraph ends at a gap of over 1.8 times the median, or a heading."""
    from statistics import median

    out.add("page", content=text, page=page)
    lines = [(" ".join(w["text"] for w in sorted(ws, key=lambda w: w["x0"])).strip(), sum(w.get("size", 0) for w in ws) / len(ws), min(w["top"] for w in ws)) for ws in lines_of_words(words)]
    if not lines:
        return
    middle = median(s for _, s, _ in lines) or 1
    gaps = [b[2] - a[2] for a, b in zip(lines, lines[1:]) if b[2] > a[2]]
    wide = 1.8 * median(gaps) if gaps else float("inf")
    held: list[str] = []

    def flush():
        if held:
            out.add("paragraph", content="\n".join(held), page=page)
            held.clear()

    before = None
    for line, size, top in lines:
        if is_heading(line, size, middle):
            flush()
            out.heading(heading_level(line, size, middle), line, page)
        else:
            if before is not None and top - before > wide:
                flush()
            held.append(line)
        before = top
    flush()


def parse_pdf(raw: bytes, name: str = "") -> list[tuple]:
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pdfplumber, which is not installed") from e
    out = Elements()
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            page_elements(out, n, page.extract_text() or "", page.extract_words(extra_attrs=["size"]))
    return out.rows


PARSERS: dict[str, Callable[[bytes, str], list[tuple]]] = {"csv": parse_tabular, "tsv": parse_tabular, "xlsx": parse_xlsx, "docx": parse_docx, "html": parse_html, "markdown": parse_html, "pdf": parse_pdf}


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The supported files of one folder (or one file)."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).where(F.lower("path").rlike("\\.(csv|tsv|xlsx|pdf|docx|html?|md)$"))


def elements(files: DataFrame, path: str = "path", content: str = "content", kind: str | None = None) -> DataFrame:
    """(path, pos, ...): parsed elements of files (path, content). A kind given holds for all files."""
    prepare(files.sparkSession)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = [(p, *r) for p, c in zip(f["path"], f["content"]) for r in PARSERS[kind or route(p)](bytes(c or b""), p)]
            yield pd.DataFrame(rows, columns=["path", *NAMES]).astype({c: "Int32" for c in ("pos", "key", "parent", "page_number", "sort_order", "row_index")})

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).mapInPandas(run, f"path string, {ELEMENT}")


def source_rows(files: DataFrame, root: str = "", at=None) -> DataFrame:
    """source_files rows of binary files."""
    rel = F.regexp_replace("path", f"^(file:)?/*{re.escape(root.strip('/'))}/*", "") if root else F.col("path")
    hash_ = F.sha2("content", 256)
    return schemas.conform(files.select(ids.source_file_id(rel, hash_).alias("source_file_id"), rel.alias("path"), F.element_at(F.split("path", "/"), -1).alias("filename"), T.route("path").alias("source_type"), hash_.alias("content_hash"), F.length("content").cast("bigint").alias("byte_size"), (at if at is not None else F.current_timestamp()).alias("ingested_at")), "source_files")


def element_rows(parsed: DataFrame, sources: DataFrame, at=None) -> DataFrame:
    """document_elements rows; parent ids come from the same file's element of that key."""
    src = sources.select(F.col("path").alias("_path"), "source_file_id")
    hash_ = ids.content_hash(F.coalesce("content", "title"))
    rows = parsed.join(src, parsed["path"] == F.col("_path"))
    rows = rows.withColumn("document_element_id", ids.element_id("source_file_id", "element_type", "page_number", "sort_order", hash_)).withColumn("content_hash", hash_)
    up = rows.select(F.col("source_file_id").alias("_s"), F.col("key").alias("_k"), F.col("document_element_id").alias("parent_element_id"))
    rows = rows.join(up, (F.col("source_file_id") == F.col("_s")) & (F.col("parent") == F.col("_k")), "left").withColumn("extracted_at", at if at is not None else F.current_timestamp())
    return schemas.conform(rows.select([c for c in schemas.schema("document_elements").fieldNames() if c in rows.columns]), "document_elements")


def chunk_rows(elements_: DataFrame, at=None) -> DataFrame:
    """Chunks of elements: sections and paragraphs (notes and warnings by how they begin) split, pages, tables and table rows
    whole, as plain text with their markup beside it; other elements give none."""
    own = T.strip(F.coalesce("content", F.lit("")))
    is_table = F.col("element_type").isin("table", "table_row")
    text = F.when((F.col("element_type") == "section") & (own == ""), T.strip(F.coalesce("title", F.lit("")))).when(is_table & (own == ""), T.strip_html("content_html")).otherwise(own)
    kind = (
        F.when(F.col("element_type").isin("section", "paragraph"), F.when(text.startswith("WARNING") | text.startswith("⚠"), "warning").when(text.startswith("NOTE") | text.startswith("Note:"), "note").otherwise("section_text"))
        .when(F.col("element_type") == "page", "raw_page_text").when(F.col("element_type") == "table", "table_html").when(F.col("element_type") == "table_row", "table_row")
    )
    bare = (F.col("element_type") == "table") & (T.strip(F.coalesce("content_html", F.lit(""))) != "")  # a table of markup alone is a chunk too
    pieces = F.when(F.col("element_type").isin("section", "paragraph"), T.split_text(text)).otherwise(F.when((text != "") | bare, F.array(text)).otherwise(F.array().cast("array<string>")))
    rows = elements_.withColumns({"chunk_type": kind, "piece": pieces}).where("chunk_type is not null").select("*", F.posexplode("piece").alias("part", "c"))
    hash_ = ids.content_hash("c")
    out = rows.select(
        ids.chunk_id("source_file_id", "chunk_type", hash_).alias("chunk_id"), "source_file_id", "document_element_id", "chunk_type", F.col("c").alias("content"), F.when(is_table, F.col("content_html")).alias("content_html"),
        F.col("c").alias("embedding_text"), "blob_url", "page_number", "section_path",
        F.when(F.col("element_type") == "table", F.col("document_element_id")).when(F.col("element_type") == "table_row", F.col("parent_element_id")).alias("table_id"), hash_.alias("content_hash"), (at if at is not None else F.current_timestamp()).alias("created_at"),
    )
    return schemas.conform(out, "chunks")


LISTS = ["document_elements", "chunks", "entities", "relationships", "evidence", "visual_assets", "visual_regions"]


def document_schema() -> str:
    item = lambda name: schemas.DECLARED[name].replace("!", "").replace("timestamp", "string")
    struct = lambda name: "struct<" + ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in item(name).split(", ")) + ">"
    return "source_file_id string, source_file " + struct("source_files") + ", " + ", ".join(f"{n} array<{struct(n)}>" for n in LISTS)


def enriched_documents(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Stored documents, one JSON object a file, with the file's rank in sorted order as file_ord."""
    docs = spark.read.schema(document_schema()).option("multiLine", True).option("pathGlobFilter", pattern).json(folder).withColumn("file", F.input_file_name())
    docs = docs.where(~F.col("file").rlike("/(\\.checkpoint|domain)\\.json$"))
    order = docs.select("file").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("file")))  # one short row a file
    return docs.join(order, "file")


def exploded(docs: DataFrame, name: str) -> DataFrame:
    """The rows of one list of stored documents, with file_ord and pos."""
    return docs.select("file_ord", F.posexplode(name).alias("pos", "r")).select("file_ord", "pos", "r.*")


def loaded(docs: DataFrame) -> dict[str, DataFrame]:
    out = {n: exploded(docs, n) for n in LISTS}
    out["source_files"] = docs.where("source_file is not null").select("file_ord", F.lit(0).alias("pos"), "source_file.*")
    return out


def interpolate(value, env: dict[str, str]):
    """${NAME} and ${NAME:-default} in strings, lists and dicts; a missing name without default is an error."""
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[3] is None:
            raise OSError(f"environment variable {m[1]} is not set")
        return m[3]

    return re.sub(r"\$\{(\w+)(:-([^}]*))?\}", put, value)


def load_config(*paths: str, env: dict[str, str] | None = None) -> dict:
    """JSON (or YAML, where available) files merged in order, later ones winning, with variables put in."""

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    out: dict = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            if p.endswith((".yaml", ".yml")):
                import yaml

                body = yaml.safe_load(f) or {}
            else:
                body = json.load(f)
        out = merge(out, body)
    return interpolate(out, dict(os.environ) if env is None else env)
