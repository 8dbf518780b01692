"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `WINDOW` words of the benchmark items (an item of fewer words is one pattern). Symbols are
words, blocks are pairs of words: a shift table says how far the search may jump from a block, a block that can end a
pattern selects the bucket of patterns with that suffix, the first word is compared as a prefix, then the whole pattern
directly. Patterns of one length share a searcher.

The benchmark is taken in blocks of about `BLOCK_WORDS` words, so what an executor holds is bounded; documents pass
through one search for each block, with no join and no shuffle.

Null or empty texts have no words and no hits. Null item texts have no window; a null item_id is reported as the empty
string. Repeated items count once by item_id; repeated documents are searched each. Ties cannot arise: every occurrence counts.
Very long texts need memory for their own words. An empty table on either side gives no hits. Extra columns pass; columns named
like an output raise an error.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import binary_texts, bound_batches, check_free, extended, table

WINDOW = 13
BLOCK_WORDS = 2_000_000
#: Fixed: bytes that are no part of a word become spaces, A-Z become a-z (bytes from 0x80 on belong to words).
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Searches sequences for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, tuple]):
        self.length = length
        self.shift: dict = {}
        self.last: set = set()
        self.buckets: dict = {}
        if length == 1:
            self.single = {p[0]: ids for p, ids in patterns.items()}
            return
        for p, ids in patterns.items():
            self.last.update(p)
            for j in range(1, length):
                block, jump = (p[j - 1], p[j]), length - 1 - j
                self.shift[block] = min(self.shift.get(block, jump), jump)
            self.buckets.setdefault((p[-2], p[-1]), []).append((p[0], p, ids))

    def find(self, words: list):
        """Yields (start, ids) of every occurrence."""
        n, length = len(words), self.length
        if length == 1:
            for i, w in enumerate(words):
                if w in self.single:
                    yield i, self.single[w]
            return
        at, known, shift = length - 1, self.last, self.shift
        while at < n:
            if words[at] not in known:
                at += length
                continue
            jump = shift.get((words[at - 1], words[at]))
            if jump is None:
                at += length - 1
            elif jump:
                at += jump
            else:
                start = at - length + 1
                for first, p, ids in self.buckets.get((words[at - 1], words[at]), ()):
                    if words[start] == first and tuple(words[start : at + 1]) == p:
                        yield start, ids
                at += 1


def searchers(items: list[tuple]) -> list[WuManber]:
    """One searcher for each pattern length of (item_id, text) rows."""
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        w = words_of((text or "").encode("utf-8", "surrogatepass"))
        size = min(WINDOW, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    return [WuManber(n, {p: tuple(sorted(ids)) for p, ids in ps.items()}) for n, ps in sorted(by_length.items())]


def search_block(docs: DataFrame, find: list[WuManber], hits: str, items: str, size: str, first: bool) -> DataFrame:
    schema = extended(docs, **{size: "long", hits: "array<int>", items: "array<string>"}) if first else docs.schema
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(find)  # BLOCK_WORDS words at most, or one item

    def run(batches):
        find = shared.value
        for batch in batches:
            n_out, hits_out, items_out = [], [], []
            before = [([], [])] * batch.num_rows if first else zip(batch.column(hits).to_pylist(), batch.column(items).to_pylist())
            for text, (old_hits, old_items) in zip(binary_texts(batch.column(at)), before):
                words = words_of(text)
                marked, ids = set(old_hits), set(old_items)
                for f in find:
                    for start, got in f.find(words):
                        marked.update(range(start, start + f.length))
                        ids.update(got)
                n_out.append(len(words))
                hits_out.append(sorted(marked))
                items_out.append(sorted(ids))
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name not in (size, hits, items)]
            names = [name for name in batch.schema.names if name not in (size, hits, items)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_out, pa.int64()), pa.array(hits_out, pa.list_(pa.int32())), pa.array(items_out, pa.list_(pa.string()))], [*names, size, hits, items])

    return docs.mapInArrow(run, schema)


def mark(docs: DataFrame, benchmark: DataFrame, size: str = "n_words", hits: str = "hit_words", items: str = "hit_items", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds to docs the number of words, the places of hit words and the ids of items that occur."""
    check_free(docs, size, hits, items)
    bound_batches(docs.sparkSession)
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    words = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-words // (5 * block_words)))
    out = docs
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        out = search_block(out, searchers([(r["item_id"], r["text"]) for r in part]), hits, items, size, b == 0)
    return out


def contaminated(size: str = "n_words", hits: str = "hit_words"):
    return (F.size(hits) > 0) & (F.lit(20) * F.size(hits) >= F.col(size))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns."""
    return mark(docs, benchmark).where(~contaminated()).select(docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
        FROM bw, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM pat),
occ AS (SELECT d.doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM dw d, sizes, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m),
hit AS (SELECT doc_id, i, m, item_id FROM occ JOIN pat USING (m, p)),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT DISTINCT doc_id, i, m FROM hit) AS h, unnest(range(i, i + m)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
