"""Document fingerprints: 64-bit SimHash, and search within a Hamming radius by permuted block tables.

Terms are pairs of neighbouring words (A-Z lower-cased, split at white space; a text of one word is one term), weighted by
1 + ln(count), as whole 1024ths, so that sums are exact whatever their order. Each term's hash votes its weight up or down on
every bit; a bit is set if its sum is positive. A text
without words has the fingerprint 0.

Search: the bits are cut into `BLOCKS` blocks; any two fingerprints that differ in at most `RADIUS` bits agree in at least
BLOCKS - RADIUS blocks, so a table for each choice of that many blocks, keyed by their bits, finds all of them. Keys have
about 32 bits, so a bucket stays small as the corpus grows. Equal fingerprints are one entry with a count.

Texts meet their successors by one range shuffle: a task sees documents in order and holds the one before; the first and
last document of each task are paired in a second, small step.

Null texts count as empty. Null doc_ids come first; rows with one doc_id are taken in order of their text. A single
document is its own successor. Bits whose votes tie are not set. Repeated rows are answered each; an empty table gives an empty
table; only doc_id and text are read, so extra columns cannot clash. A very long text needs memory for its own terms. There are
at most `MAX_TASKS` tasks in the ordered pass (each streams its documents), and a number of each is brought to the driver.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, bound_batches, check_free, mix64, table

BITS, BLOCKS, RADIUS = 64, 6, 3
#: Documents a task of the ordered pass is meant to see, and the most tasks.
TASK_DOCS, MAX_TASKS = 2_000, 50_000
#: Weights are in parts of one.
PARTS = 1024
QUERY_EVERY = 50
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Fingerprinter:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> int:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return 0
        if len(self.known) > 400_000:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        terms = mix64(mix64(h[:-1]) ^ h[1:]) if len(h) > 1 else mix64(h)
        terms, counts = np.unique(terms, return_counts=True)
        bits = np.unpackbits(terms.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        weights = np.rint(PARTS * (1 + np.log(counts)))  # whole numbers as float64: exact sums
        votes = weights @ bits
        return int.from_bytes(np.packbits(2 * votes > weights.sum(), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edit(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FIELDS = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fp": pa.int64(), "edited_fp": pa.int64(), "next_fp": pa.int64(), "part": pa.int64(), "edge": pa.string(), "edge_text": pa.string()}
DDL = "n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long, part long, edge string, edge_text string"


def pair_row(prints: Fingerprinter, text: str, own: int, following: str, other: int) -> tuple:
    edited = edit(text, following)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (len(text), sha, signed(own), signed(own if edited == text else prints(edited)), signed(other))


def rows_batch(ids: list, id_type, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(ids, id_type)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(FIELDS.values())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", *FIELDS])


def ordered_pass(docs: DataFrame, tasks: int) -> DataFrame:
    """A row for each document but the last of each task; the first and last of a task also as edges with their texts."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        prints, before = Fingerprinter(), None
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                own = prints(text)
                if before is None:
                    ids.append(doc)
                    rows.append((len(text), None, signed(own), None, None, part, "first", text))
                else:
                    ids.append(before[0])
                    rows.append((*pair_row(prints, before[1], before[2], text, own), part, None, None))
                before = (doc, text, own)
            yield rows_batch(ids, batch.column(0).type, rows)
        if before is not None:
            yield rows_batch([before[0]], batch.column(0).type, [(len(before[1]), None, signed(before[2]), None, None, part, "last", before[1])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, f"doc_id {kind}, {DDL}")


def edges_pass(edges: DataFrame) -> DataFrame:
    """Rows of the tasks' last documents, each paired with the first of the next task that has any (after the last: the first)."""
    parts = sorted(r[0] for r in edges.select("part").distinct().collect())  # a number for each task, MAX_TASKS at most
    if not parts:
        return edges
    spark = edges.sparkSession
    follow = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part long, next long")
    first = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("edge_text").alias("next_text"), F.col("fp").alias("next_first"))
    last = edges.where("edge = 'last'").select("doc_id", "part", "edge_text", "fp")
    pairs = last.join(follow, "part").join(first, "next").select("doc_id", "part", "edge_text", "fp", "next_text", "next_first")

    def run(batches):
        prints = Fingerprinter()
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            mask = (1 << 64) - 1
            rows = [(*pair_row(prints, text, fp & mask, following, other & mask), part, None, None) for _, part, text, fp, following, other in zip(*c)]
            yield rows_batch(c[0], batch.column(0).type, rows)

    kind = edges.schema["doc_id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"doc_id {kind}, {DDL}")


def block_tables(bits: int = BITS, blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of the block choices, as signed 64-bit numbers."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [signed(sum(masks[i] for i in choice)) for choice in combinations(range(blocks), blocks - radius)]


def within(queries: DataFrame, entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q, fp): every entry within the radius of each query fingerprint. queries (q), entries (fp): distinct longs."""
    masks = F.array(*[F.lit(m) for m in block_tables(radius=radius)])
    keyed = lambda df, c: df.select(c, F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col(c)))).alias("t", "v")).select(c, F.xxhash64("t", "v").alias("key"))
    near = keyed(entries, "fp").join(keyed(queries, "q"), "key")
    return near.where(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius).select("q", "fp").distinct()


def fingerprints(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp for each row of docs."""
    bound_batches(docs.sparkSession)
    tasks = min(MAX_TASKS, max(1, -(-docs.count() // TASK_DOCS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = scratch.save(ordered_pass(docs, tasks))
    inner = rows.where("edge is null")
    return inner.unionByName(edges_pass(rows.where("edge is not null"))).where("edge is null").drop("part", "edge", "edge_text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    rows = scratch.save(fingerprints(table(spark, sf_dir, "documents"), scratch))
    entries = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    queries = rows.where(F.pmod("doc_id", F.lit(QUERY_EVERY)) == 0).select(F.col("fp").alias("q")).distinct()
    found = within(queries, entries.select("fp")).join(entries, "fp").groupBy("q").agg(F.sum("copies").alias("n_within"))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    alike = lambda c: (1 - F.bit_count(F.col("fp").bitwiseXOR(F.col(c))) / F.lit(float(BITS))).cast("double")
    out = rows.join(found, (F.col("q") == F.col("fp")) & (F.pmod("doc_id", F.lit(QUERY_EVERY)) == 0), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), alike("edited_fp").alias("near_edited"), alike("next_fp").alias("near_next"), (F.col("n_within") - 1).alias("n_within"))
