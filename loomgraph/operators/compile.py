"""From loaded rows to canonical tables: ordered merge, keep-first, additivity guard, null checks, lean projection.

Rows carry an ordinal (by default the columns file_ord and pos) from the first scan on, since physical order means nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas
from ..functions import text as T

ORDER = ("file_ord", "pos")


def ordinal(order=ORDER) -> Column:
    return F.struct(*[F.col(c) for c in order])


def merge_entities(rows: DataFrame, order=ORDER, key: str = "entity_id") -> DataFrame:
    """One row for each entity: the first, and if there are several, the ordered union of aliases, the highest confidence
    (null counts as 0; the first row's stays if none is higher) and the first non-empty description."""
    o = ordinal(order)
    every = F.struct(*[F.col(c) for c in rows.columns])
    has_text = F.col("description").isNotNull() & (F.col("description") != "")
    lists = F.array_sort(F.collect_list(F.struct(o.alias("o"), T.truthy_list("aliases").alias("a"))))
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(every, o).alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.array_distinct(F.flatten(F.transform(lists, lambda x: x["a"]))).alias("all_aliases"),
        F.max("confidence").alias("best"),
        F.min_by(F.when(has_text, F.col("description")), F.when(has_text, o)).alias("text"),
    )
    many = F.col("n") > 1
    own = F.col("first.confidence")
    replaced = {
        "aliases": F.when(many, F.col("all_aliases")).otherwise(F.col("first.aliases")),
        "confidence": F.when(many & (F.coalesce("best", F.lit(0.0)) > F.coalesce(own, F.lit(0.0))), F.col("best")).otherwise(own),
        "description": F.when(many & ~F.coalesce(F.col("first.description") != "", F.lit(False)), F.col("text")).otherwise(F.col("first.description")),
    }
    return merged.select(*[replaced[c].alias(c) if c in replaced else F.col(f"first.{c}").alias(c) for c in rows.columns])


def keep_first(rows: DataFrame, key: str, order=ORDER) -> DataFrame:
    """The first row of each key; rows without a key all stay.

    A minimum of (ordinal, row) has partial sums, so copies of a key are dropped before the shuffle; no group is sorted.
    """
    every = F.struct(*[F.col(c) for c in rows.columns])
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(every, ordinal(order)).alias("r")).select("r.*")
    return first.unionByName(rows.where(F.col(key).isNull()))


def collapse_counts(rows: DataFrame, key: str) -> DataFrame:
    """(rows, kept, removed)."""
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), (F.count_distinct(key) + F.sum(F.col(key).isNull().cast("long"))).alias("kept"))
    return counted.select("rows", "kept", (F.col("rows") - F.col("kept")).alias("removed"))


def lost_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Ids of the input that the output lacks; must be empty."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def null_violations(rows: DataFrame, name: str, order=ORDER) -> DataFrame:
    """(column, first): the columns that must not be null but are somewhere, with the first ordinal."""
    must = [c for c in schemas.required(name) if c in rows.columns]
    bad = rows.select(ordinal(order).alias("o"), F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in must]))).alias("column"))
    return bad.groupBy("column").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n"))


def lean(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that are there, in the wanted order."""
    return df.select([c for c in columns if c in df.columns])


#: The element columns that the lakehouse copy keeps; chunks have no copy there.
LEAN_ELEMENTS = ["document_element_id", "source_file_id", "element_type", "parent_element_id", "title", "blob_url", "page_number", "section_path", "sort_order", "row_index", "col_index", "content_hash"]


def coerce_timestamps(df: DataFrame, name: str) -> DataFrame:
    """Text in timestamp columns becomes timestamps in UTC; what cannot be read is null."""
    kinds = {f.name: f.dataType.typeName() for f in schemas.schema(name)}
    return df.withColumns({c: T.parse_timestamp(c) for c in df.columns if kinds.get(c) == "timestamp" and df.schema[c].dataType.typeName() == "string"})


def compile_tables(loaded: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The canonical tables from loaded rows: entities merged, others kept first, columns conformed."""
    out = {}
    for name, key in schemas.KEYS.items():
        if name not in loaded:
            continue
        rows = coerce_timestamps(loaded[name], name)
        done = merge_entities(rows) if name == "entities" else keep_first(rows, key)
        out[name] = schemas.conform(done.drop(*ORDER), name, strict=False)
    return out


class CompileError(Exception):
    """The output lacks ids of the input, or a gate failed."""


def guarded_compile(loaded: dict[str, DataFrame], gates=None) -> dict[str, DataFrame]:
    """compile_tables, with the additivity guard and, if given, gates(tables) -> violations; raises CompileError."""
    out = compile_tables(loaded)
    for name in ("entities", "relationships"):
        if name in out and (gone := lost_ids(loaded[name], out[name], schemas.KEYS[name]).take(5)):
            raise CompileError(f"{name}: ids lost: {[r[0] for r in gone]}")
    if gates is not None and (bad := gates(out).where("severity = 'fail'").take(5)):
        raise CompileError(f"gates failed: {bad}")
    return out


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Keyed upsert of rows: the last of each key."""
    w = Window.partitionBy(*key).orderBy(order.desc())
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
