"""Profiles of tabular sources and inventories of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NUMBER = "^[+-]?(\\d+(_\\d+)*\\.?(\\d+(_\\d+)*)?|\\.\\d+(_\\d+)*)([eE][+-]?\\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def inferred(values: Column) -> Column:
    """integer, float or string for an aggregate over non-blank trimmed values."""
    whole, number = F.bool_and(values.rlike("^-*\\d+$")), F.bool_and(values.rlike(NUMBER))
    return F.when(whole, "integer").when(number, "float").otherwise("string")


def column_profile(df: DataFrame, order: str | None = None, samples: int = 5) -> DataFrame:
    """(index, name, inferred_type, null_count, unique_count, sample_values): a row for each column.

    Counts are one aggregate over unpivoted cells. Samples, the first distinct values by `order`, are given if it is.
    """
    cells = df.select(*([F.col(order).alias("_o")] if order else []), F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(c).cast("string")).alias("v")) for c in df.columns])).alias("index", "c"))
    some = F.when(F.col("c.v") != "", F.col("c.v"))
    out = cells.groupBy("index", F.col("c.name").alias("name")).agg(
        F.coalesce(inferred(some), F.lit("string")).alias("inferred_type"), F.sum(some.isNull().cast("long")).alias("null_count"), F.count_distinct(some).alias("unique_count")
    )
    if not order:
        return out
    first = cells.where("c.v != ''").groupBy("index", "c.v").agg(F.min("_o").alias("o"))
    from pyspark.sql import Window

    top = first.withColumn("r", F.row_number().over(Window.partitionBy("index").orderBy("o", "v"))).where(F.col("r") <= samples)
    lists = top.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("sample_values"))
    return out.join(lists, "index", "left")


def inventory(elements: DataFrame) -> DataFrame:
    """(source_file_id, element_type, n, pages)."""
    return elements.groupBy("source_file_id", "element_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_number").alias("pages"))


def total_inventory(elements: DataFrame) -> DataFrame:
    return elements.agg(F.count_distinct("source_file_id").alias("files"), F.count(F.lit(1)).alias("elements"), F.sum((F.col("element_type") == "page").cast("long")).alias("pages"))


def package_summary(files: DataFrame) -> DataFrame:
    """(files, bytes) of a folder listing (path, length)."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
