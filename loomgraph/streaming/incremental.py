"""Incremental ingestion with Structured Streaming: new rows are those whose content hash is not stored; tables are keyed.

An extension: stream semantics are those of the engine's file source and checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import compile as compile_


def changed_rows(spark: SparkSession, batch: DataFrame, target: str, key: str, hash_: str = "content_hash") -> DataFrame:
    try:
        stored = spark.read.parquet(target).select(key, hash_)
    except Exception:  # noqa: BLE001  the first batch has no target
        return batch
    return batch.join(stored, [key, hash_], "left_anti")


def upsert(target: str, key: str, version: str = "_batch"):
    """A foreachBatch function that appends changed rows with their batch number; `current` reads the latest of each key.

    A batch that runs again after a failure writes to its own folder again, so nothing is doubled.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed_rows(spark, batch.dropDuplicates([key]), f"{target}/*", key).withColumn(version, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return run


def current(spark: SparkSession, target: str, key: str, version: str = "_batch") -> DataFrame:
    return compile_.latest(spark.read.parquet(f"{target}/*"), [key], F.col(version)).drop(version)


def start(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, once: bool = True):
    """Starts the stream from Parquet files; once: what is there now, then stop."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(upsert(target, key)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
