"""Sinks: canonical Parquet tables, placeholders, typed tables, search documents, batches to a client, packages."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators import compile as compile_


class NotNullError(ValueError):
    pass


def write_table(df: DataFrame, name: str, folder: str, files: int | None = None) -> str:
    """One canonical table as Parquet: declared columns only, null marks checked first. files bounds the number of files."""
    rows = schemas.conform(df, name)
    must = schemas.required(name)
    bad = rows.where(" or ".join(f"{c} is null" for c in must)).take(1)
    if bad:
        raise NotNullError(f"{name}: null in {[c for c in must if bad[0][c] is None]}")
    path = f"{folder}/{name}"
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str, files: int | None = None) -> dict[str, str]:
    return {name: write_table(df, name, folder, files) for name, df in tables.items()}


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A canonical table; empty if it was never written, an error if it cannot be read."""
    path = f"{folder}/{name}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return schemas.empty(spark, name)
    return spark.read.schema(schemas.open_schema(name)).parquet(path)


def placeholder(spark: SparkSession, name: str) -> DataFrame:
    """One typed sentinel row."""
    at = datetime.datetime(2000, 1, 1)
    values = {"string": "__placeholder__", "timestamp": at, "int": 0, "bigint": 0, "double": 0.0, "boolean": True, "array<string>": []}
    mark = hashlib.sha256(b"__placeholder__").hexdigest()
    row = tuple(mark if f.name.endswith("_hash") else values[f.dataType.simpleString()] for f in schemas.schema(name))
    return spark.createDataFrame([row], schemas.open_schema(name))


def write_placeholders(spark: SparkSession, folder: str) -> None:
    for name in schemas.DECLARED:
        placeholder(spark, name).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/placeholder")


def write_lakehouse(tables: dict[str, DataFrame], database: str | None = None, kind: str = "parquet", dry_run: bool = False) -> dict[str, str]:
    """Lean copies as catalog tables (chunks have none); the status of each, errors not stopping the others."""
    out = {}
    for name, df in tables.items():
        if name == "chunks":
            out[name] = "skipped"
            continue
        rows = compile_.lean(df, compile_.LEAN_ELEMENTS) if name == "document_elements" else df
        if dry_run:
            out[name] = "planned"
            continue
        try:
            rows.write.format(kind).mode("overwrite").saveAsTable(f"{database}.{name}" if database else name)
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001  a table's failure is its status
            out[name] = f"error: {e}"
    return out


def write_search_docs(docs: DataFrame, schema: dict, folder: str) -> None:
    """An index declaration and the documents as JSON lines."""
    docs.write.mode("overwrite").json(f"{folder}/{schema['name']}/docs")
    docs.sparkSession.createDataFrame([(json.dumps(schema, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{schema['name']}/index")


def push_batches(docs: DataFrame, send: Callable[[list[dict]], list[bool]], size: int = 1000) -> DataFrame:
    """(sent, failed) of each partition: rows go to send() in batches; send says for each row whether it was taken.

    Retries of a lost task send again, so a client must upsert by key.
    """

    def run(frames):
        import pandas as pd

        sent = failed = 0
        for f in frames:
            rows = f.to_dict("records")
            for i in range(0, len(rows), size):
                ok = send(rows[i : i + size])
                sent, failed = sent + sum(ok), failed + len(ok) - sum(ok)
        yield pd.DataFrame({"sent": [sent], "failed": [failed]})

    return docs.mapInPandas(run, "sent long, failed long")


def write_new_blobs(blobs: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """(name, url): blobs (name, content) whose names are not there are written; all get a URL."""
    fresh = blobs.join(existing.select("name"), "name", "left_anti")
    fresh.select(F.base64("content").alias("content"), "name").write.mode("append").partitionBy("name").text(folder)
    return blobs.select("name", F.concat(F.lit(f"{folder}/name="), "name").alias("url"))


def package(folder: str, out: str) -> dict:
    """Copies a build (parquet/ and ontology/ must be there) and writes its manifest."""
    for need in ("parquet", "ontology"):
        if not os.path.isdir(os.path.join(folder, need)):
            raise FileNotFoundError(f"{need}/ is missing")
    manifest = {}
    for part in sorted(os.listdir(folder)):
        source = os.path.join(folder, part)
        if os.path.isdir(source):
            shutil.copytree(source, os.path.join(out, part), dirs_exist_ok=True)
            names = sorted(os.path.relpath(os.path.join(d, n), source) for d, _, ns in os.walk(source) for n in ns)
            manifest[part] = {"files": len(names), "bytes": sum(os.path.getsize(os.path.join(source, n)) for n in names), "names": names}
    with open(os.path.join(out, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=1, sort_keys=True)
    return manifest


def completed(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of finished work; empty if there are none."""
    try:
        return spark.read.schema("key string").json(folder)
    except Exception:  # noqa: BLE001  no folder yet
        return spark.createDataFrame([], "key string")


def mark_completed(keys: DataFrame, folder: str) -> None:
    keys.select("key").write.mode("append").json(folder)


def write_table_artifacts(tables: DataFrame, folder: str) -> None:
    """HTML and plain forms of tables (source_file_id, t, content_html, content), in a folder for each source and number."""
    rows = tables.select(F.regexp_replace("source_file_id", ":", "_").alias("source"), F.col("t").alias("table"), F.explode(F.array(F.struct(F.lit("html").alias("form"), F.col("content_html").alias("value")), F.struct(F.lit("text").alias("form"), F.col("content").alias("value")))).alias("r"))
    rows.select("source", "table", "r.form", "r.value").write.mode("overwrite").partitionBy("source", "table", "form").text(folder)
