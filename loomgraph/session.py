"""Sessions, and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(name: str = "loomgraph", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session; a cluster brings its own."""
    build = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    return build.config(map=conf).getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Sends this package's sources to the executors once for each context; they need no copy of the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="loomgraph-")  # the driver serves it until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "loomgraph_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f"{HERE.name}/{f.relative_to(HERE)}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def saver(spark: SparkSession, folder: str):
    """A function that writes a frame under the folder and reads it back, which cuts its lineage."""
    import uuid

    def save(df):
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save
