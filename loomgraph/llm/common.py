"""Shared helpers: table reading, scratch tables, Arrow batch bounds, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.session import prepare

#: Arrow batches hold at most this many rows and, but for the last row, bytes, so that a batch of long texts fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session (a documented side effect of the operators) and ships the package."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Scratch:
    """Tables in the shared folder named by spark.checkpoint.dir; they cut lineage and survive lost executors.

    Where the setting is unset, a session on one machine gets a temporary folder that goes with the process; a cluster must name
    a folder that all its machines share. Tables that the result of an operator reads stay, for the cluster to clear.
    """

    swept = 0.0

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="loomgraph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = f"file://{folder}"
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back.

        Shuffle files go when the driver's JVM finds that nothing refers to them, which a small driver program rarely makes it look
        for; so it is asked to, now and then.
        """
        if time.monotonic() - Scratch.swept > 5:
            self.spark._jvm.System.gc()
            trim_driver(self.spark)
            Scratch.swept = time.monotonic()
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for df in frames:
            for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if self.root.split("://")[-1] in path:
                    p = jvm.org.apache.hadoop.fs.Path(path)
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def trim_driver(spark: SparkSession) -> str | None:
    """Hands native memory that the driver's JVM has freed (compilers, codecs) back to the system, and returns what the JVM says.

    The C library keeps such memory in a pool for each thread, beside a heap that may be full. None where the JVM has no such command
    (before Java 17.0.9, or not on Linux).
    """
    from py4j.protocol import Py4JError

    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        of = jvm.java.lang.Class.forName
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        # by way of the interface: the class of the server is closed to other modules
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(of, names)))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(server, array(jvm.Object, command, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String)))
    except Py4JError:
        return None


#: A sieve has 2^SIEVE bits, in rows of WORDS words of 64, whatever the number of keys. (A hash table with a row for each word would
#: take several times the room of the bits, on the driver and on each executor.)
SIEVE, WORDS = 26, 16


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """(lg_word, lg_bits): a set of bits, one for each key's hash. Its size is bounded, so it may be broadcast."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << SIEVE))
    rows = keys.select(F.floor(slot / (64 * WORDS)).cast("int").alias("lg_word"), slot.alias("lg_slot"))
    bits = [F.expr(f"coalesce(bit_or(if(pmod(shiftright(lg_slot, 6), {WORDS}) = {j}, shiftleft(1L, cast(pmod(lg_slot, 64) as int)), 0L)), 0L)") for j in range(WORDS)]
    return rows.groupBy("lg_word").agg(F.array(*bits).alias("lg_bits"))


def sieved(df: DataFrame, bits: DataFrame, *columns: str, name: str = "lg_may") -> DataFrame:
    """df with `name`: whether a row's key may be one of the sieve's (false: it is none). The exact join then sees few other rows."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << SIEVE))
    word, bit = F.floor(slot / (64 * WORDS)).cast("int"), F.pmod(F.xxhash64(*columns), F.lit(64 * WORDS)).cast("int")
    out = df.withColumns({"lg_at": word, "lg_bit": bit}).join(F.broadcast(bits), F.col("lg_at") == F.col("lg_word"), "left")
    hit = F.expr("coalesce((shiftright(lg_bits[shiftright(lg_bit, 6)], pmod(lg_bit, 64)) & 1L) = 1L, false)")
    return out.withColumn(name, hit).drop("lg_at", "lg_bit", "lg_word", "lg_bits")

def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over a uint64 array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def binary_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    import pyarrow as pa

    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def check_free(df: DataFrame, *names: str) -> None:
    """Raises if the operator's own column names are taken, rather than overwrite them."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"column names already in use: {sorted(taken)}; pass another name")


def extended(df: DataFrame, **kinds: str):
    """The schema of df with further columns."""
    from pyspark.sql.types import StructType

    out = StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, StructType.fromDDL(f"x {kind}")[0].dataType)
    return out


def release() -> None:
    """Hands freed memory of a Python worker back to the system at a task's end; workers live on from stage to stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """run, a function over Arrow batches, with release() at its end."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped
