"""Language ID: an interpolated Kneser-Ney character model for each language, in sorted hash arrays.

The language with the lowest cross-entropy per character wins. Training sees text and lang of rows that are not held
out (crc32 of doc_id as text, mod `FOLDS`, is not 0), with counts over all of them. A result is marked rejected if its
cross-entropy is above the `QUANTILE` of training texts of that language plus `SLACK` (calibration).

Words are runs of letters and their marks. Models of up to `MAX_ENTRIES` entries in all (12 bytes each) are sent to the executors as
sorted hash arrays for each language, sparse: a language holds what it has seen. Beyond that, documents meet the values of
their grams by joins (charlm), and the arrays are those of a block of documents. Order, counts and values are the same.

Texts that are null or have no letter get `und` and score 0 (a number form such as U+00BD is no letter). Ties go to the language
that sorts first. Null doc_id: held out (no crc32). Rows repeated are answered each. With no labelled training row every text
is `und`. Texts and words of any length are read whole. An empty table gives an empty table. Columns named like an output raise
an error in `predict`; `identify` takes doc_id, lang and text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import charlm
from .common import Scratch, bound_batches, check_free, extended, released, table

ORDER = 4
MAX_ENTRIES = 4_000_000
FOLDS = 5
QUANTILE = 0.999
SLACK = 0.1
#: Characters of evidence beyond which a score does not harden, and the temperature of the score.
EVIDENCE, TEMPERATURE = 200.0, 4.0


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, scratch: Scratch) -> charlm.Tables | None:
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").alias("model"), "text")
    return charlm.train(rows, scratch, ORDER, "letters")


def decided(sums: np.ndarray, names: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and whether there is a language, for rows of sums and sizes."""
    size = sums[:, -1]
    some = size > 0
    h = -sums[:, :-1] / np.maximum(size, 1)[:, None]
    best = h.argmin(1)
    entropy = h[np.arange(len(h)), best]
    gap = (h - entropy[:, None]) * np.minimum(size, EVIDENCE)[:, None] / TEMPERATURE
    score = 1 / np.exp(-gap).sum(1)
    return [names[b] if s else "und" for b, s in zip(best, some)], np.where(some, score, 0.0), np.where(some, entropy, 0.0), some


def letterless(text: str | None) -> bool:
    """Whether a text has no letter (marks alone are none)."""
    return not text or not any(map(str.isalpha, text))


def predict(docs: DataFrame, model: charlm.Tables | None) -> DataFrame:
    """Adds lang_pred, score and cross_entropy to the columns of docs."""
    check_free(docs, "lang_pred", "score", "cross_entropy", "lg_sums", "lg_size", "lg_found", "lg_block")
    if model is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"))
    schema, names, own = extended(docs, lang_pred="string", score="double", cross_entropy="double"), model.names, docs.columns
    at = own.index("text")
    joined = model.entries() > MAX_ENTRIES
    rows = model.joined_sums(docs).drop("lg_found") if joined else docs
    shared = docs.sparkSession.sparkContext.broadcast(None if joined else model.collect())  # at most 12 * MAX_ENTRIES bytes

    def run(batches):
        arrays = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if joined:
                sums = np.column_stack([np.array(batch.column(len(own)).to_pylist()).reshape(-1, len(names)), batch.column(len(own) + 1).to_numpy(zero_copy_only=False)])
                batch = batch.select(range(len(own)))
            else:
                sums = charlm.sums(texts, "letters", ORDER, len(names), arrays.of)
            sums[[i for i, t in enumerate(texts) if letterless(t)], -1] = 0
            pred, score, entropy, some = decided(sums, names)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, mask=~some)], [*batch.schema.names, "lang_pred", "score", "cross_entropy"])

    return rows.mapInArrow(released(run), schema)


def identify(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for each row of docs."""
    bound_batches(docs.sparkSession)
    model = fit(docs, scratch)
    # lang rides along only for calibration on training rows; predict() reads text alone
    rows = predict(docs.select("doc_id", "lang", "text"), model).withColumn("held_out", held_out(F.col("doc_id"))).drop("text")
    rows = scratch.save(rows)
    own = rows.where(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")))
    limits = own.groupBy("lang_pred").agg((F.percentile_approx("cross_entropy", F.lit(QUANTILE), F.lit(10_000)) + SLACK).alias("limit"))
    out = rows.join(F.broadcast(limits), "lang_pred", "left")  # a row for each language
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(False)).alias("rejected"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
