"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, cut at language-specific quantiles.

The n-grams are those of characters in words; a word equal to the one before it counts as one repeat mark, so that
stuttering text is improbable too. Trusted texts (label quality 1 and not toxic) train `FOLDS` models, each on its share of them
(by hash of doc_id), which stay in tables; count joins, sharded by gram, give each document its perplexity under each (see
charlm), of which the mean counts. Limits are drawn from trusted documents under the models that have not seen them.
A document's cross-entropy is shrunk towards the mean of trusted documents by `PRIOR` characters, so that a few odd words do not condemn a short text. A document is
rejected if its value is above its language's limit: the `quantile` of the trusted documents of the language plus `slack` nats.
The distance of that quantile from the language's mean is drawn towards the same distance over all languages, as by `SHRINK`
documents of those; a language without trusted documents has the quantile of all.

A few toxic words do not move a mean, so a document is also rejected for its worst word. A word (a run of letters, lower case)
has the log odds of its share of documents labelled toxic against its share of trusted ones. The limit is the `quantile` of the
worst words of trusted documents, each left out of the counts it is measured by (`FLOOR` at least), plus `slack` nats.
Without a toxic or without a trusted document no word counts.

Documents reach the joins by way of sieves of a fixed size (common.sieve), which stop what has no label, or no word that may
be toxic. Null or empty texts have no cross-entropy and are kept (nothing speaks against them); with no trusted text, none has.
Null languages form a group. A document with a null doc_id has no label. Repeated rows are scored each, alike; of labels with
several rows for one doc_id, the document is trusted if any row says so. Values at the limit are kept. Words and texts of any
length are read whole. An empty table gives an empty table. Extra columns pass; columns named like an output raise an error.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import charlm
from .common import Scratch, bound_batches, check_free, released, sieve, sieved, table

ORDER = 5
FOLDS = 2
PRIOR = 60.0
QUANTILE = 0.995
SLACK = 0.15
SHRINK = 50
FLOOR = 1.0
WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    return WORD.findall(text.lower())


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct()


def score(docs: DataFrame, model: charlm.Tables | None, bad: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Adds nll (the summed negative log probability in nats; the mean of all models), nll_unseen (of the models that have not learnt
    from this doc_id, if any), nll_chars (characters scored) and toxic_word (a word of bad occurs)."""
    check_free(docs, "nll", "nll_unseen", "nll_chars", "toxic_word", "lg_sums", "lg_size", "lg_found", "lg_block")
    if model is None:
        return docs.select("*", F.lit(0.0).alias("nll"), F.lit(0.0).alias("nll_unseen"), F.lit(0.0).alias("nll_chars"), F.lit(False).alias("toxic_word"))
    out = model.joined_sums(docs, bad, words_in)
    mean = lambda xs: f"aggregate({xs}, 0D, (s, x) -> s + x) / -size({xs})"
    models = "array(" + ", ".join(f"'{n}'" for n in model.names) + ")"
    other = f"filter(lg_sums, (x, i) -> {models}[i] != lg_fold)"
    out = out.withColumn("lg_fold", F.coalesce(fold(), F.lit("")))
    return out.select(*docs.columns, F.expr(mean("lg_sums")).alias("nll"), F.expr(f"if(size({other}) = 0, {mean('lg_sums')}, {mean(other)})").alias("nll_unseen"), F.col("lg_size").alias("nll_chars"), F.col("lg_found").alias("toxic_word"))


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, toxic) of documents that are labelled toxic or trusted."""
    kinds = labels.where("toxic = 1").select("doc_id", F.lit(True).alias("toxic")).unionByName(trusted_ids(labels).withColumn("toxic", F.lit(False))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    kinds = scratch.save(kinds.where("doc_id is not null"))
    likely = sieved(docs.select("doc_id", "text"), scratch.save(sieve(kinds, "doc_id")), "doc_id").where("lg_may").drop("lg_may")
    # the same join at every size: labels grow with the documents, so they are not broadcast while they happen to be few
    return scratch.save(likely.hint("merge").join(kinds.hint("merge"), "doc_id"))


def fold():
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("string")


def fit(known: DataFrame, scratch: Scratch) -> charlm.Tables | None:
    return charlm.train(known.where("not toxic").withColumn("model", fold()), scratch, ORDER, "spaces")


def words_of(docs: DataFrame, bits=None) -> DataFrame:
    """(doc_id, word): the distinct words of each text; with bits, a broadcast sieve, only those that may be in it."""

    def run(batches):
        for batch in batches:
            found = [set(words_in(t)) if t else set() for t in batch.column(1).to_pylist()]
            if bits is not None:
                few = set(charlm.passing(set().union(*found), bits.value))
                found = [f & few for f in found]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array([w for f in found for w in f], pa.string())], ["doc_id", "word"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word string")


def toxic_words(known: DataFrame, scratch: Scratch, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame | None:
    """(word): words any of which condemns a document."""
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    count = lambda rows, name: rows.groupBy("word").agg(F.count(F.lit(1)).alias(name))
    toxic = scratch.save(count(words_of(known.where("toxic")), "t"))
    # words of trusted documents are many, so only sums of them move; their words are read once more for the few that matter
    send = known.sparkSession.sparkContext.broadcast
    own = lambda words: words_of(known.where("not toxic"), send(charlm.sieve_array(words, scratch)))  # noqa: E731  # 8 MB
    odds = lambda o: F.log((F.col("t") + 0.5) / (sizes[True] + 1)) - F.log((o + 0.5) / (sizes[False] + 1))
    counts = toxic.join(count(own(toxic), "o"), "word", "left").withColumn("o", F.coalesce("o", F.lit(0)))
    counts = scratch.save(counts.select("word", "o", odds(F.col("o")).alias("odds"), odds(F.greatest(F.col("o") - 1, F.lit(0))).alias("alone")).where(F.col("alone") > FLOOR))
    some = scratch.save(counts.where("o > 0").select("word", "alone"))
    worst = own(some).join(some, "word").groupBy("doc_id").agg(F.max("alone").alias("worst"))
    every = known.where("not toxic").select("doc_id").distinct().join(worst, "doc_id", "left")
    limit = every.agg(F.percentile_approx(F.coalesce("worst", F.lit(FLOOR)), F.lit(quantile), F.lit(10_000)).alias("q")).first()["q"] + slack
    return scratch.save(counts.where(F.col("odds") > limit).select("word"))


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> tuple[dict, float, float]:
    """Limit by language, the limit for other languages, and the trusted mean. One row for each language reaches the driver."""
    good = scored.where("nll_chars > 0").join(trusted_ids(labels), "doc_id", "left_semi").select("lang", "nll_unseen", "nll_chars")
    mean = good.agg((F.sum("nll_unseen") / F.sum("nll_chars")).alias("m")).first()["m"]
    if mean is None:
        return {}, float("inf"), 0.0
    value = (F.col("nll_unseen") + PRIOR * mean) / (F.col("nll_chars") + PRIOR)
    cut = lambda v: F.percentile_approx(v, F.lit(quantile), F.lit(10_000))
    every = good.agg(cut(value).alias("c")).first()["c"]
    by = good.groupBy(F.col("lang").alias("lg_lang")).agg(F.avg(value).alias("level"))
    above = good.join(by, F.col("lang").eqNullSafe(F.col("lg_lang"))).agg(cut(value - F.col("level")).alias("c")).first()["c"]
    rows = good.groupBy("lang").agg(cut(value).alias("c"), F.avg(value).alias("level"), F.count(F.lit(1)).alias("n")).collect()
    limit = lambda r: r["level"] + (r["n"] * (r["c"] - r["level"]) + SHRINK * above) / (r["n"] + SHRINK) + slack
    return {r["lang"]: limit(r) for r in rows}, every + slack, mean


def verdict(scored: DataFrame, limits: tuple[dict, float, float]) -> DataFrame:
    by_lang, every, mean = limits
    value = (F.col("nll") + PRIOR * mean) / (F.col("nll_chars") + PRIOR)
    limit = F.lit(every)
    for lang, cut in by_lang.items():
        limit = F.when(F.col("lang").eqNullSafe(lang), cut).otherwise(limit)
    return scored.withColumns({"cross_entropy": F.when(F.col("nll_chars") > 0, value), "limit": limit}).withColumn("keep", F.coalesce(F.col("cross_entropy") <= F.col("limit"), F.lit(True)))


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, own: list[str]) -> DataFrame:
    """The columns own of docs, with cross_entropy, limit, keep, nll and nll_chars. Each document is scored once."""
    bound_batches(docs.sparkSession)
    known = labelled(docs, labels, scratch)
    model = fit(known, scratch)
    bad = toxic_words(known, scratch)
    scratch.drop(known)
    scored = scratch.save(score(docs, model, bad).select(*own, "doc_id", "lang", "nll", "nll_unseen", "nll_chars", "toxic_word") if own != docs.columns else score(docs, model, bad))
    return verdict(scored, thresholds(scored, labels)).withColumn("keep", F.col("keep") & ~F.col("toxic_word"))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each row of docs: doc_id, lang, perplexity, cross_entropy, limit, keep."""
    out = judged(docs.select("doc_id", "lang", "text"), labels, scratch, [])
    return out.select("doc_id", "lang", F.when(F.col("nll_chars") > 0, F.exp(F.col("nll") / F.col("nll_chars"))).alias("perplexity"), "cross_entropy", "limit", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    check_free(docs, "cross_entropy", "limit", "keep")
    return judged(docs, labels, scratch, docs.columns).where("keep").select(docs.columns)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op7"))
