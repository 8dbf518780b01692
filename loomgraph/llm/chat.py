"""Chat formatting by cumulative-snapshot collapse. DataFrame functions only.

A logged conversation is a snapshot: later logs repeat its turns and add more. A rolling hash stands for each turn prefix
(two 64-bit sums of turn hashes salted with the turn's place, combined by exclusive or, so that a prefix's hash follows from
the turn before). A conversation whose whole hash is the hash of a proper prefix of a longer one is dropped by an anti-join,
and of equal ones the lowest conv_id stays. What remains is rendered.

Turns are taken in order of `turn`, then role, then text. Rows repeated in all four columns count once. Null turns come
first (as -1), null roles and texts render as empty; null differs from empty in hashes. A null conv_id is a conversation.

A conversation is handled in blocks of `BLOCK` turn numbers, so one that holds a third of all rows is spread over tasks;
block hashes are combined first, then those within a block. Rendered text comes in one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, check_free, table

BLOCK = 256
#: Fixed: the marks of the rendered form.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv_id, block, ts, n): the distinct turns of a block in order."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    keyed = turns.select("conv_id", F.floor(turn / BLOCK).cast("long").alias("block"), F.struct(turn.alias("turn"), "role", "text").alias("t"))
    rows = keyed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    return rows.withColumn("n", F.size("ts").cast("long"))


def turn_hash(seed: int) -> str:
    """SQL: the hash of turn t, the i-th of its turn number's place."""
    return f"xxhash64({seed}, t.turn, t.role is null, t.role, t.text is null, t.text)"


def prefixes(blocks: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, last): the hash after each turn; last marks the whole conversation."""
    hashed = blocks.withColumns({f"b{k}": F.expr(f"aggregate(ts, 0L, (a, t) -> a ^ {turn_hash(k)})") for k in (1, 2)})
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    light = hashed.select("conv_id", "block", "n", "b1", "b2").withColumns({
        "n0": F.coalesce(F.sum("n").over(before), F.lit(0)), "p1": F.coalesce(F.bit_xor("b1").over(before), F.lit(0)), "p2": F.coalesce(F.bit_xor("b2").over(before), F.lit(0)),
        "final": F.lead("block").over(order).isNull(),
    })
    turns = blocks.select("conv_id", "block", "n", F.posexplode("ts").alias("i", "t")).select("conv_id", "block", "n", "i", *[F.expr(turn_hash(k)).alias(f"h{k}") for k in (1, 2)])
    within = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rolled = turns.withColumns({f"r{k}": F.bit_xor(f"h{k}").over(within) for k in (1, 2)}).select("conv_id", "block", "i", "n", "r1", "r2")
    same = rolled["conv_id"].eqNullSafe(light["conv_id"]) & (rolled["block"] == light["block"])
    out = rolled.join(light.drop("n", "b1", "b2"), same)
    return out.select(rolled["conv_id"], (F.col("n0") + F.col("i") + 1).alias("place"), F.expr("r1 ^ p1").alias("h1"), F.expr("r2 ^ p2").alias("h2"), (F.col("final") & (F.col("i") + 1 == F.col("n"))).alias("last"))


def maximal(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The blocks of all conversations, and (conv_id, n_turns, snapshots) of maximal ones."""
    blocks = scratch.save(blocks_of(turns.select("conv_id", "turn", "role", "text")))
    hashes = scratch.save(prefixes(blocks))
    key = ["place", "h1", "h2"]
    whole = hashes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.max(F.col("conv_id").isNull()).alias("any_null"))
    whole = whole.withColumn("conv_id", F.when(~F.col("any_null"), F.col("conv_id")))  # null sorts first
    inner = hashes.where("not last").select(*key).distinct()
    return blocks, whole.join(inner, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies")


def render(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, block, n_turns, copies, rendered): the blocks of maximal conversations, in their rendered form."""
    check_free(turns, "lg_conv")
    blocks, kept = maximal(turns, scratch)
    kept = kept.withColumnRenamed("conv_id", "lg_conv")
    text = f"array_join(transform(ts, t -> concat('{OPEN}', coalesce(t.role, ''), '{MIDDLE}', coalesce(t.text, ''), '{CLOSE}')), '')".replace("\n", "\\n")
    return blocks.join(kept, F.col("conv_id").eqNullSafe(F.col("lg_conv"))).select("conv_id", "block", "n_turns", "copies", F.expr(text).alias("rendered"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"), Scratch(spark, "op3"))


OP3_SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
c AS (SELECT conv_id, max(n) AS n, list(struct_pack(t := turn, r := role, x := text) ORDER BY place) AS ts FROM p GROUP BY conv_id),
pre AS (SELECT conv_id, i, n, ts[1:i] AS ts FROM c, unnest(range(1, n + 1)) AS u(i)),
inner_p AS (SELECT DISTINCT i AS n, ts FROM pre WHERE i < n),
whole AS (SELECT n, ts, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY n, ts),
kept AS (SELECT w.* FROM whole w LEFT JOIN inner_p q ON q.n = w.n AND q.ts = w.ts WHERE q.n IS NULL)
SELECT k.conv_id, CAST(floor(p.turn / 256.0) AS BIGINT) AS block, CAST(k.n AS BIGINT) AS n_turns, CAST(k.copies AS BIGINT) AS copies,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM kept k JOIN p USING (conv_id) GROUP BY ALL
"""
