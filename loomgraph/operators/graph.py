"""Graph queries: nodes are entities, edges are relationships, hops are equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T


def node_view(entities: DataFrame, kind: str, renames: dict[str, str] | None = None, filter_column: str = "entity_type") -> DataFrame:
    """The nodes of a type (empty: all) with columns renamed to properties."""
    rows = entities.where(F.col(filter_column) == kind) if kind else entities
    return rows.select([F.col(c).alias(p) for p, c in renames.items()]) if renames else rows


def edge_view(relationships: DataFrame, verb: str) -> DataFrame:
    return relationships.where(F.col("relationship_type") == verb).select("relationship_id", "source_entity_id", "target_entity_id", "evidence_id")


#: Verbs whose inverses are made as rows.
INVERSES = {"has_component": "component_of", "has_part": "part_of", "has_step": "step_of"}


def with_inverses(edges: DataFrame, inverses: dict[str, str] = INVERSES) -> DataFrame:
    """Edges and, for the given verbs, their inverses under the inverse's name."""
    name = F.create_map(*[F.lit(x) for kv in inverses.items() for x in kv])
    back = edges.where(F.col("relationship_type").isin(list(inverses))).select(name[F.col("relationship_type")].alias("relationship_type"), F.col("target_entity_id").alias("source_entity_id"), F.col("source_entity_id").alias("target_entity_id"))
    return edges.select("relationship_type", "source_entity_id", "target_entity_id").unionByName(back)


def named(entities: DataFrame, prefix: str, kind: str | None = None) -> DataFrame:
    rows = entities if kind is None else entities.where(F.col("entity_type") == kind)
    return rows.select(F.col("entity_id").alias(f"{prefix}_id"), F.col("display_name").alias(f"{prefix}_name"), F.col("entity_type").alias(f"{prefix}_type"))


def hop(left: DataFrame, on: str, edges: DataFrame, verb: str | list[str], to: str, how: str = "inner", reverse: bool = False) -> DataFrame:
    """left with the ids that one edge away from column `on` under the verb(s)."""
    a, b = ("target_entity_id", "source_entity_id") if reverse else ("source_entity_id", "target_entity_id")
    step = edges.where(F.col("relationship_type").isin(verb)).select(F.col(a).alias(on), F.col(b).alias(to))
    return left.join(step, on, how)


def containing(entities: DataFrame, kind: str, keyword: str) -> DataFrame:
    return entities.where((F.col("entity_type") == kind) & F.lower("display_name").contains(keyword.lower()))


def neighbours(entities: DataFrame, edges: DataFrame, kind: str, keyword: str, verb: str, reverse: bool = False) -> DataFrame:
    """(from_name, to_name), distinct: one hop from the nodes of a type whose name holds the keyword.

    Components of a model, steps of a procedure and causes of a symptom are of this form.
    """
    start = named(containing(entities, kind, keyword), "from")
    return hop(start, "from_id", edges, verb, "to_id", reverse=reverse).join(named(entities, "to"), "to_id").select("from_name", "to_name").distinct()


#: The optional hops of the fan-out of a symptom: (column, from, verbs, reversed).
FAN = [("cause", "symptom", ["causes"], True), ("check", "symptom", ["diagnosed_by"], False), ("repair", "symptom", ["remediated_by"], False), ("step", "repair", ["has_step"], False), ("resolution", "symptom", ["resolved_by"], False)]


def fan_out(entities: DataFrame, edges: DataFrame, keyword: str, kind: str = "Symptom", hops=FAN) -> DataFrame:
    """One row for each combination of a node's optional hops, as chained optional matches give. Rows multiply by design;
    fan_counts has the same in aggregate."""
    rows = named(containing(entities, kind, keyword), "symptom").select("symptom_id", "symptom_name")
    for to, source, verbs, reverse in hops:
        rows = hop(rows, f"{source}_id", edges, verbs, f"{to}_id", "left", reverse)
        rows = rows.join(named(entities, to).select(f"{to}_id", f"{to}_name"), f"{to}_id", "left")
    return rows.select("symptom_name", *[f"{h[0]}_name" for h in hops])


def fan_counts(entities: DataFrame, edges: DataFrame, keyword: str, kind: str = "Symptom", hops=FAN) -> DataFrame:
    """Distinct ends of each hop for each start node. Each hop is counted by itself, so nothing multiplies."""
    start = named(containing(entities, kind, keyword), "symptom").select("symptom_id", "symptom_name")
    reached = {"symptom": start.select("symptom_id").withColumn("root", F.col("symptom_id"))}
    out = start
    for to, source, verbs, reverse in hops:
        got = hop(reached[source], f"{source}_id", edges, verbs, f"{to}_id", reverse=reverse).select("root", f"{to}_id").distinct()
        reached[to] = got
        out = out.join(got.groupBy(F.col("root").alias("symptom_id")).agg(F.count(F.lit(1)).alias(f"n_{to}")), "symptom_id", "left")
    return out.select("symptom_id", "symptom_name", *[F.coalesce(f"n_{h[0]}", F.lit(0)).cast("long").alias(f"n_{h[0]}") for h in hops])


def top_by_neighbours(entities: DataFrame, edges: DataFrame, kind: str, verb: str | list[str], k: int, reverse: bool = False) -> DataFrame:
    """The k nodes of a type with the most distinct neighbours under the verb, ties by name and id."""
    start = named(entities, "n", kind)
    counts = hop(start, "n_id", edges, verb, "m_id", reverse=reverse).groupBy("n_id", "n_name").agg(F.count_distinct("m_id").alias("n"))
    return counts.orderBy(F.desc("n"), "n_name", "n_id").limit(k)


def affected(edges: DataFrame, entities: DataFrame, keyword: str, kind: str = "Symptom", verb: str = "has_symptom") -> DataFrame:
    """(n): how many sources have an edge to nodes of a type whose name holds the keyword."""
    start = named(containing(entities, kind, keyword), "s")
    return hop(start, "s_id", edges, verb, "m_id", reverse=True).agg(F.count_distinct("m_id").alias("n"))


def sharing(edges: DataFrame, verb: str | list[str], least: int = 2, reverse: bool = True) -> DataFrame:
    """(id, n): nodes with at least so many distinct neighbours, such as parts of more than one model."""
    a, b = ("target_entity_id", "source_entity_id") if reverse else ("source_entity_id", "target_entity_id")
    return edges.where(F.col("relationship_type").isin(verb)).groupBy(F.col(a).alias("id")).agg(F.count_distinct(b).alias("n")).where(F.col("n") >= least)


def same_neighbours(edges: DataFrame, verb: str | list[str], of: str | DataFrame) -> DataFrame:
    """(id, shared): other sources with a neighbour in common with the given one, such as procedures with the same tools."""
    mine = edges.where(F.col("relationship_type").isin(verb)).select("source_entity_id", "target_entity_id").distinct()
    own = mine.where(F.col("source_entity_id") == of).select("target_entity_id")
    return mine.where(F.col("source_entity_id") != of).join(own, "target_entity_id").groupBy(F.col("source_entity_id").alias("id")).agg(F.count(F.lit(1)).alias("shared"))


def isolated(entities: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(total, isolated): nodes of a type, and those without an edge."""
    ends = edges.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).distinct().withColumn("linked", F.lit(1))
    own = entities.where(F.col("entity_type") == kind).join(ends, "entity_id", "left")
    return own.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("linked").isNull().cast("long")).alias("isolated"))


def sanitized(ids: DataFrame, column: str, most: int = 20) -> DataFrame:
    """Ids of allowed characters, at most so many (a feature: what a search filter may hold)."""
    return ids.where(F.col(column).rlike("^[a-zA-Z0-9:_-]+$")).orderBy(column).limit(most)


def anchors(entities: DataFrame, terms: DataFrame, term: str = "term") -> DataFrame:
    """Entities whose canonical key or an alias equals a term, in lower case."""
    keys = entities.select("entity_id", F.explode(F.array_union(F.array("canonical_key"), T.truthy_list("search_aliases"))).alias("k"))
    return keys.join(terms.select(F.lower(term).alias("k")).distinct(), "k", "left_semi").select("entity_id").distinct()


def traverse(edges: DataFrame, start: DataFrame, hops: int = 2, verbs: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(root, id, hops, score, path): ids within so many hops of each start (root), by edges in either direction.

    Shortest first; score is the product of confidences of the best shortest path (ties by path text). `most` keeps the best
    ids of each root (a top-k report).
    """
    scoped = edges if verbs is None else edges.where(F.col("relationship_type").isin(verbs))
    one = scoped.select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"), F.col("relationship_type").alias("verb"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    both = one.withColumn("arrow", F.concat(F.lit(" --["), "verb", F.lit("]--> "))).unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "verb", "c").withColumn("arrow", F.concat(F.lit(" <--["), "verb", F.lit("]-- "))))
    seen = start.select(F.col("id").alias("root"), "id").distinct().withColumns({"hops": F.lit(0), "score": F.lit(1.0), "path": F.col("id")})
    layer = seen
    for h in range(1, hops + 1):
        steps = layer.join(both, F.col("id") == F.col("a")).select("root", F.col("b").alias("id"), (F.col("score") * F.col("c")).alias("score"), F.concat("path", "arrow", "b").alias("path"))
        best = steps.groupBy("root", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("m")).select("root", "id", F.lit(h).alias("hops"), (-F.col("m.s")).alias("score"), F.col("m.path").alias("path"))
        layer = best.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        seen = seen.unionByName(layer)
    if most is not None:
        w = Window.partitionBy("root").orderBy("hops", F.desc("score"), "id")
        seen = seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
    return seen


def path_text(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """Paths of ids with each id as Type "name"."""
    parts = paths.select("root", "id", "hops", F.posexplode(F.split("path", " (?=<?--\\[)|(?<=--[>]?) ")).alias("i", "part"))
    label = named(entities, "e").select(F.col("e_id").alias("part"), F.concat("e_type", F.lit(' "'), "e_name", F.lit('"')).alias("label"))
    shown = parts.join(label, "part", "left").withColumn("s", F.coalesce("label", "part"))
    return shown.groupBy("root", "id", "hops").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ").alias("path"))


def evidence_trace(t: dict[str, DataFrame]) -> DataFrame:
    """Entity, relationship, evidence, region and asset of each fully evidenced edge whose evidence and asset agree on the blob."""
    a = t["entities"].select(F.col("entity_id").alias("source_entity_id"), F.col("display_name").alias("source_name"))
    b = t["entities"].select(F.col("entity_id").alias("target_entity_id"), F.col("display_name").alias("target_name"))
    r = t["relationships"].select("relationship_id", "relationship_type", "source_entity_id", "target_entity_id", "evidence_id")
    e = t["evidence"].select("evidence_id", "source_type", "visual_region_id", F.col("blob_url").alias("evidence_url"))
    g = t["visual_regions"].select("visual_region_id", "image_id", "region_type", F.col("identified_entity_id"))
    v = t["visual_assets"].select("image_id", F.col("blob_url").alias("asset_url"))
    out = r.join(a, "source_entity_id").join(b, "target_entity_id").join(e, "evidence_id").join(g, "visual_region_id").join(v, "image_id")
    return out.where(F.col("evidence_url").eqNullSafe(F.col("asset_url"))).select("source_name", "relationship_type", "target_name", "source_type", "region_type", (F.col("identified_entity_id") == F.col("target_entity_id")).alias("identifies_target"), "asset_url")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
