"""Validation gates. Each is a query whose rows are violations: (rule, severity, table, key, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import schemas

COLUMNS = ["rule", "severity", "table", "key", "message"]


def rows(df: DataFrame, rule: str, table: str, key, message, severity: str = "fail") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    message = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(table).alias("table"), key.cast("string").alias("key"), message.alias("message"))


def duplicate_ids(df: DataFrame, key: str, rule: str, table: str) -> DataFrame:
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows(found, rule, table, key, F.format_string("%d rows", "n"))


def dangling(child: DataFrame, columns: list[str], parent: DataFrame, parent_key: str, rule: str, table: str, child_key: str) -> DataFrame:
    """References (in any of the columns) to keys that the parent lacks; null refers to nothing."""
    refs = child.select(F.col(child_key).alias("k"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("r")).select("k", "r.c", "r.v").where("v is not null")
    keys = parent.select(F.col(parent_key).cast("string").alias("v"))
    return rows(refs.join(keys, "v", "left_anti"), rule, table, "k", F.concat_ws("=", "c", "v"))


def filtered(df: DataFrame, condition, rule: str, table: str, key: str, message: str, severity: str = "fail") -> DataFrame:
    return rows(df.where(condition), rule, table, key, message, severity)


def not_null(df: DataFrame, name: str) -> DataFrame:
    must = [c for c in schemas.required(name) if c in df.columns]
    bad = df.select(F.col(schemas.KEYS[name]).alias("k"), F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in must]))).alias("c"))
    return rows(bad, "not_null", name, "k", F.col("c"))


def url_mismatch(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """Search documents whose blob_url is not that of their asset, where the asset has one."""
    a = assets.select(F.col("image_id").alias("i"), F.col("blob_url").alias("u")).where("u is not null and u != ''")
    return rows(docs.join(a, F.col("image_id") == F.col("i")).where(~F.col("blob_url").eqNullSafe(F.col("u"))), "blob_url_differs", "search_docs", "image_id", F.col("u"))


def structural_fields(docs: DataFrame, json: str, key: str, fields: list[str]) -> DataFrame:
    """Search documents (JSON text) that hold fields of the graph itself."""
    leaked = F.array_intersect(F.json_object_keys(json), F.array(*map(F.lit, fields)))
    return rows(docs.where(F.size(leaked) > 0), "structural_fields", "search_docs", key, F.array_join(leaked, ","))


#: Fields of entities and relationships that search documents must not hold.
STRUCTURAL = ["entity_id", "entity_type", "relationship_id", "relationship_type", "source_entity_id", "target_entity_id"]


def field_difference(have: list[str], declared: list[str]) -> dict[str, list[str]]:
    """Fields of documents that the index does not declare, and the reverse."""
    return {"extra": sorted(set(have) - set(declared)), "missing": sorted(set(declared) - set(have))}


def polygon_json(regions: DataFrame) -> DataFrame:
    """Regions of layout analysis need a polygon that is a non-empty list."""
    if "source_type" not in regions.columns:
        return regions.sparkSession.createDataFrame([], "rule string, severity string, table string, key string, message string")
    points = F.size(F.from_json("polygon_json", "array<string>"))
    return filtered(regions, (F.col("source_type") == "document_intelligence") & (F.coalesce(points, F.lit(0)) <= 0), "polygon_missing", "visual_regions", "visual_region_id", "no polygon")


#: What looks like a secret in a configuration text.
SECRETS = [r"(?i)api[_-]?key\s*[=:]\s*\S{8,}", r"(?i)secret\s*[=:]\s*\S{8,}", r"(?i)password\s*[=:]\s*\S{8,}", r"(?i)token\s*[=:]\s*\S{20,}", r"(?i)connection[_-]?string\s*[=:]\s*\S{20,}", r"(?<!\$\{)[A-Za-z0-9+/]{40,}={0,2}(?!\})"]


def secrets(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One violation for each file and pattern with a match that is no ${VARIABLE}."""
    found = []
    for k, pattern in enumerate(SECRETS):
        real = F.filter(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda m: ~m.contains("${") & ~m.startswith("$"))
        found.append(rows(files.where(F.size(real) > 0), "secret", "config", path, f"pattern {k + 1}"))
    return union(found)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def data_gates(t: dict[str, DataFrame]) -> DataFrame:
    """The gates of compilation: duplicate ids, references between graph, evidence and visual tables."""
    out = []
    for name in ("entities", "relationships", "chunks", "evidence", "visual_assets", "visual_regions"):
        if name in t:
            out.append(duplicate_ids(t[name], schemas.KEYS[name], f"duplicate_{schemas.KEYS[name]}", name))
    for child, columns, parent in (("relationships", ["source_entity_id"], "entities"), ("relationships", ["target_entity_id"], "entities"), ("relationships", ["evidence_id"], "evidence"), ("visual_regions", ["image_id"], "visual_assets"), ("evidence", ["image_id"], "visual_assets"), ("evidence", ["visual_region_id", "callout_id"], "visual_regions")):
        if child in t and parent in t:
            out.append(dangling(t[child], columns, t[parent], schemas.KEYS[parent], f"dangling_{'_or_'.join(columns)}", child, schemas.KEYS[child]))
    return union(out)


def suite(t: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """data_gates and the gates of the whole package; strict adds every declared reference, ranges and null marks."""
    out = [data_gates(t)]
    if "chunks" in t and "document_elements" in t:
        out.append(dangling(t["chunks"], ["document_element_id"], t["document_elements"], "document_element_id", "dangling_document_element_id", "chunks", "chunk_id"))
    if "visual_assets" in t:
        out.append(filtered(t["visual_assets"], ~F.coalesce("is_placeholder", F.lit(False)) & (F.coalesce("blob_url", F.lit("")) == ""), "blob_url_missing", "visual_assets", "image_id", "no blob_url"))
    if "visual_regions" in t:
        out.append(polygon_json(t["visual_regions"]))
    if "chunks" in t:
        has = (F.size(F.coalesce("related_entity_ids", F.array())) > 0) & (F.size(F.coalesce("entity_search_keys", F.array())) <= 0)
        out.append(filtered(t["chunks"], has, "search_keys_missing", "chunks", "chunk_id", "related entities without search keys", "warn"))
    if "entities" in t:
        out.append(filtered(t["entities"], ~F.coalesce("is_placeholder", F.lit(False)) & (F.size(F.coalesce("search_aliases", F.array())) <= 0), "search_aliases_missing", "entities", "entity_id", "no search aliases", "warn"))
    if strict:
        for child, column, parent in schemas.FOREIGN:
            if child in t and parent in t and column in t[child].columns:
                out.append(dangling(t[child], [column], t[parent], schemas.KEYS[parent], f"foreign_{child}_{column}", child, schemas.KEYS[child]))
        for name, df in t.items():
            out.append(not_null(df, name))
            if "confidence" in df.columns:
                out.append(filtered(df, ~F.col("confidence").between(0, 1), "confidence_range", name, schemas.KEYS[name], "outside 0 to 1"))
        if "entities" in t:
            out.append(duplicate_ids(t["entities"], "canonical_key", "duplicate_canonical_key", "entities"))
            if "relationships" in t:
                ends = t["relationships"].select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
                out.append(rows(t["entities"].join(ends, "entity_id", "left_anti"), "isolated_entity", "entities", "entity_id", "no relationship", "warn"))
        if "evidence" in t:
            out.append(filtered(t["evidence"], F.coalesce("text", F.lit("")) == "", "empty_evidence", "evidence", "evidence_id", "no text", "warn"))
    return union(out)


def only(violations: DataFrame, rules: list[str]) -> DataFrame:
    return violations.where(F.upper("rule").isin([r.upper() for r in rules]))


def exit_code(violations: DataFrame, code: int = 8) -> int:
    """The code if any violation is a failure, else 0."""
    return code if violations.where("severity = 'fail'").take(1) else 0


def bridge(model: dict) -> list[dict]:
    """Checks of a graph model (a small document, on the driver): ids, names and ends of types."""
    out = []
    entities, relations = model.get("entityTypes") or [], model.get("relationshipTypes") or []

    def say(rule: str, key, message: str, severity: str = "fail") -> None:
        out.append({"rule": rule, "severity": severity, "table": "model", "key": str(key), "message": message})

    ids = [e.get("id") for e in entities]
    for e in entities:
        if not e.get("id"):
            say("type_without_id", e.get("name"), "entity type without id")
        if not (e.get("dataBinding") or {}).get("table"):
            say("type_without_table", e.get("id"), "entity type without a bound table")
        elif e["dataBinding"]["table"] not in schemas.DECLARED:
            say("unknown_table", e.get("id"), f"table {e['dataBinding']['table']} is not declared")
        else:
            bound = {e["dataBinding"].get("idColumn"), e["dataBinding"].get("displayColumn"), e["dataBinding"].get("typeFilterColumn"), *(e["dataBinding"].get("properties") or {}).values()} - {None, ""}
            if lacking := sorted(bound - set(schemas.schema(e["dataBinding"]["table"]).fieldNames())):
                say("unknown_column", e.get("id"), ",".join(lacking))
    for x in sorted({i for i in ids if i and ids.count(i) > 1}):
        say("duplicate_type", x, "entity type id used twice")
    linked = set()
    for r in relations:
        for end in ("source", "target"):
            if r.get(end) not in ids:
                say("unknown_end", r.get("id"), f"{end} {r.get(end)} is no entity type")
            linked.add(r.get(end))
    for x in ids:
        if x and x not in linked:
            say("unlinked_type", x, "no relationship type uses it", "warn")
    return out


def visual_types_with_url(model: dict) -> list[dict]:
    """Types bound to visual tables that do not carry blob_url."""
    out = []
    for e in model.get("entityTypes") or []:
        binding = e.get("dataBinding") or {}
        if binding.get("table") in ("visual_assets", "visual_regions") and "blob_url" not in (binding.get("properties") or {}).values():
            out.append({"rule": "visual_type_without_url", "severity": "fail", "table": "model", "key": str(e.get("id")), "message": "no blob_url property"})
    return out


def domain_in_system_message(messages: DataFrame, brief: str, key: str = "key", text: str = "system") -> DataFrame:
    """System messages that hold text of the domain brief, which belongs in the user message."""
    return filtered(messages, F.lower(text).contains(brief.lower()), "domain_in_system_message", "messages", key, "domain text")


def missing_environment(names: list[str], env: dict[str, str]) -> list[dict]:
    """Names that are unset, empty or an unresolved ${VARIABLE}."""
    return [{"rule": "environment_missing", "severity": "fail", "table": "config", "key": n, "message": "not set"} for n in names if not env.get(n) or "${" in env[n]]
