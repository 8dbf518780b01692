"""Further registered queries: gates, evidence, chunks, naming and small operators over tables made from the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import ids, text as T
from ..operators import compile as C, densify as D, gates as G, graph as Q, layout as L, typed as Y
from ..sources import files
from . import catalog
from .catalog import WORDS, entities, no_edges, relationships, sql_id, sql_links, table, turns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# -- elements and chunks ---------------------------------------------------------------------------------------------------


def doc_elements(spark, d) -> DataFrame:
    """Documents as elements: of doc_id modulo 4, pages, tables, table rows and images."""
    kind = F.element_at(F.array(*map(F.lit, ["page", "table", "table_row", "image_ref"])), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "documents").select(F.concat(F.lit("elem:"), "doc_id").alias("document_element_id"), F.col("source").alias("source_file_id"), kind.alias("element_type"), F.col("text").alias("content"), F.lit("elem:up").alias("parent_element_id"), F.when(F.col("doc_id") % 8 == 1, "<table></table>").alias("content_html"), F.lit("h").alias("content_hash"))
    return schemas.conform(rows, "document_elements")


@query(
    f"""WITH e AS (SELECT doc_id, source AS src, ['page', 'table', 'table_row', 'image_ref'][CAST(doc_id % 4 + 1 AS INTEGER)] AS kind, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, doc_id % 8 = 1 AS marked FROM documents),
    c AS (SELECT *, CASE kind WHEN 'page' THEN 'raw_page_text' WHEN 'table' THEN 'table_html' ELSE kind END AS chunk_type, sha256(body) AS h FROM e WHERE kind != 'image_ref' AND (body != '' OR kind = 'table' AND marked))
    SELECT {sql_id('chunk', "src || ':' || chunk_type || ':' || h")} AS chunk_id, 'elem:' || doc_id AS document_element_id, chunk_type, h AS content_hash, CASE kind WHEN 'table' THEN 'elem:' || doc_id WHEN 'table_row' THEN 'elem:up' END AS table_id, sha256(body) AS embedding, CASE WHEN kind IN ('table', 'table_row') AND marked THEN '<table></table>' END AS content_html FROM c"""
)
def chunk_rows_whole(spark, d):
    rows = files.chunk_rows(doc_elements(spark, d))
    return rows.select("chunk_id", "document_element_id", "chunk_type", "content_hash", "table_id", ids.content_hash("embedding_text").alias("embedding"), "content_html")


@query("SELECT conv_id, turn, sha256(t) AS content_hash, CASE WHEN starts_with(t, 'WARNING') THEN 'warning' WHEN starts_with(t, 'Note:') THEN 'note' ELSE 'section_text' END AS chunk_type FROM (SELECT conv_id, turn, trim(CASE role WHEN 'user' THEN 'WARNING ' WHEN 'assistant' THEN '  Note: ' ELSE '' END || text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations) WHERE length(t) BETWEEN 1 AND 1500")
def chunk_rows_notes(spark, d):
    lead = F.when(F.col("role") == "user", "WARNING ").when(F.col("role") == "assistant", "  Note: ").otherwise("")
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("document_element_id"), F.lit("src").alias("source_file_id"), F.lit("paragraph").alias("element_type"), F.concat(lead, "text").alias("content"), F.lit("h").alias("content_hash"))
    rows = rows.where(F.length(T.strip("content")).between(1, 1500))
    key = F.split("document_element_id", ":")
    return files.chunk_rows(schemas.conform(rows, "document_elements")).select(key[0].cast("bigint").alias("conv_id"), key[1].cast("bigint").alias("turn"), "content_hash", "chunk_type")


PAGE = "<h1>Page {id}</h1><p>First <b>bold</b>text of {id}.<p>Second &amp; last<img src='a{id}.png' alt='Alt {id}'><table><tr><th>K<td>V{id}</tr></table><h2>Part</h2><p>  <script>no</script></p><p>End</p>"


@query(
    """WITH p AS (SELECT CAST(page_id AS VARCHAR) AS id FROM pages), e AS (SELECT id, unnest([
    {'o': 0, 'k': 'section', 'c': 'Page ' || id, 'u': NULL, 'p': 'Page ' || id}, {'o': 1, 'k': 'paragraph', 'c': 'First bold text of ' || id || '.', 'u': 0, 'p': 'Page ' || id},
    {'o': 2, 'k': 'paragraph', 'c': 'Second & last', 'u': 0, 'p': 'Page ' || id}, {'o': 3, 'k': 'image_ref', 'c': 'a' || id || '.png Alt ' || id, 'u': 0, 'p': 'Page ' || id},
    {'o': 4, 'k': 'table', 'c': 'K V' || id, 'u': 0, 'p': 'Page ' || id}, {'o': 5, 'k': 'section', 'c': 'Part', 'u': 0, 'p': 'Page ' || id || '/Part'}, {'o': 6, 'k': 'paragraph', 'c': 'End', 'u': 5, 'p': 'Page ' || id || '/Part'}]) AS x FROM p)
    SELECT id AS path, x.o AS sort_order, x.k AS element_type, x.c AS content, coalesce(x.u, -1) AS parent, x.p AS section_path, CASE WHEN x.k = 'table' THEN '<table><tr><th>K</th><td>V' || id || '</td></tr></table>' END AS content_html FROM e"""
)
def html_element_rows(spark, d):
    page = F.replace(F.lit(PAGE), F.lit("{id}"), F.col("page_id").cast("string"))
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode(page, "utf-8").alias("content"))
    return files.elements(pages, kind="html").select("path", "sort_order", "element_type", "content", F.coalesce("parent", F.lit(-1)).alias("parent"), "section_path", "content_html")


@query("SELECT o_custkey AS k, 'table' AS element_type, -1 AS row_index, 'key, status' AS content, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, 'table_row', CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER), 'key=' || o_orderkey || '; status=' || o_orderstatus, 1 FROM orders")
def tabular_elements(spark, d):
    line = F.concat_ws("\t", "o_orderkey", "o_orderstatus")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("r"))  # the orders of a customer are a file
    text = F.concat(F.lit("key\tstatus\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"))
    parsed = files.elements(rows.select(F.concat(F.col("o_custkey"), F.lit(".tsv")).alias("path"), F.encode(text, "utf-8").alias("content")), kind="tsv")
    n = rows.select(F.concat(F.col("o_custkey"), F.lit(".tsv")).alias("path"), F.col("o_custkey").alias("k"), F.size("r").cast("bigint").alias("size"))
    return parsed.join(n, "path").select("k", "element_type", F.coalesce("row_index", F.lit(-1)).alias("row_index"), "content", F.when(F.col("element_type") == "table", F.col("size")).otherwise(1).cast("bigint").alias("n"))


# -- gates -------------------------------------------------------------------------------------------------------------------


def package(spark, d) -> dict[str, DataFrame]:
    """Star rows as the tables of a package, with known faults."""
    part, orders, supplier = (table(spark, d, n) for n in ("part", "orders", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), c)
    null = lambda k="string": F.lit(None).cast(k)
    when = F.lit("2024-01-01").cast("timestamp")
    asset = part.select(name("img:", F.col("p_partkey") - F.col("p_partkey") % 2).alias("image_id"), F.lit("src").alias("source_file_id"), F.lit("figure").alias("asset_type"), F.when(F.col("p_size") > 5, name("u:", F.col("p_partkey"))).alias("blob_url"), F.lit("h").alias("image_hash"), (F.col("p_size") % 3 == 0).alias("is_placeholder"), when.alias("created_at"), (F.col("p_size") / 40).alias("confidence"))
    region = part.select(name("reg:", F.col("p_partkey")).alias("visual_region_id"), name("img:", F.col("p_partkey")).alias("image_id"), F.lit("callout").alias("region_type"), F.when(F.col("p_size") > 10, "[1, 2]").when(F.col("p_size") > 5, "[]").alias("polygon_json"), when.alias("created_at"), F.when(F.col("p_size") % 2 == 0, "document_intelligence").alias("source_type"))
    chunk = orders.select(name("c:", F.col("o_orderkey")).alias("chunk_id"), F.lit("src").alias("source_file_id"), name("elem:", F.col("o_custkey")).alias("document_element_id"), F.when(F.col("o_orderstatus") != "P", "section_text").alias("chunk_type"), F.lit("x").alias("content"), F.when(F.col("o_orderstatus") == "O", F.array(F.lit("e"))).alias("related_entity_ids"), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("k"))).alias("entity_search_keys"))
    element = table(spark, d, "customer").where("c_acctbal >= 0").select(name("elem:", F.col("c_custkey")).alias("document_element_id"))
    entity = supplier.select(name("s:", F.col("s_suppkey")).alias("entity_id"), F.lit("Supplier").alias("entity_type"), F.col("s_name").alias("display_name"), name("supplier:", F.col("s_nationkey")).alias("canonical_key"), F.when(F.col("s_acctbal") > 0, F.array("s_name")).alias("search_aliases"), (F.col("s_suppkey") % 2 == 0).alias("is_placeholder"))
    link = table(spark, d, "lineitem").where("l_linenumber = 1").select(name("r:", F.col("l_orderkey")).alias("relationship_id"), F.lit("supplies").alias("relationship_type"), name("s:", F.col("l_suppkey")).alias("source_entity_id"), name("s:", F.col("l_suppkey") + 1).alias("target_entity_id"), F.when(F.col("l_quantity") > 25, name("ev:", F.col("l_partkey"))).alias("evidence_id"))
    evidence = part.select(name("ev:", F.col("p_partkey")).alias("evidence_id"), F.lit("src").alias("source_file_id"), F.lit("chunk").alias("source_type"), name("img:", F.col("p_partkey")).alias("image_id"), name("reg:", F.col("p_partkey")).alias("visual_region_id"), null().alias("callout_id"), name("u:", F.col("p_partkey")).alias("blob_url"), F.when(F.col("p_size") > 3, "t").alias("text"))
    return {"visual_assets": asset, "visual_regions": region, "chunks": chunk, "document_elements": element, "entities": entity, "relationships": link, "evidence": evidence}


PACKAGE = """a AS (SELECT 'img:' || (p_partkey - p_partkey % 2) AS id, CASE WHEN p_size > 5 THEN 'u:' || p_partkey END AS url, p_size % 3 = 0 AS ph, p_size / 40.0 AS conf FROM part),
g AS (SELECT 'reg:' || p_partkey AS id, 'img:' || p_partkey AS img, p_size FROM part), c AS (SELECT 'c:' || o_orderkey AS id, 'elem:' || o_custkey AS el, * FROM orders),
e AS (SELECT 's:' || s_suppkey AS id, s_suppkey % 2 = 0 AS ph, s_acctbal > 0 AS al, 'supplier:' || s_nationkey AS ck FROM supplier),
r AS (SELECT 'r:' || l_orderkey AS id, 's:' || l_suppkey AS s, 's:' || (l_suppkey + 1) AS t, CASE WHEN l_quantity > 25 THEN 'ev:' || l_partkey END AS ev FROM lineitem WHERE l_linenumber = 1),
v AS (SELECT 'ev:' || p_partkey AS id, 'img:' || p_partkey AS img, 'reg:' || p_partkey AS reg, 'u:' || p_partkey AS url, CASE WHEN p_size > 3 THEN 't' END AS text FROM part)"""


@query(
    f"""WITH {PACKAGE}, found AS (
    SELECT 'duplicate_image_id' AS rule, id AS key FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_relationship_id', id FROM r GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'dangling_target_entity_id', id FROM r WHERE t NOT IN (SELECT id FROM e) UNION ALL SELECT 'dangling_source_entity_id', id FROM r WHERE s NOT IN (SELECT id FROM e)
    UNION ALL SELECT 'dangling_evidence_id', id FROM r WHERE ev NOT IN (SELECT id FROM v) UNION ALL SELECT 'dangling_image_id', id FROM g WHERE img NOT IN (SELECT id FROM a) UNION ALL SELECT 'dangling_image_id', id FROM v WHERE img NOT IN (SELECT id FROM a)
    UNION ALL SELECT 'dangling_visual_region_id_or_callout_id', id FROM v WHERE reg NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'dangling_document_element_id', id FROM c WHERE el NOT IN (SELECT 'elem:' || c_custkey FROM customer WHERE c_acctbal >= 0)
    UNION ALL SELECT 'blob_url_missing', id FROM a WHERE NOT ph AND url IS NULL UNION ALL SELECT 'polygon_missing', id FROM g WHERE p_size % 2 = 0 AND p_size <= 10
    UNION ALL SELECT 'search_keys_missing', id FROM c WHERE o_orderstatus = 'O' AND o_orderpriority != '1-URGENT' UNION ALL SELECT 'search_aliases_missing', id FROM e WHERE NOT ph AND NOT al)
    SELECT rule, key, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY rule, key"""
)
def gate_suite(spark, d):
    return G.suite(package(spark, d)).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {PACKAGE} SELECT 'not_null' AS rule, id AS key, 'chunk_type' AS message FROM c WHERE o_orderstatus = 'P' UNION ALL SELECT 'confidence_range', id, 'outside 0 to 1' FROM a WHERE conf > 1
    UNION ALL SELECT 'duplicate_canonical_key', ck, count(*) || ' rows' FROM e GROUP BY ck HAVING count(*) > 1 UNION ALL SELECT 'isolated_entity', id, 'no relationship' FROM e WHERE id NOT IN (SELECT s FROM r) AND id NOT IN (SELECT t FROM r) UNION ALL SELECT 'empty_evidence', id, 'no text' FROM v WHERE text IS NULL"""
)
def gate_strict(spark, d):
    t = package(spark, d)
    t = {"chunks": t["chunks"].select("chunk_id", "source_file_id", "chunk_type", "content", "related_entity_ids", "entity_search_keys"), **{k: t[k] for k in ("entities", "relationships", "evidence", "visual_assets")}}
    return G.only(G.suite(t, strict=True), ["not_null", "confidence_range", "duplicate_canonical_key", "isolated_entity", "empty_evidence"]).select("rule", "key", "message")


@query(f"WITH {PACKAGE} SELECT 'blob_url_differs' AS rule, v.img AS key, a.url AS message FROM v JOIN a ON a.id = v.img WHERE a.url IS NOT NULL AND a.url != v.url")
def gate_url_differs(spark, d):
    t = package(spark, d)
    return G.url_mismatch(t["evidence"].select("image_id", "blob_url"), t["visual_assets"]).select("rule", "key", "message")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, 'entity_id' || CASE WHEN o_orderstatus = 'F' THEN ',relationship_type' ELSE '' END AS message FROM orders WHERE o_orderstatus != 'O'")
def gate_structural_fields(spark, d):
    json = F.when(F.col("o_orderstatus") == "O", '{"chunk_id": 1}').when(F.col("o_orderstatus") == "F", '{"entity_id": 1, "relationship_type": 2}').otherwise('{"entity_id": 1, "x": {"entity_type": 2}}')
    return G.structural_fields(table(spark, d, "orders").select("o_orderkey", json.alias("json")), "json", "o_orderkey", G.STRUCTURAL).select("key", "message")


@query("SELECT CAST(doc_id AS VARCHAR) AS key FROM documents WHERE contains(lower(text), 'all rights reserved')")
def gate_domain_in_system_message(spark, d):
    return G.domain_in_system_message(table(spark, d, "documents"), "All rights RESERVED", "doc_id", "text").select("key")


@query("SELECT 'c_' || k AS column, CAST(n AS BIGINT) AS n, first FROM (SELECT 'chunk_type' AS k, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'P') WHERE n > 0")
def null_columns(spark, d):
    rows = package(spark, d)["chunks"].withColumns({"file_ord": F.lit(0), "pos": F.substring("chunk_id", 3, 20).cast("bigint")})
    found = C.null_violations(rows.select("file_ord", "pos", "chunk_id", "source_file_id", "chunk_type", "content"), "chunks")
    return found.select(F.concat(F.lit("c_"), "column").alias("column"), "n", F.col("first.pos").alias("first"))


# -- evidence, anchors, views ---------------------------------------------------------------------------------------------------


@query(
    f"""WITH {PACKAGE} SELECT p.s_name AS source_name, q.s_name AS target_name, 'callout' AS region_type, a.url AS asset_url, count(*) AS n FROM r JOIN supplier p ON r.s = 's:' || p.s_suppkey JOIN supplier q ON r.t = 's:' || q.s_suppkey JOIN v ON r.ev = v.id JOIN g ON g.id = v.reg JOIN a ON a.id = g.img WHERE a.url = v.url GROUP BY ALL"""
)
def evidence_chain(spark, d):
    t = package(spark, d)
    t["visual_regions"] = t["visual_regions"].withColumn("identified_entity_id", F.lit(None).cast("string"))
    return Q.evidence_trace(t).groupBy("source_name", "target_name", "region_type", "asset_url").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 's:' || s_suppkey AS entity_id FROM supplier WHERE s_nationkey IN (3, 7) OR s_acctbal > 0 AND lower(s_name) IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey % 5 = 0)")
def anchor_match(spark, d):
    e = package(spark, d)["entities"].withColumn("search_aliases", F.transform("search_aliases", F.lower))
    s = table(spark, d, "supplier")
    terms = s.where("s_suppkey % 5 = 0").select(F.upper("s_name").alias("term")).unionByName(spark.createDataFrame([("Supplier:3",), ("SUPPLIER:7",), ("nothing",)], "term string"))
    return Q.anchors(e, terms)


@query("SELECT id FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 's:' || s_suppkey ELSE 's ' || s_suppkey END AS id FROM supplier) WHERE regexp_matches(id, '^[a-zA-Z0-9:_-]+$') ORDER BY id LIMIT 20")
def safe_ids(spark, d):
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("s:"), "s_suppkey")).otherwise(F.concat(F.lit("s "), "s_suppkey")).alias("id"))
    return Q.sanitized(s, "id")


@query(f"WITH {catalog.ENT} SELECT entity_id AS id, display_name AS name FROM ent WHERE entity_type = 'Nation'")
def node_properties(spark, d):
    return Q.node_view(entities(spark, d, ["Nation", "Region"]), "Nation", {"id": "entity_id", "name": "display_name"})


@query(f"WITH {sql_links(['nation_in', 'supplier_in'])} SELECT relationship_id, source_entity_id, target_entity_id, CAST(NULL AS VARCHAR) AS evidence_id FROM rel WHERE relationship_type = 'nation_in'")
def edge_properties(spark, d):
    return Q.edge_view(relationships(spark, d, ["nation_in", "supplier_in"]).withColumn("evidence_id", F.lit(None).cast("string")), "nation_in")


@query("SELECT 'Region' AS kind, 'ent_region' AS \"table\", CAST(5 AS BIGINT) AS n UNION ALL SELECT 'Nation', 'ent_nation', 25 UNION ALL SELECT 'Nation>Region', 'rel_nation_region', 25 UNION ALL SELECT 'Supplier', 'ent_supplier', (SELECT count(*) FROM supplier) UNION ALL SELECT 'Supplier>Nation', 'rel_supplier_nation', (SELECT count(*) FROM supplier)")
def plan_names(spark, d):
    kinds = ["Region", "Nation", "Supplier"]
    plan = Y.build_plan(entities(spark, d, kinds), relationships(spark, d, ["nation_in", "supplier_in"]), kinds)
    rows = [(t.name, t.table, t.count) for t in plan.types] + [(f"{p.source}>{p.target}", p.table, p.count) for p in plan.pairs]
    return spark.createDataFrame(rows, "kind string, table string, n long")


@query(f"WITH {catalog.ENT} SELECT entity_type AS kind, entity_id, display_name FROM ent WHERE entity_type IN ('Region', 'Nation') UNION ALL SELECT 'edge', source_entity_id, target_entity_id FROM (WITH {sql_links(['nation_in'])} SELECT * FROM rel)")
def typed_tables(spark, d):
    kinds = ["Region", "Nation"]
    e, r = entities(spark, d, kinds), relationships(spark, d, ["nation_in"])
    t = Y.tables(e, r, Y.build_plan(e, r, kinds))
    nodes = [t[n].select(F.col("entity_type").alias("kind"), "entity_id", "display_name") for n in ("ent_region", "ent_nation")]
    return G.union([*nodes, t["rel_nation_region"].select(F.lit("edge").alias("kind"), F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("display_name"))])


# -- densification with edges that are there ------------------------------------------------------------------------------------


@query(f"WITH {WORDS} SELECT doc, s AS source_entity_id, t AS target_entity_id FROM best WHERE (doc + CAST(split_part(s, ':', 3) AS BIGINT)) % 2 != 0")
def links_beside_others(spark, d):
    found = D.symptom_edges(turns(spark, d, "Symptom", "Resolution"), no_edges(spark)).select("doc", "relationship_type", "source_entity_id", "target_entity_id")
    there = found.where((F.col("doc") + F.split("source_entity_id", ":")[2].cast("bigint")) % 2 == 0)
    return D.symptom_edges(turns(spark, d, "Symptom", "Resolution"), there).select("doc", "source_entity_id", "target_entity_id")


THREE = """pool AS (SELECT conv_id AS doc, turn AS pos, 't:' || conv_id || ':' || turn AS id, CASE WHEN role = 'user' THEN 'Symptom' WHEN turn % 4 = 1 THEN 'Cause' ELSE 'Resolution' END AS kind, {tok} AS ws FROM conversations WHERE role IN ('user', 'assistant')),
wd AS (SELECT doc, pos, id, kind, unnest(ws) AS w FROM pool), sz AS (SELECT doc, count(*) AS n FROM pool GROUP BY doc),
ok AS (SELECT doc, w FROM (SELECT doc, w, count(*) AS df FROM wd GROUP BY doc, w) JOIN sz USING (doc) WHERE df >= 2 AND df <= greatest(2, floor(0.4 * n))), keep AS (SELECT wd.* FROM wd JOIN ok USING (doc, w)),
best AS (SELECT * FROM (SELECT a.doc, a.pos AS sp, a.id AS s, b.id AS t, b.kind, row_number() OVER (PARTITION BY a.doc, a.pos, b.kind ORDER BY count(*) DESC, b.pos) AS r FROM keep a JOIN keep b ON a.doc = b.doc AND a.w = b.w AND a.kind = 'Symptom' AND b.kind != 'Symptom' GROUP BY a.doc, a.id, a.pos, b.id, b.pos, b.kind) WHERE r <= 3)""".format(tok=catalog.TOK.format(c="text"))


@query(f"WITH {THREE} SELECT doc, 'causes' AS relationship_type, t AS source_entity_id, s AS target_entity_id FROM best WHERE kind = 'Cause' UNION SELECT doc, 'resolved_by', s, t FROM best WHERE kind = 'Resolution' UNION SELECT a.doc, 'addressed_by', a.t, b.t FROM best a JOIN best b ON a.doc = b.doc AND a.sp = b.sp AND a.kind = 'Cause' AND b.kind = 'Resolution'")
def cause_links(spark, d):
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    kind = F.when(F.col("role") == "user", "Symptom").when(F.col("turn") % 4 == 1, "Cause").otherwise("Resolution")
    rows = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.concat_ws(":", F.lit("t"), "conv_id", "turn").alias("entity_id"), kind.alias("entity_type"), F.col("text").alias("display_name"))
    return D.symptom_edges(rows, no_edges(spark)).select("doc", "relationship_type", "source_entity_id", "target_entity_id").distinct()


# -- small functions ---------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, substr(regexp_replace(source || '/' || doc_id, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 40) || '_' || substr(sha256(source || '/' || doc_id), 1, 12) AS file_key FROM documents")
def file_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.file_key(F.concat_ws("/", "source", "doc_id")).alias("file_key"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN round(l_quantity / l_linenumber, 6) END AS x, CASE WHEN l_linenumber > 1 THEN 0.5 END AS y, CAST(CASE WHEN l_linenumber > 1 THEN 2 ELSE 0 END AS BIGINT) AS n FROM lineitem")
def polygon_points(spark, d):
    flat = F.array(F.col("l_quantity").cast("double"), F.lit(5.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flat.alias("flat"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).otherwise(0).cast("double").alias("w"), F.lit(10.0).alias("h"))
    p = T.normalized_points("flat", "w", "h")
    return rows.select("l_orderkey", "l_linenumber", F.get(F.get(p, F.lit(0)), F.lit(0)).alias("x"), F.get(F.get(p, F.lit(0)), F.lit(1)).alias("y"), F.size(p).cast("bigint").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE make_timestamp(2024, 1 + doc_id % 12, 5, 6, 7, 8) END AS at FROM documents")
def read_timestamps(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, "not a time").otherwise(F.concat(F.lit("2024-"), F.lpad(((F.col("doc_id") % 12) + 1).cast("string"), 2, "0"), F.lit("-05T06:07:08")))
    return table(spark, d, "documents").select("doc_id", T.parse_timestamp(text).alias("at"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest, sha256(trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g'))) AS stripped FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[<&]')")
def html_escapes(spark, d):
    docs = table(spark, d, "documents").where("text is not null and not text rlike '[<&]'")
    marked = F.concat(F.lit("<p class=x>"), T.escape_html("text"), F.lit("</p><!-- no --><script>no</script>"))
    return docs.select("doc_id", ids.content_hash(T.escape_html("text")).alias("digest"), ids.content_hash(T.strip_html(marked)).alias("stripped"))


@query("SELECT c_custkey, 'customer:' || c_custkey || '|' || lower(c_name) || CASE WHEN c_custkey % 2 = 0 THEN '|' || lower(c_mktsegment) ELSE '' END AS aliases FROM customer")
def alias_lists(spark, d):
    c = table(spark, d, "customer")
    aliases = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit(None), F.upper("c_name")))
    return c.select("c_custkey", F.array_join(T.search_aliases(F.concat(F.lit("customer:"), "c_custkey"), "c_name", aliases), "|").alias("aliases"))


def layout_results(spark, d) -> DataFrame:
    """Each order as a table of layout analysis: with urgent priority it has a header row."""
    cell = lambda r, c, text, kind: F.struct(F.lit(r).alias("row_index"), F.lit(c).alias("column_index"), text.alias("content"), kind.alias("kind"), F.array(F.struct(F.lit(3).alias("page_number"))).alias("bounding_regions"))
    head = F.when(F.col("o_orderpriority") == "1-URGENT", "columnHeader").otherwise("content")
    cells = F.array(cell(0, 0, F.lit("key"), head), cell(0, 1, F.lit("state"), head), cell(1, 0, F.col("o_orderkey").cast("string"), F.lit("content")), cell(1, 1, F.col("o_orderstatus"), F.lit("content")))
    return table(spark, d, "orders").select(F.concat(F.lit("src:"), "o_orderkey").alias("source_file_id"), F.array(F.struct(F.lit(2).alias("row_count"), F.lit(2).alias("column_count"), cells.alias("cells"))).alias("tables"))


@query("SELECT 'src:' || o_orderkey AS source_file_id, 'key' || chr(9) || 'state' || chr(10) || o_orderkey || chr(9) || o_orderstatus AS content, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Table: ' ELSE '' END || 'key | state' || chr(10) || o_orderkey || ' | ' || o_orderstatus AS embedding_text, 3 AS page_number FROM orders")
def layout_tables(spark, d):
    return L.table_chunks(layout_results(spark, d), F.lit("2024-01-01").cast("timestamp")).select("source_file_id", "content", "embedding_text", "page_number")
