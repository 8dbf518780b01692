"""Operators of the graph library on small literal rows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import ids, text as T
from loomgraph.operators import canonicalize as K, compile as C, densify as D, gates as G, graph as Q, layout as L, search as S, typed as Y
from loomgraph.session import saver
from loomgraph.sources import files, profile, sinks
from loomgraph.streaming import incremental


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("kind, name, key", [("Device", "Surface (Pro) 9!", "device:surface-pro-9"), ("Part", "  A  B ", "part:a-b"), ("Part", "A\xa0 B\x85C\x1cD", "part:a-b-c-d"), ("T", "日本", "t:"), ("T", "- x", "t:--x")])
def test_canonical_key(spark, kind, name, key):
    assert one(spark, ids.canonical_key(F.lit(kind), F.lit(name))) == key


def test_ids_and_zero_as_missing(spark):
    a = one(spark, ids.element_id(F.lit("s"), F.lit("p"), F.lit(0), F.lit(0), F.lit("h" * 64)))
    b = one(spark, ids.element_id(F.lit("s"), F.lit("p"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("h" * 64)))
    assert a == b and a.startswith("elem:") and len(a) == 37
    assert one(spark, ids.big_int(F.lit("x"))) == ids.big_int_of("x")


def test_split_text(spark):
    cut = lambda t: one(spark, T.split_text(F.lit(t)))
    assert cut("") == [] and cut("abc") == ["abc"]
    assert [len(x) for x in cut("x" * 2500)] == [1000, 1000, 500]
    parts = cut("\n\n".join(["a" * 600, "b" * 300, "c" * 700]))
    assert [len(p) for p in parts] == [902, 700]


def test_schema_rules(spark):
    row = spark.createDataFrame([("a", "x")], "entity_id string, search_aliases string")
    with pytest.raises(ValueError, match="array"):
        schemas.conform(row, "entities")
    with pytest.raises(ValueError, match="not declared"):
        schemas.conform(spark.createDataFrame([(1,)], "nope int"), "entities")
    with pytest.raises(KeyError):
        schemas.schema("nope")


def ents(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, aliases array<string>, confidence double, description string, file_ord int, pos int")


def test_merge_entities(spark):
    rows = [("a", ["x", "x"], None, "", 0, 1), ("a", ["y", "x"], 0.4, "d", 1, 0), ("b", ["q", "q"], None, None, 0, 2)]
    out = {r["entity_id"]: r for r in C.merge_entities(ents(spark, rows)).collect()}
    assert out["a"]["aliases"] == ["x", "y"] and out["a"]["confidence"] == 0.4 and out["a"]["description"] == "d"
    assert out["b"]["aliases"] == ["q", "q"] and out["b"]["confidence"] is None
    again = C.merge_entities(ents(spark, rows).repartition(3))
    assert {r["entity_id"]: r for r in again.collect()} == out


def test_keep_first_keeps_null_keys(spark):
    rows = spark.createDataFrame([("k", 2, 0, 2), ("k", 1, 0, 1), (None, 3, 0, 3), (None, 4, 0, 4)], "k string, v int, file_ord int, pos int")
    assert sorted(r["v"] for r in C.keep_first(rows, "k").collect()) == [1, 3, 4]


def test_gates(spark):
    e = spark.createDataFrame([("a",), ("a",), ("b",)], "entity_id string")
    r = spark.createDataFrame([("r1", "a", "zz", None)], "relationship_id string, source_entity_id string, target_entity_id string, evidence_id string")
    bad = G.data_gates({"entities": e, "relationships": r, "evidence": spark.createDataFrame([], "evidence_id string")})
    assert sorted((x["rule"], x["key"]) for x in bad.collect()) == [("dangling_target_entity_id", "r1"), ("duplicate_entity_id", "a")]
    assert G.exit_code(bad) == 8
    text = spark.createDataFrame([("f", "api_key = abcdefgh1234"), ("g", "api_key = ${SECRET_NAME}")], "path string, text string")
    assert [x["key"] for x in G.secrets(text).collect()] == ["f"]


def doc(spark, rows):
    return spark.createDataFrame([("d", i, f"{t}:{n}", t, n) for i, (t, n) in enumerate(rows)], "doc string, pos int, entity_id string, entity_type string, display_name string")


def edges(spark, rows=()):
    return spark.createDataFrame([("d", *r) for r in rows], "doc string, relationship_type string, source_entity_id string, target_entity_id string")


def pairs(df):
    return {(r["relationship_type"], r["source_entity_id"], r["target_entity_id"]) for r in df.collect()}


def test_hub_edges_are_additive_and_idempotent(spark):
    e = doc(spark, [("DeviceModel", "Laptop 5"), ("DeviceModel", "model"), ("Component", "Battery"), ("Part", "X1"), ("Symptom", "Hot")])
    have = edges(spark, [("x", "DeviceModel:Laptop 5", "Component:Battery")])
    found = D.hub_edges(e, have)
    assert pairs(found) == {("has_part", "DeviceModel:Laptop 5", "Part:X1"), ("has_symptom", "DeviceModel:Laptop 5", "Symptom:Hot")}
    known = have.unionByName(found.select(*have.columns))
    assert D.hub_edges(e, known).count() == 0


def test_symptom_edges(spark):
    fill = [("Symptom", f"filler{i} nothing{i}") for i in range(8)]
    e = doc(spark, [("Cause", "thermal paste dried"), ("Symptom", "thermal shutdown"), ("Resolution", "apply thermal compound"), ("Cause", "leaking battery"), ("Symptom", "battery leaking fluid"), *fill])
    got = pairs(D.symptom_edges(e, edges(spark)))
    assert ("causes", "Cause:thermal paste dried", "Symptom:thermal shutdown") in got
    assert ("addressed_by", "Cause:thermal paste dried", "Resolution:apply thermal compound") in got
    assert not any("leaking" in a and "thermal" in b for _, a, b in got)
    with pytest.raises(ValueError):
        D.symptom_edges(e, edges(spark), least=0)


def test_steps_by_reading_order_and_umbrella(spark, tmp_path):
    e = doc(spark, [("Procedure", "Remove battery"), ("Step", "unscrew the cover"), ("Step", "lift out"), ("Procedure", "Battery replacement")])
    el = spark.createDataFrame([("d", 0, 1, 0, "How to remove battery"), ("d", 1, 1, 1, "First unscrew the cover"), ("d", 2, 1, 2, "then lift out")], "doc string, pos int, page_number int, sort_order int, content string")
    found = D.step_edges(e, edges(spark), el)
    assert pairs(found) == {("has_step", "Procedure:Remove battery", "Step:unscrew the cover"), ("has_step", "Procedure:Remove battery", "Step:lift out")}
    known = found.select("doc", "relationship_type", "source_entity_id", "target_entity_id")
    up = D.umbrella_edges(e, known)
    assert pairs(up) == {("has_step", "Procedure:Battery replacement", "Step:unscrew the cover"), ("has_step", "Procedure:Battery replacement", "Step:lift out")}
    every = D.densify(e, edges(spark), el, save=saver(spark, str(tmp_path)))
    assert pairs(found) | pairs(up) <= pairs(every)
    assert D.added(every, F.lit("2020-01-01").cast("timestamp")).where("relationship_id like 'rel:%'").count() == every.count()


def test_reading_order_gap_and_cap(spark):
    placed = spark.createDataFrame([("d", 0, "p", "Procedure", 0), ("d", 1, "s1", "Step", 40), ("d", 2, "s2", "Step", 41), ("d", 3, "s3", "Step", 0)], "doc string, pos int, entity_id string, entity_type string, at int")
    assert {t for _, _, t in pairs(D.attach_steps(placed, edges(spark)))} == {"s1", "s3"}
    assert {t for _, _, t in pairs(D.attach_steps(placed, edges(spark), cap=1))} == {"s3"}


def test_plan_names_are_unique(spark):
    e = spark.createDataFrame([(x, k) for x, k in (("p", "Procedure"), ("s", "Step"), ("c", "Component"))], "entity_id string, entity_type string").withColumns({"display_name": F.col("entity_id"), "canonical_key": F.col("entity_id")})
    r = spark.createDataFrame([("r1", "HAS_STEP", "p", "s"), ("r2", "has_step", "p", "c"), ("r3", "", "c", "s")], "relationship_id string, relationship_type string, source_entity_id string, target_entity_id string")
    plan = Y.build_plan(e, r, min_pair_count=1)
    assert [t.name for t in plan.types] == ["Component", "Procedure", "Step"]
    assert sorted(p.name for p in plan.pairs) == ["has_step", "has_step_procedure_component", "related_to"]
    assert Y.build_plan(e, r, min_pair_count=2).pairs == []
    assert Y.tables(e, r, plan)["rel_procedure_step"].count() == 1
    assert len(Y.parts(plan)) == 1 + 2 * 3 + 2 * 3 and "has_step" in Y.grounding(plan)


def test_traversal_and_evidence(spark):
    e = spark.createDataFrame([("a", "M", "A"), ("b", "C", "B"), ("c", "C", "C")], "entity_id string, entity_type string, display_name string")
    r = spark.createDataFrame([("x", "a", "b", 0.5), ("x", "b", "c", 0.5), ("y", "a", "c", 0.1)], "relationship_type string, source_entity_id string, target_entity_id string, confidence double")
    got = {(x["id"], x["hops"]): x["score"] for x in Q.traverse(r, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert got == {("a", 0): 1.0, ("b", 1): 0.5, ("c", 1): 0.1}
    path = Q.path_text(Q.traverse(r, spark.createDataFrame([("a",)], "id string"), 1), e)
    assert 'M "A" --[x]--> C "B"' in {x["path"] for x in path.collect()}


def test_search_and_budget(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple apple"), (3, "pear")], "doc_id int, text string")
    q = spark.createDataFrame([(0, "apple")], "query_id int, query string")
    assert [r["doc_id"] for r in S.bm25(docs, q).orderBy("rank").collect()] == [2, 1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id int, embedding array<double>")
    near = S.cosine(v, spark.createDataFrame([(0, [1.0, 0.1])], "query_id int, query array<double>"), k=2)
    assert [r["vec_id"] for r in near.orderBy("rank").collect()] == [1, 2]
    got = S.embed_texts(spark.createDataFrame([("h", "t"), ("h", "t")], "content_hash string, embedding_text string"), S.hash_embedder(4))
    assert got.count() == 1


def test_canonicalize(spark):
    payload = json.dumps({"entities": [{"name": "Pump", "entity_type": "Part", "id_hint": "p1", "aliases": ["P"]}, {"label": "pump", "type": "Part", "confidence": 0.9}, {"type": "Part"}, {"label": "x", "confidence": 1.5}], "relationships": [{"from": "p1", "type": "has_part", "to": "PUMP"}, {"source": "p1", "relation": "r", "target": "nobody"}], "chunks": [{"content": "c"}, {"content": "t", "chunk_type": "table_row"}], "evidence": [{"text": "e", "row_index": 0}]})
    docs = spark.createDataFrame([("s", payload)], "source_file_id string, payload string")
    good, dropped = K.valid_entities(docs)
    assert good.count() == 2 and dropped.first()["dropped"] == 2
    merged = K.merged_entities(good).collect()
    assert len(merged) == 1 and merged[0]["confidence"] == 0.9 and merged[0]["display_name"] == "Pump"
    rel = K.resolved_relations(K.valid_relations(docs)[0], good).collect()
    assert [r["relationship_type"] for r in rel] == ["has_part"] and rel[0]["source_entity_id"] == rel[0]["target_entity_id"]
    assert K.chunk_items(docs).count() == 1 and K.evidence_items(docs).first()["source_type"] == "document_span"


def test_layout(spark):
    result = {"source_file_id": "s", "pages": [{"page_number": 1, "width": 10.0, "height": 20.0, "unit": "inch"}], "paragraphs": [{"content": "p", "role": None, "bounding_regions": [{"page_number": 1, "polygon": [1.0, 2.0, 5.0, 10.0, 9.0]}]}], "figures": [{"id": None, "caption": {"content": "f"}, "bounding_regions": [{"page_number": 1, "polygon": [1.0, 1.0, 2.0, 3.0]}]}], "tables": [{"row_count": 2, "column_count": 2, "cells": [{"row_index": 0, "column_index": 0, "content": "H<", "kind": "columnHeader", "bounding_regions": []}, {"row_index": 1, "column_index": 1, "content": "v", "kind": None, "bounding_regions": [{"page_number": 1, "polygon": []}]}]}]}
    r = spark.createDataFrame([(json.dumps(result),)], "j string").select(F.from_json("j", L.SCHEMA).alias("x")).select("x.*")
    chunk = L.table_chunks(r, F.current_timestamp()).first()
    assert chunk["content"] == "H<\t\n\tv" and "<th>H&lt;</th>" in chunk["content_html"] and chunk["page_number"] == 1
    region = L.paragraph_regions(r).first()
    assert json.loads(region["normalized_polygon_json"]) == [[0.1, 0.1], [0.5, 0.5]]
    assert L.figures(r).first()["box"] == [72.0, 72.0, 144.0, 216.0]
    assert L.html_cells(spark.createDataFrame([("t", chunk["content_html"])], "document_element_id string, content_html string")).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name\n1;x\n\n2;y\n", encoding="utf-8")
    (tmp_path / "b.html").write_text("<h1>T</h1><p>one<p>two<table><tr><td>a<td>b</table><img src=i alt=z>", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>para</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {n}><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>')
    parsed = files.elements(files.binary_files(spark, str(tmp_path)))
    got = {}
    for r in parsed.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["element_type"], r["content"]))
    assert got["a.csv"] == [("table", "id, name"), ("table_row", "id=1; name=x"), ("table_row", "id=2; name=y")]
    assert [k for k, _ in got["b.html"]] == ["section", "paragraph", "paragraph", "table", "image_ref"]
    assert got["c.docx"] == [("section", "H"), ("paragraph", "para")]
    assert got["d.xlsx"] == [("table", "k"), ("table_row", "k=5")]
    with pytest.raises(ValueError):
        files.route("x.zip")
    src = files.source_rows(files.binary_files(spark, str(tmp_path)))
    el = files.element_rows(parsed, src)
    chunks = files.chunk_rows(el)
    assert el.count() == parsed.count() and chunks.where("chunk_type = 'table_row'").count() == 3
    assert profile.inventory(el).count() > 0


def test_profile(spark):
    df = spark.createDataFrame([("1", " a", "1.5"), ("-2", "a", ""), ("", "b", "2")], "x string, y string, z string").withColumn("o", F.monotonically_increasing_id())
    got = {r["name"]: r for r in profile.column_profile(df, "o").collect()}
    assert [got[c]["inferred_type"] for c in "xyz"] == ["integer", "string", "float"]
    assert got["x"]["null_count"] == 1 and got["y"]["unique_count"] == 2 and got["y"]["sample_values"] == ["a", "b"]


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"x": "${X:-1}", "y": 2}}')
    (tmp_path / "b.json").write_text('{"a": {"y": "${Y}"}}')
    assert files.load_config(str(tmp_path / "a.json"), str(tmp_path / "b.json"), env={"Y": "3"}) == {"a": {"x": "1", "y": "3"}}
    with pytest.raises(OSError):
        files.load_config(str(tmp_path / "b.json"), env={})


def test_sinks_round_trip(spark, tmp_path):
    row = sinks.placeholder(spark, "entities")
    sinks.write_table(row, "entities", str(tmp_path))
    assert sinks.read_table(spark, "entities", str(tmp_path)).count() == 1
    assert sinks.read_table(spark, "chunks", str(tmp_path)).count() == 0
    with pytest.raises(sinks.NotNullError):
        sinks.write_table(row.withColumn("entity_type", F.lit(None).cast("string")), "entities", str(tmp_path))


def test_guarded_compile(spark):
    rows = sinks.placeholder(spark, "entities").withColumns({"file_ord": F.lit(0), "pos": F.lit(0)})
    assert C.guarded_compile({"entities": rows.unionByName(rows)}, lambda t: G.data_gates(t))["entities"].count() == 1


def test_incremental(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(r, "id string, content_hash string")
    rows(("a", "1"), ("b", "1")).write.parquet(src)
    for _ in range(2):
        incremental.start(spark, src, "id string, content_hash string", out, str(tmp_path / "cp"), "id").awaitTermination(60)
    rows(("a", "2"), ("b", "1")).write.mode("append").parquet(src)
    incremental.start(spark, src, "id string, content_hash string", out, str(tmp_path / "cp"), "id").awaitTermination(60)
    assert sorted(tuple(r) for r in incremental.current(spark, out, "id").select("id", "content_hash").collect()) == [("a", "2"), ("b", "1")]


def test_umbrella_pairs_are_written_as_they_are_made_and_known_ones_not_added(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7, raising=False)
    monkeypatch.setattr(D, "WHOLE", 64, raising=False)
    names = ["battery swap", "fan swap battery", "fan", "cover"]
    rows = [("d", i, f"u{i}", "Procedure", f"{names[i % 4]} process") for i in range(400)] + [("d", 1000 + i, f"f{i}", "Procedure", names[i % 3]) for i in range(400)]
    e = spark.createDataFrame(rows, "doc string, pos int, entity_id string, entity_type string, display_name string")
    have = [("d", "has_step", f"f{i}", f"s{i // 2}") for i in range(400)] + [("d", "see", "u0", "s0"), ("d", "see", "u1", "s1"), ("d", "has_step", "u4", "own")]
    r = spark.createDataFrame(have, "doc string, relationship_type string, source_entity_id string, target_entity_id string")
    words = {f"u{i}": set(names[i % 4].split()) for i in range(400) if i != 4}
    of = {}
    for i in range(400):
        of.setdefault(f"s{i // 2}", set()).update(names[i % 3].split())
    want = {("has_step", u, s) for u, a in words.items() for s, b in of.items() if a & b} - {("has_step", "u0", "s0"), ("has_step", "u1", "s1")}
    found = D.umbrella_edges(e, r)
    got = [(x.relationship_type, x.source_entity_id, x.target_entity_id) for x in found.collect()]
    assert set(got) == want and len(got) == len(want) > 50_000
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]  # what is done with pairs
    assert "Aggregate" not in above and "Join" not in above
