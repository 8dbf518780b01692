import json

from loomgraph import cli


def test_documents_to_tables_and_gates(spark, tmp_path):
    at = "2026-06-24 12:00:00+00:00"
    entity = lambda i, k, n: {"entity_id": i, "entity_type": k, "display_name": n, "canonical_key": f"{k}:{n}".lower(), "aliases": [], "search_aliases": [n], "is_placeholder": False, "content_hash": "h", "created_at": at, "updated_at": at}
    rel = {"relationship_id": "r1", "relationship_type": "HAS_COMPONENT", "source_entity_id": "e1", "target_entity_id": "e2", "is_placeholder": False, "content_hash": "h", "created_at": at}
    doc = {"source_file_id": "s", "source_file": {"source_file_id": "s", "path": "p", "filename": "f", "source_type": "pdf", "content_hash": "h", "ingested_at": at}, "entities": [entity("e1", "DeviceModel", "Laptop 5"), entity("e2", "Component", "Battery"), entity("e3", "Component", "Fan"), entity("e2", "Component", "Battery")], "relationships": [rel]}
    src = tmp_path / "docs"
    src.mkdir()
    (src / "a_canonical.json").write_text(json.dumps(doc))
    (src / "domain.json").write_text("{}")
    out, extra = str(tmp_path / "parquet"), str(tmp_path / "added")
    assert cli.main(["densify", str(src), "--out", extra]) == 0
    assert cli.main(["compile-data", str(src), "--out", out, "--added", extra]) == 0
    assert spark.read.parquet(f"{out}/entities").count() == 3 and spark.read.parquet(f"{out}/source_files").count() == 1
    assert sorted(r[0] for r in spark.read.parquet(f"{out}/relationships").select("relationship_type").collect()) == ["HAS_COMPONENT", "has_component"]
    assert cli.main(["validate", out]) == 0
    assert cli.main(["compile-ontology", out, "--out", str(tmp_path / "ontology"), "--min-pair-count", "1"]) == 0
    assert cli.main(["compile-search", out, "--out", str(tmp_path / "search")]) == 0
    assert cli.main(["package", str(tmp_path), "--out", str(tmp_path / "pkg")]) == 0
    doc["relationships"][0]["target_entity_id"] = "nobody"
    (src / "a_canonical.json").write_text(json.dumps(doc))
    assert cli.main(["compile-data", str(src), "--out", str(tmp_path / "bad")]) == 5
    assert cli.main(["validate", str(tmp_path / "nothing")]) == 1


def test_enrich_with_a_model(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>Pump</h1><p>The pump has a seal.</p>")
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "stand_in_model.py").write_text("def answer(prompts):\n    import json\n    return [json.dumps({'entities': [{'label': 'Pump', 'type': 'Part'}, {'label': 'Seal', 'type': 'Part'}], 'relationships': [{'source': 'Pump', 'relation': 'has_part', 'target': 'Seal'}]}) for _ in prompts]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "stand_in_model.py"))
    assert cli.main(["enrich", str(tmp_path / "in"), "--out", str(tmp_path / "o"), "--model", "stand_in_model:answer"]) == 0
    assert spark.read.parquet(str(tmp_path / "o/parquet/entities")).count() == 2
    assert spark.read.parquet(str(tmp_path / "o/parquet/relationships")).count() == 1
    assert spark.read.parquet(str(tmp_path / "o/parquet/chunks")).count() > 0
