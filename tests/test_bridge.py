import copy

from loomgraph.operators import bridge


def kind(name, properties, columns, module=None):
    return {"name": name, "module": module, "properties": [{"name": p, "type": "blob_url" if p == "blob_url" else "string"} for p in properties], "dataBinding": {"entityIdColumn": columns[0], "additionalColumns": [{"column": c} for c in columns[1:]]}}


GOOD = {
    "entityTypes": [
        kind("DocumentChunk", ["entity_id", "chunk_id", "related_entity_ids", "entity_search_keys"], ["chunk_id", "related_entity_ids", "entity_search_keys"]),
        kind("SearchIndexRecord", ["search_record_id"], ["chunk_id"]), kind("ImageAsset", ["blob_url"], ["image_id", "blob_url"]), kind("Figure", ["blob_url"], ["image_id", "blob_url"]),
        kind("Component", ["entity_id", "canonical_key", "search_aliases"], ["entity_id"], "support-domain"),
    ],
    "relationshipTypes": [
        {"name": "evidenced_by", "sourceType": "Component", "targetType": "DocumentChunk", "inversePolicy": "none"}, {"name": "shown_in", "sourceType": "Component", "targetType": "Figure", "inversePolicy": "alias"},
        {"name": "indexed_as", "sourceType": "DocumentChunk", "targetType": "SearchIndexRecord", "inversePolicy": "none"},
    ],
}


def rules(change):
    model = copy.deepcopy(GOOD)
    change(model["entityTypes"], model["relationshipTypes"])
    return [(v["rule"], v["key"]) for v in bridge.violations(model)]


def test_a_good_model_passes():
    assert bridge.violations(GOOD) == [] and bridge.source_types(GOOD) == {"Component"}


def test_each_rule_is_found():
    assert rules(lambda t, r: t[0]["properties"].pop()) == [("BRG-001", "DocumentChunk.entity_search_keys")]
    assert rules(lambda t, r: t[1]["properties"].clear()) == [("BRG-002", "SearchIndexRecord.search_record_id"), ("BRG-006", "SearchIndexRecord.search_record_id")]
    assert rules(lambda t, r: t[4]["properties"].pop()) == [("BRG-003", "Component.search_aliases")]
    assert rules(lambda t, r: t[2]["properties"][0].update(type="string")) == [("BRG-004", "ImageAsset.blob_url")]
    assert rules(lambda t, r: t.pop(3)) == [("BRG-004", "Figure"), ("BRG-008", "Figure")]
    assert rules(lambda t, r: r[1].pop("inversePolicy")) == [("BRG-005", "shown_in")]
    assert rules(lambda t, r: r[0].update(targetType="Nothing")) == [("BRG-007", "Nothing")]
    assert rules(lambda t, r: t[4]["dataBinding"].update(entityIdColumn="")) == [("BRG-010", "Component")]
    assert rules(lambda t, r: r.clear()) == [("BRG-005", "evidenced_by"), ("BRG-005", "shown_in"), ("BRG-005", "indexed_as"), ("BRG-009", "Component")]
    assert [v["severity"] for v in bridge.violations({"entityTypes": [GOOD["entityTypes"][4]]}) if v["rule"] == "BRG-009"] == ["warn"]


def test_an_empty_model():
    assert {v["rule"] for v in bridge.violations({})} == {"BRG-001", "BRG-002", "BRG-004", "BRG-005"}
