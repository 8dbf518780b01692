"""Checks that a graph model can be walked from its nodes to search documents and images: the rules BRG-001 to BRG-010.

A model is a small document on the driver. Each rule demands that types or relationships exist, declare properties and bind
columns; what is lacking is a violation (rule, severity, table, key, message), as of the other gates.
"""

from __future__ import annotations

from collections.abc import Iterator

#: What the rules demand of types by name: (rule, type, properties, bound columns).
TYPES = [
    ("BRG-001", "DocumentChunk", ("entity_id", "chunk_id", "related_entity_ids", "entity_search_keys"), ("chunk_id", "entity_search_keys", "related_entity_ids")),
    ("BRG-002", "SearchIndexRecord", ("search_record_id",), ("chunk_id",)),
    ("BRG-004", "ImageAsset", ("blob_url",), ("blob_url",)),
    ("BRG-004", "Figure", ("blob_url",), ("blob_url",)),
]
#: The bridging relationships, and what the rules demand of their targets.
TARGETS = [("BRG-006", "indexed_as", "search_record_id", "chunk_id"), ("BRG-007", "evidenced_by", "chunk_id", "chunk_id"), ("BRG-008", "shown_in", "blob_url", "blob_url")]
BRIDGES = ("evidenced_by", "shown_in", "indexed_as")
#: The module whose types must be found by search, and their properties.
MODULE, FINDABLE = "support-domain", ("entity_id", "canonical_key", "search_aliases")
#: The keys of a binding that name columns.
COLUMN_KEYS = ("entityIdColumn", "displayNameColumn", "typeFilterColumn", "sourceEntityIdColumn", "targetEntityIdColumn", "relationshipIdColumn")


class Model:
    """Types and relationships of a model by name; of a name used twice the first counts."""

    def __init__(self, model: dict):
        self.types: dict[str, dict] = {}
        self.relations: dict[str, dict] = {}
        for t in model.get("entityTypes") or []:
            self.types.setdefault(t.get("name"), t)
        for r in model.get("relationshipTypes") or []:
            self.relations.setdefault(r.get("name"), r)
        self.findable = [t for t in model.get("entityTypes") or [] if t.get("module") == MODULE]
        self.bridged = {r.get("sourceType") for r in model.get("relationshipTypes") or [] if r.get("name") in ("evidenced_by", "shown_in")}

    @staticmethod
    def properties(kind: dict) -> dict[str, dict]:
        return {p["name"]: p for p in reversed(kind.get("properties") or [])}

    @staticmethod
    def columns(kind: dict) -> set[str]:
        binding = kind.get("dataBinding") or {}
        return {binding.get(k) for k in COLUMN_KEYS} | {m.get("column") for m in binding.get("additionalColumns") or []}

    def lacking(self, name: str, properties, columns) -> Iterator[tuple[str, str]]:
        """(key, message) for what a type of that name lacks."""
        kind = self.types.get(name)
        if kind is None:
            yield name, "no such type"
            return
        have, bound = self.properties(kind), self.columns(kind)
        yield from ((f"{name}.{p}", "property is missing") for p in properties if p not in have)
        yield from ((f"{name}.{c}", "column is not bound") for c in columns if c not in bound)


def violations(model: dict) -> list[dict]:
    """All violations of a model, in order of the rules; those of severity `fail` must stop a build."""
    m = Model(model)
    found: list[tuple[str, str, str, str]] = []

    def say(rule: str, pairs, severity: str = "fail") -> None:
        found.extend((rule, severity, key, message) for key, message in pairs)

    for rule, name, properties, columns in TYPES:
        say(rule, m.lacking(name, properties, columns))
        url = m.properties(m.types.get(name, {})).get("blob_url")
        if rule == "BRG-004" and url is not None and url.get("type") != "blob_url":
            say(rule, [(f"{name}.blob_url", f"type is {url.get('type')}, not blob_url")])
    for kind in m.findable:
        have = m.properties(kind)
        say("BRG-003", ((f"{kind['name']}.{p}", "property is missing") for p in FINDABLE if p not in have))
        if "entity_id" in have and not (kind.get("dataBinding") or {}).get("entityIdColumn"):
            say("BRG-010", [(kind["name"], "entity_id is bound to no column")])
    for name in BRIDGES:
        if name not in m.relations:
            say("BRG-005", [(name, "no such relationship")])
        elif "inversePolicy" not in m.relations[name]:
            say("BRG-005", [(name, "no inverse policy (it may be none)")])
    for rule, name, prop, column in TARGETS:
        target = m.relations.get(name, {}).get("targetType") or ""
        if name in m.relations and (target or rule != "BRG-008"):
            say(rule, m.lacking(target, [prop], [column]))
    say("BRG-009", ((n, "no evidenced_by or shown_in: search alone finds it") for n in sorted({k["name"] for k in m.findable} - m.bridged)), "warn")
    found.sort(key=lambda v: v[0])
    return [{"rule": r, "severity": s, "table": "model", "key": k, "message": t} for r, s, k, t in found]


def source_types(model: dict) -> set[str]:
    """The types that evidence or images can be reached from."""
    return Model(model).bridged - {None}
