"""Model output to rows: tolerant validation, merging within a batch, reference resolution, section batches, evidence.

Input documents are JSON text (source_file_id, payload) of one answer each; every step is a column expression or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids, text as T

DEFAULT_CONFIDENCE = 0.5
#: The names a field may have, best first.
ENTITY_FIELDS = {"id_hint": ["id_hint"], "type": ["type", "entity_type"], "label": ["label", "name"], "description": ["description"]}
RELATION_FIELDS = {"source": ["source_id_hint", "source", "source_id", "from", "from_id_hint"], "relation": ["relation", "type", "relation_type", "label"], "target": ["target_id_hint", "target", "target_id", "to", "to_id_hint"], "evidence": ["evidence_id_hint", "evidence_id"]}
COLLECTIONS = ["entities", "relationships", "chunks", "evidence", "visual_assets", "visual_regions"]


def items(docs: DataFrame, collection: str) -> DataFrame:
    """(source_file_id, pos, item): the items of a collection as JSON text."""
    # as text, so that an item of odd form does not spoil its list
    listed = F.from_json(F.get_json_object("payload", f"$.{collection}"), "array<string>")
    return docs.select("source_file_id", F.posexplode(listed).alias("pos", "item"))


def pick(item: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(item, f"$.{n}"), F.lit("")) for n in names])


def confidence(item: Column) -> Column:
    raw = F.get_json_object(item, "$.confidence")
    return F.when(raw.isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(raw.try_cast("double"))


def valid_entities(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid entity items as columns, and (source_file_id, dropped)."""
    rows = items(docs, "entities")
    item = F.col("item")
    out = rows.select("source_file_id", "pos", *[pick(item, v).alias(k) for k, v in ENTITY_FIELDS.items()], F.from_json(F.get_json_object(item, "$.aliases"), "array<string>").alias("aliases"), confidence(item).alias("confidence"))
    out = out.withColumn("type", F.coalesce("type", F.lit("Entity")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("confidence").between(0, 1), F.lit(False))
    return out.where(good), out.groupBy("source_file_id").agg(F.sum((~good).cast("long")).alias("dropped"))


def valid_relations(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = items(docs, "relationships")
    item = F.col("item")
    out = rows.select("source_file_id", "pos", *[pick(item, v).alias(k) for k, v in RELATION_FIELDS.items()], confidence(item).alias("confidence"))
    good = F.coalesce(F.col("source").isNotNull() & F.col("relation").isNotNull() & F.col("target").isNotNull() & F.col("confidence").between(0, 1), F.lit(False))
    return out.where(good), out.groupBy("source_file_id").agg(F.sum((~good).cast("long")).alias("dropped"))


def merged_entities(valid: DataFrame) -> DataFrame:
    """One row for each canonical key of a document: aliases in first-seen order, highest confidence, else the first row."""
    keyed = valid.withColumn("canonical_key", ids.canonical_key("type", "label"))
    lists = F.array_sort(F.collect_list(F.struct("pos", T.truthy_list("aliases").alias("a"))))
    out = keyed.groupBy("source_file_id", "canonical_key").agg(F.min_by(F.struct("type", "label", "description", "pos"), "pos").alias("f"), F.array_distinct(F.flatten(F.transform(lists, lambda x: x["a"]))).alias("aliases"), F.max("confidence").alias("confidence"))
    return out.select("source_file_id", ids.entity_id("canonical_key").alias("entity_id"), F.col("f.type").alias("entity_type"), F.col("f.label").alias("display_name"), "canonical_key", "aliases", F.col("f.description").alias("description"), "confidence", F.col("f.pos").alias("pos"))


def reference_map(valid: DataFrame) -> DataFrame:
    """(source_file_id, rank, ref, entity_id): hints (rank 0, exact), labels (1, lower case) and keys (2); the last writer holds."""
    keyed = valid.withColumn("canonical_key", ids.canonical_key("type", "label")).withColumn("entity_id", ids.entity_id("canonical_key"))
    refs = keyed.select("source_file_id", "pos", "entity_id", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("id_hint").alias("ref")), F.struct(F.lit(1).alias("rank"), F.lower(ids.strip("label")).alias("ref")), F.struct(F.lit(2).alias("rank"), F.col("canonical_key").alias("ref")))).alias("r"))
    return refs.where("r.ref is not null").groupBy("source_file_id", "r.rank", "r.ref").agg(F.max_by("entity_id", "pos").alias("entity_id"))


def resolved_relations(relations: DataFrame, valid: DataFrame) -> DataFrame:
    """Relationship rows with both ends resolved; the others go."""
    refs = reference_map(valid)
    out = relations
    for end in ("source", "target"):
        tries = F.array(F.struct(F.lit(0).alias("rank"), F.col(end).alias("ref")), F.struct(F.lit(1).alias("rank"), F.lower(ids.strip(end)).alias("ref")), F.struct(F.lit(2).alias("rank"), F.col(end).alias("ref")))
        asked = out.select("source_file_id", "pos", F.explode(tries).alias("t")).select("source_file_id", "pos", "t.rank", "t.ref")
        found = asked.join(refs, ["source_file_id", "rank", "ref"]).groupBy("source_file_id", "pos").agg(F.min_by("entity_id", "rank").alias(f"{end}_entity_id"))
        out = out.join(found, ["source_file_id", "pos"])
    return out.select("source_file_id", "pos", ids.relationship_id("relation", "source_entity_id", "target_entity_id").alias("relationship_id"), F.col("relation").alias("relationship_type"), "source_entity_id", "target_entity_id", "confidence")


def chunk_items(docs: DataFrame) -> DataFrame:
    """Chunk rows of the answers: empty ones and table rows go, the default type is raw_page_text."""
    item = F.col("item")
    out = items(docs, "chunks").select("source_file_id", "pos", F.coalesce(pick(item, ["chunk_type", "type"]), F.lit("raw_page_text")).alias("chunk_type"), pick(item, ["content", "text"]).alias("content"), F.get_json_object(item, "$.page_number").try_cast("int").alias("page_number"))
    out = out.where("content is not null and chunk_type != 'table_row'").withColumn("content_hash", ids.content_hash("content"))
    return out.withColumn("chunk_id", ids.chunk_id("source_file_id", "chunk_type", "content_hash"))


def evidence_items(docs: DataFrame) -> DataFrame:
    item = F.col("item")
    number = lambda n: F.get_json_object(item, f"$.{n}").try_cast("int").alias(n)
    out = items(docs, "evidence").select("source_file_id", "pos", F.coalesce(pick(item, ["source_type"]), F.lit("document_span")).alias("source_type"), number("row_index"), number("col_index"), number("page_number"), F.get_json_object(item, "$.text").alias("text"))
    context = ids.joined(ids.falsy("row_index"), ids.falsy("col_index"), ids.falsy("page_number"))
    out = out.withColumn("content_hash", ids.content_hash("text"))
    return out.withColumn("evidence_id", ids.evidence_id("source_file_id", "source_type", context, "content_hash"))


def section_batches(elements: DataFrame) -> DataFrame:
    """(source_file_id, section, first, text): the elements of a section as one prompt text, sections in first-seen order."""
    part = F.concat(F.lit("["), "element_type", F.lit("|"), F.coalesce("section_path", F.lit("")), F.lit("] "), "content")
    rows = elements.where(F.coalesce("content", F.lit("")) != "").withColumn("section", F.coalesce("section_path", F.lit("__root__")))
    return rows.groupBy("source_file_id", "section").agg(F.min("sort_order").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


def text_evidence(chunks: DataFrame, at) -> DataFrame:
    """One evidence row for each chunk."""
    context = ids.joined(F.col("document_element_id"), F.col("chunk_id"), ids.falsy("page_number"))
    kind = F.when(F.col("chunk_id").isNotNull(), "chunk").otherwise("document_span")
    hash_ = ids.content_hash("content")
    return chunks.select(ids.evidence_id("source_file_id", kind, context, hash_).alias("evidence_id"), "source_file_id", kind.alias("source_type"), "document_element_id", "chunk_id", "page_number", "section_path", "table_id", F.col("content").alias("text"), hash_.alias("content_hash"), at.alias("created_at"))


def visual_evidence(regions: DataFrame, at) -> DataFrame:
    """One evidence row for each region (image_id, source_file_id, visual_region_id, callout_id, page_number, text, blob_url)."""
    context = ids.joined(F.col("image_id"), F.col("visual_region_id"), F.col("callout_id"), ids.falsy("page_number"))
    kind = F.when(F.col("callout_id").isNotNull(), "figure_callout").otherwise("image_region")
    hash_ = ids.content_hash("text")
    return regions.select(ids.evidence_id("source_file_id", kind, context, hash_).alias("evidence_id"), "source_file_id", kind.alias("source_type"), "image_id", "visual_region_id", "callout_id", "page_number", "blob_url", "text", hash_.alias("content_hash"), at.alias("created_at"))


def batches_to_model(batches: DataFrame, complete) -> DataFrame:
    """(source_file_id, section, payload): complete(list of prompts) -> list of JSON texts, called on the executors.

    A paid call is repeated if a task is; write the result to a table before using it twice.
    """

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"source_file_id": f["source_file_id"], "section": f["section"], "payload": complete(f["text"].tolist())})

    return batches.select("source_file_id", "section", "text").mapInPandas(run, "source_file_id string, section string, payload string")


class InvalidPayload(ValueError):
    """A strict answer held an item that is not valid."""


def strict(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of answers, or InvalidPayload if any item is not valid."""
    entities, e = valid_entities(docs)
    relations, r = valid_relations(docs)
    bad = e.unionByName(r).where("dropped > 0").take(1)
    if bad:
        raise InvalidPayload(f"{bad[0]['source_file_id']}: {bad[0]['dropped']} items are not valid")
    return entities, relations


def prompts(batches: DataFrame, brief: str = "") -> DataFrame:
    """Section batches with their user message: the domain block, if there is a brief, then the source block."""
    domain = F.lit(f"## Domain\n{brief}\n\n") if brief else F.lit("")
    return batches.withColumn("text", F.concat(domain, F.lit("## Source "), "source_file_id", F.lit("\n"), "text"))


def domain_brief(given: dict, rephrase=None) -> dict:
    """A brief as given, with fields that a model's rephrasing adds; given fields win where the model leaves one out."""
    out = dict(rephrase(given)) if rephrase else {}
    return {**given, **{k: v for k, v in out.items() if v}}


def resolve_brief(path: str | None = None, existing: dict | None = None, prompt: str | None = None) -> dict | None:
    """The brief of a file, else the existing one, else of a prompt, else none."""
    import json

    if path:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    return existing or ({"brief": prompt} if prompt else None)
