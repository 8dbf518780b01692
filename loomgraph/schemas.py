"""The eight tables of the graph: schemas, keys and vocabularies.

A schema is written as `name type`, with `!` after a column that must not be null. Parquet loses that mark, so
`operators.compile.null_violations` checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

#: Column order, types and null marks of the tables.
DECLARED = {
    "source_files": "source_file_id! string, path! string, filename! string, source_type! string, content_hash! string, byte_size bigint, ingested_at! timestamp, schema_profile_path string, row_count bigint, notes string",
    "document_elements": "document_element_id! string, source_file_id! string, element_type! string, parent_element_id string, title string, content string, content_html string, blob_url string, page_number int, section_path string, sort_order int, row_index int, col_index int, content_hash! string, extracted_at! timestamp",
    "chunks": "chunk_id! string, source_file_id! string, document_element_id string, chunk_type! string, content! string, content_html string, embedding_text string, blob_url string, page_number int, section_path string, table_id string, figure_id string, image_id string, related_entity_ids array<string>, entity_search_keys array<string>, content_hash! string, created_at! timestamp",
    "entities": "entity_id! string, entity_type! string, display_name! string, canonical_key! string, aliases array<string>, search_aliases array<string>, description string, properties_json string, source_file_id string, confidence double, is_placeholder! boolean, content_hash! string, created_at! timestamp, updated_at! timestamp",
    "relationships": "relationship_id! string, relationship_type! string, source_entity_id! string, target_entity_id! string, evidence_id string, properties_json string, confidence double, is_placeholder! boolean, content_hash! string, created_at! timestamp",
    "evidence": "evidence_id! string, source_file_id! string, source_type! string, document_element_id string, chunk_id string, page_number int, section_path string, table_id string, row_index int, col_index int, figure_id string, image_id string, callout_id string, visual_region_id string, blob_url string, text string, content_hash! string, created_at! timestamp",
    "visual_assets": "image_id! string, source_file_id! string, document_element_id string, asset_type! string, page_number int, section_path string, caption string, alt_text string, blob_url string, image_path string, image_hash! string, width int, height int, description string, confidence double, is_placeholder! boolean, created_at! timestamp",
    "visual_regions": "visual_region_id! string, image_id! string, region_type! string, label string, text string, polygon_json string, normalized_polygon_json string, identified_entity_id string, blob_url string, confidence double, created_at! timestamp",
}
KEYS = {"source_files": "source_file_id", "document_elements": "document_element_id", "chunks": "chunk_id", "entities": "entity_id", "relationships": "relationship_id", "evidence": "evidence_id", "visual_assets": "image_id", "visual_regions": "visual_region_id"}
#: Foreign keys: (child, column, parent).
FOREIGN = [
    ("document_elements", "source_file_id", "source_files"), ("document_elements", "parent_element_id", "document_elements"),
    ("chunks", "source_file_id", "source_files"), ("chunks", "document_element_id", "document_elements"), ("chunks", "image_id", "visual_assets"),
    ("entities", "source_file_id", "source_files"),
    ("relationships", "source_entity_id", "entities"), ("relationships", "target_entity_id", "entities"), ("relationships", "evidence_id", "evidence"),
    ("evidence", "source_file_id", "source_files"), ("evidence", "document_element_id", "document_elements"), ("evidence", "chunk_id", "chunks"),
    ("evidence", "image_id", "visual_assets"), ("evidence", "visual_region_id", "visual_regions"), ("evidence", "callout_id", "visual_regions"),
    ("visual_assets", "source_file_id", "source_files"), ("visual_assets", "document_element_id", "document_elements"),
    ("visual_regions", "image_id", "visual_assets"), ("visual_regions", "identified_entity_id", "entities"),
]
CHUNK_TYPES = ["section_text", "procedure_step", "table_html", "table_row", "figure_caption", "image_description", "ocr_text", "warning", "note", "raw_page_text"]
ASSET_TYPES = ["figure", "inline_image", "screenshot", "diagram", "photo", "chart", "table_image"]
REGION_TYPES = ["callout", "ocr_text", "component_region", "connector_region", "warning_region", "table_region"]
EVIDENCE_TYPES = ["csv_row", "document_span", "table_cell", "figure_callout", "image_region", "ocr_text", "chunk"]


def required(name: str) -> list[str]:
    return [c.split()[0][:-1] for c in DECLARED[name].split(", ") if c.split()[0].endswith("!")]


def schema(name: str) -> StructType:
    """The schema of a table; KeyError if there is none of that name."""
    must = set(required(name))
    plain = StructType.fromDDL(DECLARED[name].replace("!", ""))
    return StructType([StructField(f.name, f.dataType, f.name not in must) for f in plain])


def open_schema(name: str) -> StructType:
    """The schema without null marks, as Parquet gives it back."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema(name)])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], open_schema(name))


def conform(df: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """Columns in the declared order and types; missing nullable ones are null.

    A column that is not declared is an error if strict, else it is dropped. A scalar for an array column is an error (not a
    list of its characters).
    """
    want = open_schema(name)
    extra = set(df.columns) - set(want.fieldNames())
    if extra and strict:
        raise ValueError(f"{name}: columns not declared: {sorted(extra)}")
    out = []
    for f in want:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        have = df.schema[f.name].dataType
        if f.dataType.typeName() == "array" and have.typeName() not in ("array", "void"):
            raise ValueError(f"{name}.{f.name}: {have.simpleString()} where an array is declared")
        out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(out)
