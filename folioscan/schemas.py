"""JSON schemas of canonical documents and chunks, and validation against them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscan.config import TYPE_PRIOR
from folioscan.functions.json_schema import broken_fields, broken_rules

_TEXT = {"type": "string"}
# Kinds of entries that a document may hint at, and how chunks are split.
HINTS = ("spell_entry", "feat_entry", "skill_entry", "condition_entry", "class_feature", "glossary_entry")
SPLITS = ("structure_cut", "paragraph_group")
# Kinds and authority of sources.
SOURCE_TYPES = ("core_rulebook", "supplement_rulebook", "errata_document", "faq_document", "srd", "curated_commentary", "personal_note")
AUTHORITY_LEVELS = ("official", "official_reference", "curated_secondary", "personal_note")
COMMON = "common.schema.json"


def _object(required: list[str], **properties) -> dict:
    return {"type": "object", "required": required, "additionalProperties": False, "properties": properties}


def common(source_types=SOURCE_TYPES, authority_levels=AUTHORITY_LEVELS) -> dict:
    """What documents and chunks share: a locator holds one field at least."""
    locator = _object(
        [],
        section_path={"type": "array", "items": _TEXT, "minItems": 1}, entry_id=_TEXT, entry_title=_TEXT, source_location=_TEXT,
        page_range=_object(["start", "end"], start={"type": "integer", "minimum": 1}, end={"type": "integer", "minimum": 1}),
    )
    ref = _object(
        ["source_id", "title", "edition", "source_type", "authority_level"],
        source_id={"type": "string", "pattern": "^[a-z0-9_]+$"}, title=_TEXT, edition=_TEXT,
        source_type={"type": "string", "enum": list(source_types)}, authority_level={"type": "string", "enum": list(authority_levels)},
    )
    return {"$defs": {"sourceRef": ref, "locator": locator | {"minProperties": 1}}}


def _parts() -> dict:
    return {"source_ref": {"$ref": f"./{COMMON}#/$defs/sourceRef"}, "locator": {"$ref": f"./{COMMON}#/$defs/locator"}}


def canonical(hints=HINTS) -> dict:
    cut = _object(
        ["kind", "char_offset", "child_chunk_type"],
        kind={"enum": ["stat_block_end"]}, char_offset={"type": "integer", "minimum": 0}, child_chunk_type={"enum": ["stat_block"]},
    )
    return _object(
        ["document_id", "source_ref", "locator", "content"],
        document_id=_TEXT, **_parts(), content=_TEXT, document_title=_TEXT, source_checksum=_TEXT, source_version=_TEXT,
        ingested_at={"type": "string", "format": "date-time"},
        processing_hints=_object([], chunk_type_hint={"type": "string", "enum": list(hints)}, structure_cuts={"type": "array", "items": cut}),
    )


def chunk() -> dict:
    """Of a chunk; one that was split off has a parent."""
    made = _object(
        ["chunk_id", "document_id", "source_ref", "locator", "chunk_type", "content"],
        chunk_id=_TEXT, document_id=_TEXT, **_parts(), chunk_type={"type": "string", "enum": list(TYPE_PRIOR)}, content=_TEXT,
        parent_chunk_id=_TEXT, previous_chunk_id=_TEXT, next_chunk_id=_TEXT, chunk_version=_TEXT, split_origin={"type": "string", "enum": list(SPLITS)},
    )
    return made | {"if": {"required": ["split_origin"]}, "then": {"required": ["parent_chunk_id"]}}


def read(path: str) -> tuple[dict, dict[str, dict]]:
    """A schema file, and the other schema files of its folder for its references."""
    files = {p.name: json.loads(p.read_text(encoding="utf-8")) for p in Path(path).parent.glob("*.json")}
    return files.pop(Path(path).name), files


def broken(rows: DataFrame, key: str, value: str, schema: dict, store: dict[str, dict] | None = None) -> DataFrame:
    """rows: a key and a column of JSON texts, or of records in place of the texts
    that they make.  key and broken (`path: word`, in order) of those that break the
    schema.  Rows are chosen by explode: a filter would compute all rules once more."""
    kind = rows.schema[value].dataType
    told = broken_fields(schema, F.col(value), kind, store) if isinstance(kind, StructType) else broken_rules(schema, F.col(value), store)
    some = F.filter(F.array(F.array_sort(F.array_distinct(told))), lambda b: F.size(b) > 0)
    return rows.select(key, F.explode(some).alias("broken"))


def nested(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows with a column record, of the columns in names (column to field) and
    of source_ref and locator, which take the columns of the source and of the
    place, and a column json, the same as text.  Nulls are left out of the text."""
    some = lambda *cols: F.struct(*[F.col(c).alias(n) for c, n in cols if c in rows.columns])
    ref = some(*[(c, c) for c in ("source_id", "edition", "source_type", "authority_level")], ("source_title", "title"))
    place = some(("section_path", "section_path"), ("source_location", "source_location"), ("entry_title", "entry_title"))
    fields = [F.col(c).alias(n) for c, n in names.items() if c in rows.columns]
    record = F.struct(*fields, ref.alias("source_ref"), place.alias("locator"))
    return rows.withColumn("record", record).withColumn("json", F.to_json("record"))


CHUNK_FIELDS = {c: c for c in ("chunk_id", "document_id", "chunk_type", "content", "parent_chunk_id", "previous_chunk_id", "next_chunk_id", "chunk_version", "split_origin")}


def broken_chunks(chunks: DataFrame, schema: dict | None = None, store: dict[str, dict] | None = None) -> DataFrame:
    """chunk_id and broken of chunks that break the schema (of this module, if none)."""
    return broken(nested(chunks, CHUNK_FIELDS), "chunk_id", "record", schema or chunk(), store if store is not None else {COMMON: common()})


DOCUMENT_FIELDS = {c: c for c in ("document_id", "content", "document_title", "source_checksum", "source_version", "ingested_at", "processing_hints")}


def nested_documents(docs: DataFrame) -> DataFrame:
    """Canonical documents, as ingest makes them, with record and json."""
    cuts = F.transform(
        "cuts", lambda c: F.struct(F.lit("stat_block_end").alias("kind"), c["offset"].alias("char_offset"), c["type"].alias("child_chunk_type"))
    )
    hints = F.struct(F.col("chunk_type_hint"), F.when(F.size("cuts") > 0, cuts).alias("structure_cuts"))
    hinted = docs.withColumn("processing_hints", F.when(F.col("chunk_type_hint").isNotNull(), hints))
    return nested(hinted, DOCUMENT_FIELDS)


def broken_documents(docs: DataFrame, schema: dict | None = None, store: dict[str, dict] | None = None) -> DataFrame:
    """document_id and broken of canonical documents."""
    return broken(nested_documents(docs), "document_id", "record", schema or canonical(), store if store is not None else {COMMON: common()})
