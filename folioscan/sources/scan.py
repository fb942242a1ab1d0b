"""Readers of files, and the driver's side of fetching them."""

from __future__ import annotations

import hashlib
import io
import json
import os
import shutil
import stat
import urllib.request
import zipfile
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.config import EntryType

SOURCE_REF = "struct<source_id:string,title:string,edition:string,source_type:string,authority_level:string>"
LOCATOR = (
    "struct<section_path:array<string>,entry_id:string,entry_title:string,"
    "page_range:struct<start:int,end:int>,source_location:string>"
)
CANONICAL = (
    f"document_id string, source_ref {SOURCE_REF}, locator {LOCATOR}, content string, document_title string, "
    "source_checksum string, source_version string, ingested_at string, processing_hints struct<"
    "chunk_type_hint:string,structure_cuts:array<struct<kind:string,char_offset:int,child_chunk_type:string>>>"
)
CHUNK = (
    f"chunk_id string, document_id string, source_ref {SOURCE_REF}, locator {LOCATOR}, chunk_type string, content string, "
    "parent_chunk_id string, previous_chunk_id string, next_chunk_id string, chunk_version string, split_origin string"
)
GOLD = (
    "eval_id string, question string, question_type string, expected_source_ids array<string>, "
    "expected_section_or_entry array<string>, expected_behavior string, expected_answer_notes string"
)


def _rich_files(raw: DataFrame) -> DataFrame:
    """Rows of binary files (or of archive members) as texts."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return raw.select(
        F.col("path").alias("file"),
        name.alias("file_name"),
        F.regexp_replace(name, r"\.rtf$", "").alias("file_stem"),
        F.decode("content", "ISO-8859-1").alias("content"),
        F.sha1("content").alias("sha1"),
    )


def read_rich_text(spark: SparkSession, root: str, limit: int | None = None, archives: bool = False) -> DataFrame:
    """The *.rtf files of a folder: file, file_name, file_stem, content, sha1; the
    first `limit` by name.  With archives those in its *.zip files too, as
    archive!/member."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.rtf").load(root).select("path", "content")
    if archives:
        raw = raw.unionByName(members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root)).filter("path like '%.rtf'"))
    files = _rich_files(raw)
    return files if limit is None else files.orderBy("file_name", "file").limit(limit)


def rich_text_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream: each *.rtf file that comes to the folder, once."""
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.rtf")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    kinds = "path string, modificationTime timestamp, length long, content binary"
    return _rich_files(source.schema(kinds).load(root))


def members(archives: DataFrame) -> DataFrame:
    """archives: path and content of zip files.  path (archive!/member) and content
    of each file in them; an archive that is empty or has a member that is unsafe
    to unpack is an error, as it is for unzip.  One archive is read in one task."""

    def of(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for path, content in zip(paths, contents, strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                out.append([{"path": f"{path}!/{m.filename}", "content": z.read(m)} for m in safe_members(z, path)])
        return pd.Series(out, dtype=object)

    of.__annotations__ = {"paths": pd.Series, "contents": pd.Series, "return": pd.Series}
    found = F.pandas_udf(of, "array<struct<path:string,content:binary>>")("path", "content")
    return archives.select(F.explode(found).alias("m")).select("m.path", "m.content")


def _json(spark: SparkSession, path: str, schema: str, without: tuple[str, ...], required: tuple[str, ...]) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    kept = rows.filter(~F.col("_metadata.file_name").isin(*without))
    # a file without one of these is an error, as any other broken file
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    told = F.concat(F.lit("missing "), F.array_join(F.array(*missing), ", "), F.lit(" in "), F.col("_metadata.file_path"))
    whole = F.size(F.array_compact(F.array(*missing))) == 0
    return kept.filter(F.when(whole, True).otherwise(F.raise_error(told).cast("boolean")))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents, one JSON file each, of one source only."""
    rows = _json(spark, path, CANONICAL, ("canonical_report.json",), ("document_id", "source_ref", "locator", "content"))
    if rows.select("source_ref.source_id").distinct().limit(2).count() > 1:
        raise ValueError("documents of more than one source")
    return rows


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, CHUNK, ("chunk_report.json",), ("chunk_id", "document_id", "source_ref", "locator", "content"))


def as_documents(canonical: DataFrame) -> DataFrame:
    """Nested canonical documents as the columns that chunking reads."""
    cuts = F.transform(
        "processing_hints.structure_cuts",
        lambda c: F.struct(c["char_offset"].alias("offset"), c["child_chunk_type"].alias("type")),
    )
    return canonical.select(
        "document_id", "source_ref.source_id", "source_ref.edition", "source_ref.source_type", "source_ref.authority_level",
        "locator.section_path", "locator.source_location", "locator.entry_title", "document_title", "content",
        F.when(F.col("processing_hints").isNotNull(), F.coalesce("processing_hints.chunk_type_hint", F.lit("subsection"))).alias("chunk_type_hint"),
        F.coalesce(cuts, F.array().cast("array<struct<offset:int,type:string>>")).alias("cuts"),
    )


def as_chunks(nested: DataFrame) -> DataFrame:
    """Nested chunk files as the columns of an index."""
    number = F.coalesce(F.nullif(F.regexp_extract("chunk_id", r"child_(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return nested.select(
        "chunk_id", "document_id", "source_ref.source_id", "source_ref.edition", "source_ref.source_type",
        "source_ref.authority_level", "locator.section_path", "locator.entry_title", "chunk_type", "content", "parent_chunk_id",
        "previous_chunk_id", "next_chunk_id", "chunk_version", "split_origin", number.alias("child_no"),
    )


def read_yaml(path: str) -> dict | list:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; use JSON settings instead") from e
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def read_settings(path: str) -> dict:
    """A settings file, JSON or YAML, that holds a mapping."""
    data = json.loads(Path(path).read_text(encoding="utf-8")) if path.endswith(".json") else read_yaml(path)
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a mapping is wanted")
    return data


def read_registry(path: str) -> list[dict]:
    data = json.loads(Path(path).read_text(encoding="utf-8")) if path.endswith(".json") else read_yaml(path)
    if not isinstance(data, dict) or not isinstance(data.get("sources", []), list):
        raise ValueError(f"{path}: a mapping with a list `sources` is wanted")
    return data.get("sources", [])


def read_content_types(path: str) -> list[EntryType]:
    """The entry types of a content-type registry, in its order."""
    data = json.loads(Path(path).read_text(encoding="utf-8")) if path.endswith(".json") else read_yaml(path)
    if not isinstance(data, dict) or not isinstance(data.get("content_types"), list):
        raise ValueError(f"{path}: a mapping with a list `content_types` is wanted")
    return [EntryType.of(entry) for entry in data["content_types"]]


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases: a list of mappings, each with all seven fields."""
    data = json.loads(Path(path).read_text(encoding="utf-8")) if path.endswith(".json") else read_yaml(path)
    names = [f.split()[0] for f in GOLD.split(", ")]
    for i, case in enumerate(data):
        if not isinstance(case, dict) or (missing := [n for n in names if n not in case]):
            raise ValueError(f"case {i}: {'not a mapping' if not isinstance(case, dict) else f'missing {missing}'}")
    return spark.createDataFrame([tuple(case[n] for n in names) for case in data], GOLD)


# --- fetching (driver only) ----------------------------------------------------


def inside(root: str | Path, relative: str) -> Path:
    base = Path(root).resolve()
    path = (base / relative).resolve()
    if not path.is_relative_to(base):
        raise ValueError(f"{relative} leaves {base}")
    return path


def digest(path: str | Path, algorithm: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, algorithm).hexdigest()


def verify(path: str | Path, wanted: dict[str, str]) -> dict[str, str]:
    found = {name: digest(path, name) for name in wanted}
    if bad := [n for n in wanted if wanted[n].lower() != found[n]]:
        raise ValueError(f"checksum of {path} differs: {', '.join(bad)}")
    return found


def safe_members(z: zipfile.ZipFile, name: str | Path) -> list[zipfile.ZipInfo]:
    """The files of an archive, none of them a link or outside of its folder."""
    found = [m for m in z.infolist() if not m.is_dir()]
    if not found:
        raise ValueError(f"{name} is empty")
    for m in found:
        parts = PurePosixPath(m.filename)
        if stat.S_ISLNK(m.external_attr >> 16) or parts.is_absolute() or ".." in parts.parts:
            raise ValueError(f"unsafe member {m.filename}")
    return found


def unzip(archive: str | Path, root: str | Path) -> list[str]:
    """Extracts an archive whose members all stay inside root and are no links."""
    base = Path(root).resolve()
    with zipfile.ZipFile(archive) as z:
        members = safe_members(z, archive)
        if out := [m.filename for m in members if not (base / m.filename).resolve().is_relative_to(base)]:
            raise ValueError(f"unsafe member {out[0]}")
        z.extractall(base)
    return sorted(m.filename for m in members)


def fetch(manifest: dict, root: str, dry_run: bool = False, force: bool = False, timeout: int = 300) -> dict:
    """Downloads, verifies and unpacks a source; returns its provenance."""
    artifact, layout = manifest["artifact"], manifest["local_layout"]
    raw, expanded = inside(root, layout["raw_root"]), inside(root, layout["expanded_root"])
    target = raw / artifact["file_name"]
    plan = {"source_id": manifest["source_id"], "url": artifact["url"], "archive": str(target), "expanded": str(expanded)}
    if dry_run:
        return plan
    if force and expanded.exists():
        if expanded == Path(root).resolve() or expanded in raw.parents or not expanded.is_dir():
            raise ValueError(f"{expanded} is no folder of its own to delete")
        shutil.rmtree(expanded)
    raw.mkdir(parents=True, exist_ok=True)
    if force or not target.exists():
        part = target.with_name(target.name + ".download")
        with urllib.request.urlopen(artifact["url"], timeout=timeout) as r, open(part, "wb") as f:  # noqa: S310
            shutil.copyfileobj(r, f)
        verify(part, artifact.get("checksums", {}))
        os.replace(part, target)
    sums = verify(target, artifact.get("checksums", {}))
    names = unzip(target, expanded)
    if (n := artifact.get("file_count")) is not None and n != len(names):
        raise ValueError(f"{len(names)} files in the archive, {n} expected")
    provenance = plan | {"checksums": sums, "files": names}
    (raw / "provenance.json").write_text(json.dumps(provenance, indent=2), encoding="utf-8")
    return provenance
