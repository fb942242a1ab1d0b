"""An index that grows by segments.

A commit writes a segment (the index tables of its chunks) and tombstones for the
chunks of older segments that it replaces or deletes, and then a manifest of the
next number: the state of the whole index.  A manifest is created in one step and
never overwritten, so readers always find a whole state, and a commit that is
repeated after a failure (the same stream and batch) changes nothing.  Of two
writers at once one fails where renaming replaces no file, as on HDFS; elsewhere
keep to one writer.  Merging rewrites segments of alike size as one without their
dead rows.

Defined results: a chunk that comes again replaces the one of its id; of several
rows of one id in a commit the greatest stays (as a row: its columns in order);
a null chunk_id is no chunk; an id that is not in the index is deleted without
effect; an id both given and deleted in a commit is replaced; an open index gives what an index built of the live chunks gives.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.sources import store

from . import index as I

#: Segments of alike size that are merged into one.
FANOUT = 4


def is_segmented(spark: SparkSession, root: str) -> bool:
    return bool(store.children(spark, f"{root}/MANIFESTS"))


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest state: segments (name, rows, length, dead: folders of tombstones)
    and the last batch of each stream."""
    found = store.children(spark, f"{root}/MANIFESTS")
    return json.loads(store.read_text(spark, f"{root}/MANIFESTS/{found[-1]}")) if found else {"number": 0, "segments": [], "batches": {}}


def _publish(spark: SparkSession, root: str, state: dict) -> dict:
    state = state | {"number": state["number"] + 1}
    store.create_text(spark, f"{root}/MANIFESTS/{state['number']:012d}", json.dumps(state))
    return state


def _read(spark: SparkSession, root: str, state: dict, table: str) -> DataFrame | None:
    """A table of all segments, with the segment's name."""
    parts = [
        spark.read.parquet(f"{root}/segments/{s['name']}/{table}").withColumn("segment", F.lit(s["name"])) for s in state["segments"]
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def _tombstones(spark: SparkSession, root: str, state: dict) -> DataFrame | None:
    """segment, chunk_id, length, freqs of what is dead."""
    parts = [
        spark.read.parquet(f"{root}/segments/{s['name']}/{d}").withColumn("segment", F.lit(s["name"])) for s in state["segments"] for d in s["dead"]
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _write_segment(spark: SparkSession, root: str, name: str, chunks: DataFrame) -> dict | None:
    made = I.build_index(chunks)
    sizes = made.sizes.first()
    if not sizes["n"]:
        return None
    for table, df in I.sorted_tables(made).items():
        df.write.parquet(f"{root}/segments/{name}/{table}")
    return {"name": name, "rows": sizes["n"], "length": sizes["total"], "dead": []}


def commit(
    spark: SparkSession, root: str, chunks: DataFrame | None = None, deleted: DataFrame | None = None, stream: str | None = None, batch: int = 0
) -> dict:
    """Adds or replaces chunks, deletes those of the ids in deleted (chunk_id), and
    returns the new state.  A stream's batch is committed once."""
    state = manifest(spark, root)
    if stream is not None and state["batches"].get(stream, -1) >= batch:
        return state
    name = f"{state['number'] + 1:012d}-{uuid.uuid4().hex[:12]}"
    made, gone = None, []
    if chunks is not None:
        I.check_chunks(chunks)
        one = F.max(F.struct(*chunks.columns)).alias("c")
        chunks = store.stored(chunks.filter("chunk_id is not null").groupBy(F.col("chunk_id").alias("__id")).agg(one).select("c.*"), "segment-chunks")
        made = _write_segment(spark, root, name, chunks)
        gone.append(chunks.select("chunk_id"))
    if deleted is not None:
        gone.append(deleted.select("chunk_id"))
    if gone and state["segments"]:
        _bury(spark, root, state, reduce(DataFrame.unionByName, gone).distinct(), name)
    if made:
        state["segments"].append(made)
    if stream is not None:
        state["batches"][stream] = batch
    return _publish(spark, root, state)


def _bury(spark: SparkSession, root: str, state: dict, ids: DataFrame, name: str) -> None:
    """Tombstones for the live rows of these ids, with their profiles, so that
    counts of terms are corrected without reading lists."""
    profiles, dead = _read(spark, root, state, "profiles"), _tombstones(spark, root, state)
    if dead is not None:
        profiles = profiles.join(dead, ["segment", "chunk_id"], "left_anti")
    ids = store.stored(ids, "buried-ids")
    hit = store.stored(profiles.join(ids, "chunk_id", "left_semi"), "buried")
    many = {r["segment"]: (r["n"], r["total"]) for r in hit.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).collect()}
    for s in state["segments"]:
        if s["name"] in many:
            path = f"dead-{name}"
            hit.filter(F.col("segment") == s["name"]).drop("segment").write.parquet(f"{root}/segments/{s['name']}/{path}")
            s["dead"].append(path)
            s["rows"], s["length"] = s["rows"] - many[s["name"]][0], s["length"] - many[s["name"]][1]


def open_segments(spark: SparkSession, root: str) -> I.Index:
    state = manifest(spark, root)
    if not state["segments"]:
        raise FileNotFoundError(f"no chunk is in the index under {root}")
    tables = {t: _read(spark, root, state, t) for t in I.TABLES}
    I.check_chunks(tables["chunks"])
    dead = _tombstones(spark, root, state)
    terms = tables["terms"].select("term", "df", "cf")
    if dead is not None:
        minus = I.term_counts(dead).select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
        terms = terms.unionByName(minus)
    terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
    n, total = (sum(s[k] for s in state["segments"]) for k in ("rows", "length"))
    sizes = spark.createDataFrame([(n, total)], "n long, total long")
    if dead is None:
        # nothing to leave out: plain tables
        plain = {t: tables[t].drop("segment") for t in ("chunks", "postings", "profiles", "blocks")}
        return I.Index(**plain, terms=terms, sizes=sizes)
    return I.Index(
        tables["chunks"], tables["postings"], tables["profiles"], tables["blocks"], terms, sizes, dead.select("segment", "chunk_id").distinct()
    )


def tier(rows: int, fanout: int) -> int:
    n = 0
    while rows >= fanout:
        rows, n = rows // fanout, n + 1
    return n


def to_merge(segments: list[dict], fanout: int = FANOUT) -> list[str]:
    """Names of segments to merge: those of the lowest tier that has fanout or more."""
    tiers: dict[int, list[str]] = {}
    for s in segments:
        tiers.setdefault(tier(s["rows"], fanout), []).append(s["name"])
    full = [names for _, names in sorted(tiers.items()) if len(names) >= fanout]
    return full[0] if full else []


def merge(spark: SparkSession, root: str, names: list[str] | None = None, fanout: int = FANOUT) -> dict:
    """Rewrites the segments of these names (those that to_merge gives, if none) as
    one.  Live chunks are read whole and indexed again: blocks are packed anew, and
    no dead row stays."""
    state = manifest(spark, root)
    names = to_merge(state["segments"], fanout) if names is None else names
    old = [s for s in state["segments"] if s["name"] in names]
    if not old:
        return state
    part = state | {"segments": old}
    chunks, dead = _read(spark, root, part, "chunks"), _tombstones(spark, root, part)
    if dead is not None:
        chunks = chunks.join(dead, ["segment", "chunk_id"], "left_anti")
    name = f"{state['number'] + 1:012d}-{uuid.uuid4().hex[:12]}"
    made = _write_segment(spark, root, name, chunks.drop("segment"))
    state["segments"] = [s for s in state["segments"] if s["name"] not in names] + ([made] if made else [])
    return _publish(spark, root, state)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Deletes the folders of segments that the newest state does not name: those
    merged away and those of commits that failed.  No reader of an older state and
    no writer may be at work."""
    used = {s["name"] for s in manifest(spark, root)["segments"]}
    gone = [n for n in store.children(spark, f"{root}/segments") if n not in used]
    for n in gone:
        store.remove(spark, f"{root}/segments/{n}")
    return gone
