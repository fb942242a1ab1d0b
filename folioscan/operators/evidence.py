"""Candidates to groups, spans and evidence packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def section_root():
    return F.coalesce(F.get("section_path", F.lit(0)), F.lit(""))


def groups(candidates: DataFrame) -> DataFrame:
    """Candidates with section_root, best_rank and group_no (by best rank)."""
    keyed = candidates.withColumn("section_root", section_root())
    best = F.min("rank").over(Window.partitionBy("query_id", "document_id", "section_root"))
    ranked = keyed.withColumn("best_rank", best)
    return ranked.withColumn("group_no", F.dense_rank().over(Window.partitionBy("query_id").orderBy("best_rank")))


def spans(grouped: DataFrame) -> DataFrame:
    """Candidates become one span where they name each other as neighbours and
    share the whole section path; the best ranked one represents it.

    Such links form chains, and every candidate walks back along its own to the
    head.  A group holds at most the candidates of one search, so that walk stays
    inside a row.  Who never comes to a head is in a cycle and stays single."""
    key = ["query_id", "document_id", "section_root"]
    before = grouped.select(
        *key, F.col("chunk_id").alias("previous_chunk_id"), F.col("next_chunk_id").alias("its_next"),
        F.col("section_path").alias("its_path"),
    )
    linked = grouped.join(before, [*key, "previous_chunk_id"], "left")
    mutual = (F.col("its_next") == F.col("chunk_id")) & (F.col("its_path") == F.col("section_path"))
    link = F.when(mutual, F.struct("chunk_id", "previous_chunk_id"))
    linked = linked.withColumn("back", F.map_from_entries(F.collect_set(link).over(Window.partitionBy(*key))))
    behind = lambda chunk: F.element_at("back", chunk)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.size("back")),
        F.struct(F.col("chunk_id").alias("head"), F.lit(0).alias("place")),
        lambda at, _: F.when(behind(at["head"]).isNull(), at).otherwise(
            F.struct(behind(at["head"]).alias("head"), (at["place"] + 1).alias("place"))
        ),
    )
    walked = linked.withColumn("walk", walk)
    whole = behind(F.col("walk.head")).isNull()
    placed = walked.withColumn("head", F.when(whole, F.col("walk.head")).otherwise(F.col("chunk_id")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("walk.place", "chunk_id"))), lambda s: s["chunk_id"])
    return placed.groupBy(*key, "group_no", "head").agg(
        F.min("rank").alias("rank"), F.min_by("chunk_id", "rank").alias("chunk_id"), ids.alias("chunk_ids")
    ).select(
        *key, "group_no", "rank", "chunk_id", "chunk_ids",
        F.get("chunk_ids", F.lit(0)).alias("start_chunk_id"),
        F.element_at("chunk_ids", -1).alias("end_chunk_id"),
        F.when(F.size("chunk_ids") > 1, "adjacent_span").otherwise("singleton").alias("merge_reason"),
    )


def evidence(candidates: DataFrame) -> DataFrame:
    """One item per span, with what its representative holds."""
    grouped = groups(candidates)
    kept = [
        "chunk_type", "source_id", "edition", "section_path", "content", "raw_score", "score",
        "exact_phrase_hits", "protected_phrase_hits", "section_path_hit", "token_overlap_count",
    ]
    more = ("entry_title", "source_location", "source_type", "authority_level", "parent_chunk_id", "previous_chunk_id", "next_chunk_id")
    kept += [c for c in more if c in grouped.columns]
    lead = grouped.select("query_id", "chunk_id", *kept)
    return spans(grouped).join(lead, ["query_id", "chunk_id"]).withColumn("content", F.coalesce("content", F.lit("")))


def traces(candidates: DataFrame) -> DataFrame:
    """Per query: total_candidates, group_count and the groups."""
    grouped = groups(candidates).groupBy("query_id", "group_no", "document_id", "section_root").agg(
        F.count(F.lit(1)).alias("candidate_count")
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("group_no", "document_id", "section_root", "candidate_count"))),
        lambda g: F.struct(g["document_id"].alias("document_id"), g["section_root"].alias("section_root"), g["candidate_count"].alias("candidate_count")),
    )
    return grouped.groupBy("query_id").agg(
        F.sum("candidate_count").alias("total_candidates"), F.count(F.lit(1)).alias("group_count"), listed.alias("groups")
    )
