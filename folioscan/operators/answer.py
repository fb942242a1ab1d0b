"""Evidence to cited excerpt answers, or an abstention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.config import ABSTAIN
from folioscan.functions import text as T


def support(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Per query: answer_type, trigger_code, reason.  Only a phrase or path hit
    of the best item grounds an answer."""
    best = items.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("n = 1")
    strong = (F.size("exact_phrase_hits") > 0) | (F.size("protected_phrase_hits") > 0) | F.col("section_path_hit")
    rated = queries.select("query_id").join(best.select("query_id", strong.alias("strong")), "query_id", "left")
    code = F.when(F.col("strong").isNull(), "empty_evidence").when(~F.col("strong"), "weak_signals")
    texts = F.create_map(*[F.lit(x) for kv in ABSTAIN.items() for x in kv])
    return rated.select(
        "query_id", F.when(code.isNull(), "grounded").otherwise("abstain").alias("answer_type"),
        code.alias("trigger_code"), F.try_element_at(texts, code).alias("reason"),
    )


def _hits():
    return F.array_distinct(F.concat("exact_phrase_hits", "protected_phrase_hits"))


def rated_items(items: DataFrame) -> DataFrame:
    """Items with their relation to the query's primary item: is_primary,
    is_sibling, sibling_no, is_distinct (another group, and a hit the primary
    lacks)."""
    rows = Window.partitionBy("query_id").orderBy("rank")
    whole = Window.partitionBy("query_id")
    marked = items.withColumn("hits", _hits()).withColumn("is_primary", F.row_number().over(rows) == 1)
    of_primary = lambda c: F.max(F.when(F.col("is_primary"), c)).over(whole)
    known = marked.withColumns(
        {
            "p_document": of_primary(F.col("document_id")),
            "p_root": of_primary(F.col("section_root")),
            "p_hits": of_primary(F.col("hits")),
        }
    )
    same = (F.col("document_id") == F.col("p_document")) & (F.col("section_root") == F.col("p_root"))
    sibling = same & ~F.col("is_primary")
    rated = known.withColumn("is_sibling", sibling).withColumn(
        "is_distinct", ~same & (F.size(F.array_except("hits", "p_hits")) > 0)
    )
    number = F.row_number().over(Window.partitionBy("query_id", "is_sibling").orderBy("rank"))
    return rated.withColumn("sibling_no", F.when(F.col("is_sibling"), number))


def compose(items: DataFrame, grounded: DataFrame) -> DataFrame:
    """Up to three segments per grounded query: the best item, its first sibling,
    and a distinct item of another section or else the second sibling."""
    rated = rated_items(items.join(grounded.filter("answer_type = 'grounded'").select("query_id"), "query_id", "left_semi"))
    whole = Window.partitionBy("query_id")
    cross = F.min(F.when(F.col("is_distinct"), F.col("rank"))).over(whole)
    slots = rated.withColumn("cross_rank", cross).withColumn(
        "slot",
        F.when(F.col("is_primary"), 1)
        .when(F.col("sibling_no") == 1, 2)
        .when(F.col("is_distinct") & (F.col("rank") == F.col("cross_rank")), 3)
        .when((F.col("sibling_no") == 2) & F.col("cross_rank").isNull(), 4),
    )
    chosen = slots.filter("slot is not null")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("slot"))
    role = F.when(F.col("slot") == 1, "primary").when(F.col("slot") == 3, "cross-section").otherwise("sibling")
    direct = F.size("hits") > 0
    title = F.col("entry_title") if "entry_title" in items.columns else F.lit(None).cast("string")
    return chosen.withColumn("entry_title", title).select(
        "query_id",
        F.format_string("seg_%d", number).alias("segment_id"),
        role.alias("role"),
        "chunk_id", "document_id", "section_path", "entry_title", "source_id", "edition", "rank", "slot",
        T.excerpt(F.col("content")).alias("text"),
        F.when(direct, "direct_support").otherwise("supported_inference").alias("support_type"),
    )


def slot_decisions(items: DataFrame, grounded: DataFrame) -> DataFrame:
    """Why each slot of a grounded query was filled or left empty."""
    rated = rated_items(items.join(grounded.filter("answer_type = 'grounded'").select("query_id"), "query_id", "left_semi"))
    pick = lambda cond: F.min_by(F.when(cond, F.col("chunk_id")), F.when(cond, F.col("rank")))
    other = ~F.col("is_primary")
    by = rated.groupBy("query_id").agg(
        pick(F.col("is_primary")).alias("primary"),
        pick(F.col("sibling_no") == 1).alias("sibling"),
        pick(F.col("is_distinct")).alias("cross"),
        pick(F.col("sibling_no") == 2).alias("fallback"),
        F.count_if(other & F.col("is_sibling")).alias("same_group"),
        F.count_if(other & ~F.col("is_sibling") & ~F.col("is_distinct")).alias("subset"),
    )

    def row(slot, chosen, yes, no, rejected):
        return F.struct(
            F.lit(slot).alias("slot"),
            F.when(chosen.isNull(), "skipped").otherwise("filled").alias("outcome"),
            chosen.alias("chosen_chunk_id"),
            F.when(chosen.isNull(), no).otherwise(yes).alias("reason"),
            rejected.cast("long").alias("n_rejected"),
        )

    zero = F.lit(0)
    rows = [
        row("primary", F.col("primary"), "top_ranked_evidence_item", "", zero),
        row("sibling", F.col("sibling"), "first_ranked_sibling", "no_sibling_available", zero),
        row("cross-section", F.col("cross"), "distinct_cross_section_found", "no_distinct_cross_section", F.col("same_group") + F.col("subset")),
        row("fallback-sibling", F.col("fallback"), "fallback_sibling_found", "no_fallback_sibling_available", F.least(F.col("same_group"), F.lit(1))),
    ]
    each = by.select("query_id", "cross", F.explode(F.array(*rows)).alias("d")).select("query_id", "cross", "d.*")
    return each.filter("slot <> 'fallback-sibling' or cross is null").drop("cross")


def cite(segments: DataFrame) -> DataFrame:
    """segments with citation_id: equal excerpts of a chunk share one, numbered
    by first use."""
    first = F.min("slot").over(Window.partitionBy("query_id", "chunk_id", "text"))
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy("first_slot"))
    return segments.withColumn("first_slot", first).withColumn("citation_id", F.format_string("cit_%d", number)).drop("first_slot")


def answers(queries: DataFrame, decided: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per query: the tagged union of grounded answer and abstention."""
    pack = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    body = cite(segments).groupBy("query_id").agg(
        pack("segment_id", "text", "support_type", "citation_id", "role").alias("segments"),
        F.array_sort(F.collect_set(F.struct("citation_id", "chunk_id", "source_id", "edition", "section_path", F.col("text").alias("excerpt")))).alias("citations"),
        F.countDistinct("chunk_id").alias("selected_chunks"),
    )
    return queries.select("query_id", "raw_query").join(decided, "query_id").join(body, "query_id", "left")


def to_json(answered: DataFrame) -> DataFrame:
    """query_id and the answer as JSON; absent parts have no key."""
    parts = F.struct(
        F.col("raw_query").alias("query"), "answer_type", F.col("reason").alias("abstention_reason"),
        F.col("segments").alias("answer_segments"), "citations", "selected_chunks",
    )
    return answered.select("query_id", F.to_json(parts).alias("json"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
