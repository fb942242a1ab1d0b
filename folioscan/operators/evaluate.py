"""Gold cases against answers: checks, failure tags, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.config import EVAL_STOP_WORDS, TAGS


def tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, EVAL_STOP_WORDS))))


def expected_head(path: Column) -> Column:
    """The first element without .rtf; one shaped like a file name gives way to
    the second."""
    head = F.regexp_replace(F.lower(F.get(path, F.lit(0))), r"\.rtf$", "")
    filename = head.contains(".") | ((head != "") & ~head.contains(" ") & ~head.contains(":"))
    return F.when(filename & (F.size(path) >= 2), F.lower(F.get(path, F.lit(1)))).otherwise(head)


def expected_tail(path: Column) -> Column:
    return F.lower(F.try_element_at(path, F.lit(-1)))


def section_matches(path: Column, head: Column) -> Column:
    prefix = lambda c: F.trim(F.substring_index(c, ":", 1))
    return F.exists(
        path, lambda e: F.lower(e).contains(head) | ((prefix(head) != "") & (prefix(F.lower(e)) == prefix(head)))
    )


def entry_matches(path: Column, entry_title: Column, tail: Column) -> Column:
    titled = F.coalesce((entry_title != "") & F.lower(entry_title).contains(tail), F.lit(False))
    return F.exists(path, lambda e: F.lower(e).contains(tail)) | titled


def citation_checks(gold: DataFrame, citations: DataFrame, edition: str) -> DataFrame:
    """gold: query_id, question, expected_sources, expected_path,
    expected_behavior.  citations: query_id, citation_id, source_id, edition,
    section_path, entry_title, excerpt."""
    path = F.col("expected_path")
    known = F.size(path) > 0
    shared = F.array_intersect(tokens(F.col("question")), tokens(F.col("excerpt")))
    return citations.join(gold, "query_id").select(
        "query_id",
        "citation_id",
        F.array_contains("expected_sources", F.col("source_id")).alias("source_match"),
        F.when(known, section_matches(F.col("section_path"), expected_head(path))).alias("section_match"),
        F.when(known, entry_matches(F.col("section_path"), F.col("entry_title"), expected_tail(path))).alias("entry_match"),
        (F.col("edition") == edition).alias("edition_match"),
        F.size(shared).alias("token_overlap"),
        shared.alias("shared_tokens"),
        (F.size(shared) == 0).alias("citation_mismatch"),
    )


def outcomes(gold: DataFrame, answered: DataFrame, checks: DataFrame) -> DataFrame:
    """answered: query_id, answer_type, primary_support.  Adds tags in report
    order."""
    no = F.lit(False)
    by = checks.groupBy("query_id").agg(
        F.bool_or("source_match").alias("source"),
        F.bool_or(F.coalesce("section_match", no)).alias("section"),
        F.bool_or(F.coalesce("entry_match", no)).alias("entry"),
        F.bool_or("citation_mismatch").alias("mismatch"),
        F.bool_or(~F.col("edition_match")).alias("edition_bad"),
        F.count(F.lit(1)).alias("n_citations"),
    )
    all_ = gold.join(answered, "query_id").join(by, "query_id", "left")
    grounded = F.col("answer_type") == "grounded"
    abstain = F.col("expected_behavior") == "abstain"
    cited = grounded & (F.coalesce("n_citations", F.lit(0)) > 0)
    placed = cited & (F.size("expected_path") > 0)
    rules = {
        "retrieval_miss": cited & (F.size("expected_sources") > 0) & ~F.col("source"),
        "wrong_section": placed & ~F.col("section"),
        "wrong_entry": placed & F.col("section") & ~F.col("entry"),
        "citation_mismatch": cited & F.col("mismatch"),
        "unsupported_inference": grounded & (F.col("expected_behavior") == "direct_answer") & (F.col("primary_support") == "supported_inference"),
        "missing_abstain": grounded & abstain,
        "unnecessary_abstain": ~grounded & ~abstain,
        "edition_boundary_failure": cited & F.col("edition_bad"),
    }
    tags = F.array_compact(F.array(*[F.when(F.coalesce(rules[t], no), F.lit(t)) for t in TAGS]))
    return all_.select("query_id", "expected_behavior", "answer_type", tags.alias("tags"))


def tag_counts(found: DataFrame) -> DataFrame:
    """Every tag with its count, zero where none; `clean` for cases without."""
    spark = found.sparkSession
    names = spark.createDataFrame([(t, i) for i, t in enumerate((*TAGS, "clean"))], "tag string, ord int")
    each = found.select(F.explode(F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("clean")))).alias("tag"))
    return names.join(each.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "tag", "left").select(
        "ord", "tag", F.coalesce("n", F.lit(0)).alias("n")
    )


def report(found: DataFrame) -> DataFrame:
    """case_count and the share of cases whose answer type is the expected one."""
    wants = F.when(F.col("expected_behavior") == "abstain", "abstain").otherwise("grounded")
    return found.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(F.size("tags") == 0).alias("clean_count"),
        F.bround(F.avg((F.col("answer_type") == wants).cast("int")), 2).alias("behavior_match_rate"),
    )
