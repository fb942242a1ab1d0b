"""Rows for people to look at: evidence, segments and citations as flat text,
the history of asked queries, and a preview of chunks.

Defined results: candidates without signals read "(none)"; a citation without
path has an empty locator; absent contents are shown as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import answer

#: How many asked queries a session shows.
HISTORY = 20


def _listed(name: str, hits: str) -> Column:
    quoted = F.concat(F.lit("['"), F.array_join(hits, "', '"), F.lit("']"))
    return F.when(F.size(hits) > 0, F.concat(F.lit(f"{name}="), quoted))


def signal_text() -> Column:
    """The match signals in words, those that are there."""
    said = F.concat_ws(
        "; ",
        _listed("exact", "exact_phrase_hits"),
        _listed("protected", "protected_phrase_hits"),
        F.when(F.col("section_path_hit"), "section_path_hit"),
        F.when(F.col("token_overlap_count") > 0, F.concat(F.lit("token_overlap="), F.col("token_overlap_count"))),
    )
    return F.when(said == "", "(none)").otherwise(said)


def candidate_rows(items: DataFrame) -> DataFrame:
    return items.select(
        "query_id", "rank", "chunk_id", "document_id", "section_root", "chunk_type", signal_text().alias("match_signals")
    )


def segment_rows(segments: DataFrame) -> DataFrame:
    """One row per segment, its citation in brackets."""
    return answer.cite(segments).select(
        "query_id", "segment_id", "support_type", F.concat(F.lit("["), "citation_id", F.lit("]")).alias("citations"), "text"
    )


def citation_rows(segments: DataFrame) -> DataFrame:
    """One row per citation, its path joined."""
    return answer.cite(segments).select(
        "query_id", "citation_id", "chunk_id", "source_id",
        F.coalesce(F.array_join("section_path", " > "), F.lit("")).alias("locator"), F.col("text").alias("excerpt"),
    ).distinct()


def history(asked: DataFrame, limit: int = HISTORY) -> DataFrame:
    """asked: session, ran_at and more.  The newest of each session, numbered
    from 1.  Spark cuts each session to `limit` rows before the exchange, so a
    busy session stays small."""
    newest = Window.partitionBy("session").orderBy(F.desc("ran_at"))
    return asked.withColumn("entry_no", F.row_number().over(newest)).filter(F.col("entry_no") <= limit)


def preview(chunks: DataFrame, samples: int = 6, lines: int = 4) -> str:
    """Markdown: chunks by type, and the first few with the start of each."""
    kinds = chunks.groupBy("chunk_type").count().orderBy("chunk_type").collect()
    if not kinds:
        return "No chunks.\n"
    out = [f"Total chunks: **{sum(r['count'] for r in kinds)}**", "", "| chunk_type | count |", "|---|---|"]
    out += [f"| `{r['chunk_type']}` | {r['count']} |" for r in kinds]
    content = F.trim(F.coalesce("content", F.lit("")))
    shown = chunks.select(
        "chunk_id", "chunk_type", "section_path", "previous_chunk_id", "next_chunk_id",
        F.substring_index(content, "\n", lines).alias("head"), content.alias("whole"),
    )
    for r in shown.orderBy("chunk_id").limit(samples).collect():
        out += [
            "", f"**`{r['chunk_id']}`** `{r['chunk_type']}`", f"- path: {' > '.join(r['section_path'] or ())}",
            f"- before: `{r['previous_chunk_id'] or '-'}`, after: `{r['next_chunk_id'] or '-'}`",
            "```text", r["head"], *([] if r["head"] == r["whole"] else ["..."]), "```",
        ]
    return "\n".join(out) + "\n"
