"""Formatted spans to blocks: split at line ends, classify, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.config import BlockConfig
from folioscan.functions import text as T


def merge_spans(spans: DataFrame) -> DataFrame:
    """spans: file, span_no, text, font_size, bold.  Neighbours of one format
    become one span."""
    from folioscan.functions.runs import joined, number_runs

    runs = number_runs(spans, ["file"], "span_no", F.struct("font_size", "bold"), "run")
    return runs.groupBy("file", "run", "font_size", "bold").agg(joined("text", "span_no", "").alias("text"))


def split_lines(spans: DataFrame) -> DataFrame:
    """Spans cut at line ends, with line_no from 0: a running count of the line
    ends before."""
    before = Window.partitionBy("file").orderBy("span_no").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.size(F.split("text", "\n", -1)) - 1
    first = F.coalesce(F.sum(ends).over(before), F.lit(0))
    return (
        spans.withColumn("first_line", first)
        .select("file", "span_no", "font_size", "bold", "first_line", F.posexplode(F.split("text", "\n", -1)).alias("part", "text"))
        .filter("text <> ''")
        .withColumn("line_no", F.col("first_line") + F.col("part"))
        .drop("first_line", "part")
    )


def summarize(lines: DataFrame) -> DataFrame:
    """Per line: text, font_size (the size of most visible characters, of ties
    the first), starts_with_bold, all_bold, any_bold."""
    seen = F.length(F.regexp_replace("text", r"\s", ""))
    shown = lines.withColumn("seen", seen)
    sizes = (
        shown.filter("seen > 0")
        .groupBy("file", "line_no", "font_size")
        .agg(F.sum("seen").alias("w"), F.min("span_no").alias("at"))
        .groupBy("file", "line_no")
        .agg(F.max_by("font_size", F.struct(F.col("w"), -F.col("at"))).alias("font_size"))
    )
    visible = F.col("seen") > 0
    texts = shown.groupBy("file", "line_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), ""
        ).alias("text"),
        F.coalesce(F.min_by("bold", F.when(visible, F.col("span_no"))), F.lit(False)).alias("starts_with_bold"),
        F.coalesce(F.every(F.when(visible, F.col("bold"))), F.lit(False)).alias("all_bold"),
        F.some("bold").alias("any_bold"),
    )
    return texts.join(sizes, ["file", "line_no"], "left").withColumn(
        "font_size", F.coalesce("font_size", F.lit(0))
    )


def baselines(lines: DataFrame) -> DataFrame:
    """Per file the most frequent size of lines without bold spans (of all lines
    if there are none), of ties the larger; 0 if there is none."""
    plain = lines.withColumn("plain", ~F.col("any_bold"))
    rated = plain.withColumn("has_plain", F.max("plain").over(Window.partitionBy("file")))
    counts = (
        rated.filter("plain or not has_plain").filter("font_size > 0").groupBy("file", "font_size").count()
    )
    best = counts.groupBy("file").agg(F.max_by("font_size", F.struct("count", "font_size")).alias("baseline"))
    return lines.select("file").distinct().join(best, "file", "left").select(
        "file", F.coalesce("baseline", F.lit(0)).alias("baseline")
    )


def build_blocks(spans: DataFrame, demoted: DataFrame | None = None, config: BlockConfig = BlockConfig()) -> DataFrame:
    """The blocks of every file: block_no (dense, from 0), block_id, block_type,
    text, line_no, font_size, font_size_class, starts_with_bold, all_bold.
    demoted: files whose headings are paragraphs."""
    lines = summarize(split_lines(spans))
    base = baselines(lines)
    body = (F.col("baseline") == 0) | (F.col("font_size") == 0)
    kept = (
        lines.join(base, "file")
        .withColumn("text", T.normal_block(F.col("text")))
        .filter("text <> ''")
        .withColumn("block_type", T.block_type(F.col("text"), config))
        .withColumn(
            "font_size_class",
            F.when(body, "body")
            .when(F.col("font_size") > F.col("baseline"), "larger")
            .when(F.col("font_size") < F.col("baseline"), "smaller")
            .otherwise("body"),
        )
    )
    if demoted is not None:
        kept = kept.join(demoted.select("file", F.lit(True).alias("demoted")), "file", "left").withColumn(
            "block_type",
            F.when(F.col("demoted") & (F.col("block_type") == "heading_candidate"), "paragraph").otherwise(
                F.col("block_type")
            ),
        )
    number = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return kept.withColumn("block_no", number - 1).select(
        "file",
        "block_no",
        F.format_string("b%04d", F.col("block_no") + 1).alias("block_id"),
        "block_type",
        "text",
        "line_no",
        "font_size",
        "font_size_class",
        "starts_with_bold",
        "all_bold",
    )
