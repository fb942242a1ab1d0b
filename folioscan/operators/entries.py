"""Entry detection: repeated shapes in the sequence of blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.config import EntryType
from folioscan.functions.runs import number_runs

#: How a field and a term begin.
FIELD = r"^[A-Z][\p{L}\p{N}_ '/-]+:"
TERM = r"^[A-Z][\p{L}\p{N}_ '/-]*:\s+\S"


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression for the whole name."""
    parts = {"*": ".*", "?": "."}
    return "^" + "".join(parts.get(ch, "\\" + ch if not ch.isalnum() else ch) for ch in glob) + "$"


def eligible(blocks: DataFrame, kind: EntryType, file: str = "file_name") -> DataFrame:
    if kind.files is None:
        return blocks
    return blocks.filter(reduce(lambda a, b: a | b, [F.col(file).rlike(glob_pattern(g)) for g in kind.files]))


def statblocks(blocks: DataFrame, kind: EntryType) -> DataFrame:
    """Matches of a title, a smaller subtitle and at least min_fields bold field
    lines of the subtitle's size.  The description runs to the next match of the
    type, at most to the next heading."""
    pattern = kind.pattern or FIELD
    rows = Window.partitionBy("file").orderBy("block_no")
    field = F.col("starts_with_bold") & F.col("text").rlike(pattern)
    # a run of fields of one size is one island
    marked = number_runs(
        blocks.withColumn("field", field),
        ["file"],
        "block_no",
        F.when(F.col("field"), F.col("font_size")).otherwise(F.lit(-1)),
        "run",
    )
    marked = marked.withColumn("run_end", F.max("block_no").over(Window.partitionBy("file", "run")))
    ahead = lambda c, n: F.lead(c, n).over(rows)
    title = (
        (F.length("text") <= kind.title_max) & ~F.col("starts_with_bold") & ~F.col("text").rlike(pattern)
    )
    subtitle = (
        (F.length(ahead("text", 1)) <= kind.subtitle_max)
        & ~ahead("starts_with_bold", 1)
        & (ahead("font_size", 1) < F.col("font_size"))
    )
    fields = ahead("field", 2) & (ahead("font_size", 2) == ahead("font_size", 1))
    count = ahead("run_end", 2) - F.col("block_no") - 1
    found = marked.withColumn("is_match", F.coalesce(title & subtitle & fields & (count >= kind.min_fields), F.lit(False)))
    found = found.withColumn("fields_end", ahead("run_end", 2) + 1)
    later = rows.rowsBetween(1, Window.unboundedFollowing)
    starts = found.withColumn("next_start", F.min(F.when(F.col("is_match"), F.col("block_no"))).over(later))
    size = F.max("block_no").over(Window.partitionBy("file")) + 1
    starts = starts.withColumn("n_blocks", size)
    matches = starts.filter("is_match").select(
        "file",
        F.col("block_no").alias("start"),
        "fields_end",
        F.coalesce("next_start", "n_blocks").alias("hard_stop"),
        F.col("text").alias("entry_title"),
    )
    headings = blocks.filter("block_type = 'heading_candidate'").select("file", F.col("block_no").alias("h"))
    ends = (
        matches.join(headings, "file", "left")
        .groupBy("file", "start", "fields_end", "hard_stop", "entry_title")
        .agg(F.min(F.when((F.col("h") >= F.col("fields_end")) & (F.col("h") < F.col("hard_stop")), F.col("h"))).alias("stop"))
    )
    return ends.select(
        "file",
        "start",
        "fields_end",
        F.coalesce("stop", "hard_stop").alias("end"),
        "entry_title",
        F.lit(kind.name).alias("entry_type"),
        F.lit(kind.category).alias("entry_category"),
        F.lit(kind.chunk_type).alias("entry_chunk_type"),
        F.lit(kind.shape).alias("shape_family"),
    )


def definitions(blocks: DataFrame, kind: EntryType) -> DataFrame:
    """Every block of a run of at least min_blocks bold `Term: text` blocks of
    one size is an entry."""
    pattern = kind.pattern or TERM
    ok = F.col("starts_with_bold") & F.col("text").rlike(pattern)
    runs = number_runs(
        blocks.withColumn("ok", ok), ["file"], "block_no",
        F.when(F.col("ok"), F.col("font_size")).otherwise(F.lit(-1)), "run",
    )
    sized = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file", "run")))
    return sized.filter(F.col("ok") & (F.col("n") >= kind.min_blocks)).select(
        "file",
        F.col("block_no").alias("start"),
        (F.col("block_no") + 1).alias("fields_end"),
        (F.col("block_no") + 1).alias("end"),
        F.trim(F.substring_index("text", ":", 1)).alias("entry_title"),
        F.lit(kind.name).alias("entry_type"),
        F.lit(kind.category).alias("entry_category"),
        F.lit(kind.chunk_type).alias("entry_chunk_type"),
        F.lit(kind.shape).alias("shape_family"),
    )


def find_matches(blocks: DataFrame, kinds: list[EntryType], file: str = "file_name") -> DataFrame:
    """Matches of all kinds, each in the files it is meant for."""
    if not kinds:
        none = {"start": "int", "fields_end": "int", "end": "int"}
        names = ("start", "fields_end", "end", "entry_title", "entry_type", "entry_category", "entry_chunk_type", "shape_family")
        return blocks.limit(0).select("file", *[F.lit(None).cast(none.get(n, "string")).alias(n) for n in names])
    shapes = {"entry_with_statblock": statblocks, "definition_list": definitions}
    parts = []
    for kind in kinds:
        if kind.shape not in shapes:
            raise ValueError(f"unknown shape {kind.shape!r}")
        parts.append(shapes[kind.shape](eligible(blocks, kind, file), kind))
    return reduce(DataFrame.unionByName, parts)


def conflicts(matches: DataFrame) -> DataFrame:
    """Neighbouring matches of a file that overlap."""
    rows = Window.partitionBy("file").orderBy("start", "end", "entry_type")
    return (
        matches.withColumn("next_start", F.lead("start").over(rows))
        .withColumn("next_type", F.lead("entry_type").over(rows))
        .filter("next_start < end")
        .select("file", "start", "end", "entry_type", "next_start", "next_type")
    )


def annotate(blocks: DataFrame, matches: DataFrame) -> DataFrame:
    """blocks with entry_index (dense in a file), type, category, chunk type,
    title, shape and role; null outside of entries."""
    numbered = matches.withColumn("entry_index", F.dense_rank().over(Window.partitionBy("file").orderBy("start")) - 1)
    b, m = blocks.alias("b"), numbered.alias("m")
    inside = (F.col("b.file") == F.col("m.file")) & (F.col("b.block_no") >= F.col("m.start")) & (F.col("b.block_no") < F.col("m.end"))
    at = F.col("b.block_no") - F.col("m.start")
    role = (
        F.when(F.col("m.start").isNull(), None)
        .when(F.col("m.shape_family") == "definition_list", "definition")
        .when(at == 0, "title")
        .when(at == 1, "subtitle")
        .when(F.col("b.block_no") < F.col("m.fields_end"), "stat_field")
        .otherwise("description")
    )
    extra = ["entry_index", "entry_type", "entry_category", "entry_chunk_type", "entry_title", "shape_family"]
    return b.join(m, inside, "left").select("b.*", *[f"m.{c}" for c in extra], role.alias("entry_role"))
