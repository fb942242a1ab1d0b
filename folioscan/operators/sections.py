"""Blocks to sections, the boundary filter, and canonical documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.config import TRUNCATED_SUFFIXES, BlockConfig, BoundaryConfig
from folioscan.functions import text as T
from folioscan.functions.runs import joined, number_heads, number_runs

COUNTS = ("paragraph", "heading_candidate", "list_item", "table_row")


def _section_aggregates() -> list[Column]:
    return [
        joined("text", "block_no", "\n").alias("content"),
        F.min("block_no").alias("block_start_index"),
        F.max("block_no").alias("block_end_index"),
        F.min_by("starts_with_bold", "block_no").alias("title_starts_with_bold"),
        *[F.count_if(F.col("block_type") == t).alias(f"n_{t}") for t in COUNTS],
    ]


def heading_sections(blocks: DataFrame, config: BlockConfig = BlockConfig()) -> DataFrame:
    """blocks: file, file_stem, gap, block_no, ...  A heading begins a section if
    the next stretch of other blocks has a paragraph and enough characters.  Of
    headings in a row only the last titles a section; the blocks before the first
    boundary are titled by the file."""
    keys = ["file", "gap"]
    heading = F.col("block_type") == "heading_candidate"
    runs = number_runs(blocks, keys, "block_no", heading, "run")
    stats = runs.filter(~heading).groupBy(*keys, "run").agg(
        F.max(F.col("block_type") == "paragraph").alias("has_paragraph"), F.sum(F.length("text")).alias("chars")
    )
    after = stats.select(*keys, (F.col("run") - 1).alias("run"), "has_paragraph", "chars")
    marked = runs.join(after, [*keys, "run"], "left").withColumn(
        "boundary",
        heading & F.coalesce(F.col("has_paragraph") & (F.col("chars") >= config.section_chars), F.lit(False)),
    )
    cut = number_heads(marked, keys, "block_no", F.col("boundary"), "section")
    upto = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    titled = cut.withColumn(
        "section_title",
        F.coalesce(F.last(F.when(F.col("boundary"), F.col("text")), ignorenulls=True).over(upto), F.col("file_stem")),
    )
    return (
        titled.filter("not boundary")
        .groupBy(*keys, "section", "section_title")
        .agg(*_section_aggregates())
        .drop("section", "gap")
    )


def entry_sections(blocks: DataFrame) -> DataFrame:
    """One section per entry, with the end of its stat block in its content."""
    upto = Window.partitionBy("file", "entry_index").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumn("char_end", F.sum(F.length("text") + 1).over(upto) - 1)
    return (
        placed.groupBy("file", "entry_index", F.col("entry_title").alias("section_title"), "entry_category", "entry_chunk_type")
        .agg(
            *_section_aggregates(),
            F.max(F.when(F.col("entry_role") == "stat_field", F.col("char_end"))).alias("stat_block_end_char"),
        )
    )


def split_sections(blocks: DataFrame, config: BlockConfig = BlockConfig()) -> DataFrame:
    """Sections of annotated blocks: entries, and heading sections of the gaps
    between them; section_no is dense in a file, from 1."""
    entry = F.col("entry_index").isNotNull()
    gaps = number_runs(blocks, ["file"], "block_no", F.coalesce("entry_index", F.lit(-1)), "gap")
    found = heading_sections(gaps.filter(~entry), config).unionByName(
        entry_sections(blocks.filter(entry)), allowMissingColumns=True
    )
    number = F.row_number().over(Window.partitionBy("file").orderBy("block_start_index"))
    return found.withColumn("body_char_count", F.length("content")).withColumn("section_no", number).withColumn(
        "section_slug", T.slug(F.col("section_title"))
    )


def with_fallback(sections: DataFrame, files: DataFrame) -> DataFrame:
    """Files without any section get one of their name, without text."""
    bare = files.join(sections.select("file").distinct(), "file", "left_anti").select(
        "file", F.lit(1).alias("section_no"), F.col("file_stem").alias("section_title"),
        T.slug(F.col("file_stem")).alias("section_slug"), F.lit("").alias("content"), F.lit(0).alias("body_char_count"),
    )
    return sections.unionByName(bare, allowMissingColumns=True)


# --- boundary filter ---------------------------------------------------------


def stat_field_lookalike(config: BoundaryConfig) -> Column:
    title = T.strip(F.col("section_title"))
    return (
        F.coalesce("title_starts_with_bold", F.lit(False))
        & (F.length(title) <= config.lookalike_title)
        & title.rlike(r"^[A-Z][\p{L}\p{N}_ '/-]+:\s*\S?")
    )


def truncated_title() -> Column:
    found = F.regexp_extract_all("section_title", F.lit("[A-Za-z]+"), F.lit(0))
    last = F.element_at(found, -1)
    single = (F.size(found) == 1) & ~last.rlike("^[A-Z]+$") & (F.length(last) <= 4)
    upper_single = (F.size(found) == 1) & last.rlike("^[A-Z]+$")
    return F.when(F.size(found) == 0, True).when(upper_single, False).otherwise(
        single | F.lower(last).isin(*TRUNCATED_SUFFIXES)
    )


def table_label() -> Column:
    title = T.strip(F.col("section_title"))
    return title.contains("|") | F.lower(title).startswith("table:")


def boilerplate_stub(config: BoundaryConfig) -> Column:
    low = F.lower("content")
    phrase = F.lit(False)
    for p in config.boilerplate:
        phrase = phrase | low.contains(p)
    stem = F.col("section_slug") == T.slug(F.col("file_stem"))
    return (F.col("body_char_count") <= config.stub_max) & (
        phrase | (stem & (F.col("body_char_count") < config.stem_stub_min))
    )


def is_legal_file(config: BoundaryConfig) -> Column:
    """Files whose sections are all kept as they are."""
    return F.lower("file_name").isin(*config.legal_files)


def table_fragment(config: BoundaryConfig) -> Column:
    return (F.col("n_table_row") > 0) & ((F.col("n_paragraph") < 1) | (F.col("body_char_count") < config.fragment))


def boundary_decisions(sections: DataFrame, config: BoundaryConfig = BoundaryConfig()) -> DataFrame:
    """sections with action, reason_code and part: the number of accepted
    sections so far (0 in the head of a file).

    What merges forward can only stand before the first accepted section; after
    it everything merges backward, so a running count of the accepted rows is
    the group of each row."""
    is_entry = F.col("entry_index").isNotNull()
    size = F.count(F.lit(1)).over(Window.partitionBy("file"))
    legal = is_legal_file(config) if "file_name" in sections.columns else F.lit(False)
    reason = (
        F.when(legal, "legal_source_passthrough")
        .when(is_entry, "entry_annotated")
        .when((F.col("section_no") == 1) & boilerplate_stub(config), "boilerplate_opener_stub")
        .when(table_label(), "table_label_title")
        .when(stat_field_lookalike(config), "stat_field_lookalike")
        .when(table_fragment(config), "table_fragment_section")
        .when((F.col("body_char_count") < config.short) | truncated_title(), "suspicious_short_or_truncated")
        .otherwise("accepted_clean")
    )
    rated = sections.withColumn("reason_code", reason).withColumn("n_sections", size)
    accepted = F.col("reason_code").isin("legal_source_passthrough", "entry_annotated", "accepted_clean")
    parts = number_heads(rated, ["file"], "section_no", accepted, "part")
    return parts.withColumn(
        "action",
        F.when(accepted, "accepted")
        .when((F.col("reason_code") == "boilerplate_opener_stub") & (F.col("n_sections") == 1), "dropped")
        .when((F.col("part") > 0) & (F.col("reason_code") != "boilerplate_opener_stub"), "merged_backward")
        .otherwise("merged_forward"),
    )


def promoted_heads(decided: DataFrame) -> DataFrame:
    """The further decision of files whose head becomes a section of its own:
    ahead of an entry, or because no section of the file is accepted."""
    head = decided.filter("part = 0 and action = 'merged_forward'").groupBy("file").agg(
        F.min_by("section_title", "section_no").alias("section_title"),
        # contents are joined by blank lines
        (F.sum("body_char_count") + 2 * (F.count(F.lit(1)) - 1)).cast("int").alias("body_char_count"),
        F.max("n_sections").alias("n_sections"),
    )
    first = decided.filter("part = 1 and action = 'accepted'").select(
        "file", F.col("section_no").alias("at"), F.col("reason_code").alias("code")
    )
    found = head.join(first, "file", "left").filter("code is null or code = 'entry_annotated'")
    return found.select(
        "file",
        F.coalesce("at", F.col("n_sections") + 1).cast("int").alias("section_no"),
        "section_title",
        F.lit("accepted").alias("action"),
        F.when(F.col("code").isNull(), "forward_bucket_promoted_fallback").otherwise("forward_bucket_promoted_before_entry").alias("reason_code"),
        "body_char_count",
    )


def decision_log(decided: DataFrame) -> DataFrame:
    """All decisions of a file: those of its sections, and those of its head."""
    columns = ["file", "section_no", "section_title", "action", "reason_code", "body_char_count"]
    own = decided.select("file", F.col("section_no").cast("int").alias("section_no"), *columns[2:])
    return own.unionByName(promoted_heads(decided))


def merge_sections(decided: DataFrame) -> DataFrame:
    """The kept sections of a file.  Its head goes before the first accepted
    section, or stands alone if that one is an entry or none is accepted."""
    first = F.max(F.when(F.col("part") == 1, F.col("reason_code") == "entry_annotated")).over(Window.partitionBy("file"))
    some = F.max("part").over(Window.partitionBy("file")) > 0
    home = F.when((F.col("part") == 0) & some & ~F.coalesce(first, F.lit(False)), 1).otherwise(F.col("part"))
    own = F.when(F.col("action") == "accepted", 0).otherwise(1)
    placed = decided.filter("action <> 'dropped'").withColumn("home", home).withColumn("own", own)
    lead = F.struct("own", "section_no")
    merged = placed.groupBy("file", "home").agg(
        F.min_by("section_title", lead).alias("section_title"),
        F.min_by("section_slug", lead).alias("section_slug"),
        F.min_by("entry_category", lead).alias("entry_category"),
        F.min_by("entry_chunk_type", lead).alias("entry_chunk_type"),
        F.min_by("stat_block_end_char", lead).alias("stat_block_end_char"),
        joined("content", "section_no", "\n\n").alias("content"),
        F.min("block_start_index").alias("block_start_index"),
        F.max("block_end_index").alias("block_end_index"),
        *[F.sum(f"n_{t}").alias(f"n_{t}") for t in COUNTS],
    )
    number = F.row_number().over(Window.partitionBy("file").orderBy("home"))
    return merged.withColumn("body_char_count", F.length("content")).withColumn("section_no", number).drop("home")


def canonical_documents(sections: DataFrame, files: DataFrame, source_id: str) -> DataFrame:
    """sections and files (file, file_stem, file_name) to canonical documents."""
    place = F.format_string("%03d_%s", "section_no", "section_slug")
    entry = F.col("entry_category").isNotNull()
    return sections.join(files, "file").select(
        F.concat_ws("::", F.lit(source_id), T.slug(F.col("file_stem")), place).alias("document_id"),
        "file",
        "section_no",
        F.when(entry, F.array("entry_category", "section_title")).otherwise(F.array("file_stem", "section_title")).alias("section_path"),
        F.when(entry, F.col("section_title")).alias("entry_title"),
        F.concat(F.col("file_name"), F.lit("#"), place).alias("source_location"),
        F.col("section_title").alias("document_title"),
        "content",
        F.sha1("content").alias("source_checksum"),
        F.col("entry_chunk_type").alias("chunk_type_hint"),
        # an entry with stat fields is cut where they end
        F.when(entry & (F.col("stat_block_end_char") > 0), F.col("stat_block_end_char")).alias("cut_at"),
    )
