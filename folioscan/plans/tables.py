"""The driver's tables seen as the engine's relations, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.config import Constraints, EntryType, TermAssets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Admitted sources of the test corpus.
CONSTRAINTS = Constraints(("de", "en", "fr"), ("core", "supplement"), ("primary",), ("src13",))
#: Vocabulary of the test corpus.
TERMS = TermAssets(
    {"ansh": "an sh", "erth": "er the", "auou": "au ou"},
    ("of the", "and the", "to the", "in the of", "the of", "le de", "der die", "de la", "los de"),
)
KINDS = [
    EntryType("spell", "Spells", "spell_entry", "entry_with_statblock", ("src1*.txt", "src2.txt")),
    EntryType("feat", "Feats", "feat_entry", "entry_with_statblock", ("src3.txt", "src4.txt", "src5.txt"), 80, 40, 1),
    EntryType("condition", "Conditions", "condition_entry", "definition_list", ("src6.txt", "src7.txt"), min_blocks=2),
]
BOILERPLATE = ("license", "copyright")

SOURCE_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'supplement' WHEN 2 THEN 'core' ELSE 'adventure' END"
AUTHORITY = "CASE WHEN doc_id % 7 = 0 THEN 'secondary' ELSE 'primary' END"


def canonical(docs: DataFrame) -> DataFrame:
    """documents as canonical documents: every second one carries hints, and
    paths have one element, an echo or two elements."""
    leaf = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id",
        F.concat(F.lit("doc::"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("document_id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("edition"),
        F.expr(SOURCE_TYPE).alias("source_type"),
        F.expr(AUTHORITY).alias("authority_level"),
        F.when(F.col("doc_id") % 11 == 0, F.array("source"))
        .when(F.col("doc_id") % 13 == 0, F.array("source", F.upper("source")))
        .when(F.col("doc_id") % 17 == 0, F.array("source", F.lit("Open License")))
        .otherwise(F.array("source", leaf))
        .alias("section_path"),
        F.concat(F.col("source"), F.lit(".txt#"), F.col("doc_id").cast("string")).alias("source_location"),
        leaf.alias("document_title"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, "subsection").alias("chunk_type_hint"),
        F.when(
            (F.col("doc_id") % 6 == 0) & (F.length("text") > 200),
            F.array(F.struct(F.lit(100).alias("offset"), F.lit("stat_block").alias("type"))),
        )
        .otherwise(F.array().cast("array<struct<offset:int,type:string>>"))
        .alias("cuts"),
    )


CANONICAL_SQL = f"""
canonical AS (
  SELECT doc_id, 'doc::' || lpad(doc_id::VARCHAR, 9, '0') AS document_id, source AS source_id, lang AS edition,
    {SOURCE_TYPE} AS source_type, {AUTHORITY} AS authority_level,
    CASE WHEN doc_id % 11 = 0 THEN [source] WHEN doc_id % 13 = 0 THEN [source, upper(source)]
      WHEN doc_id % 17 = 0 THEN [source, 'Open License'] ELSE [source, 'doc ' || doc_id::VARCHAR] END AS section_path,
    source || '.txt#' || doc_id::VARCHAR AS source_location, 'doc ' || doc_id::VARCHAR AS document_title, text AS content,
    CASE WHEN doc_id % 2 = 0 THEN 'subsection' END AS chunk_type_hint,
    doc_id % 6 = 0 AND length(text) > 200 AS has_cut
  FROM documents)"""


def styled_spans(docs: DataFrame) -> DataFrame:
    """documents as formatted spans: lines take turns as title, subtitle, two
    fields and two lines of text; fields are `Word: text` with a bold word."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    k = ((F.col("doc_id") + F.col("line")) % 6).cast("int")
    word = F.regexp_replace(F.substring_index(F.col("t"), " ", 1), "[^A-Za-z]", "")
    rest = F.regexp_replace(F.col("t"), r"^[^ ]* ?", "")
    field = F.array(
        F.struct(F.concat(word, F.lit(":")).alias("text"), F.lit(24).alias("font_size"), F.lit(True).alias("bold")),
        F.struct(F.concat(F.lit(" "), rest, F.lit("\n")).alias("text"), F.lit(24).alias("font_size"), F.lit(False).alias("bold")),
    )
    short = F.concat(F.substring("t", 1, 30), F.lit("\n"))
    one = lambda text, size: F.array(F.struct(text.alias("text"), size.alias("font_size"), F.lit(False).alias("bold")))
    # what a title leaves of its line is a line of small text
    following = F.when(
        F.length("t") > 30, one(F.concat(F.expr("substring(t, 31)"), F.lit("\n")), F.lit(22))
    ).otherwise(F.array().cast("array<struct<text:string,font_size:int,bold:boolean>>"))
    kinds = (
        F.when(k == 0, F.concat(one(short, F.lit(28)), following))
        .when(k == 1, F.concat(one(short, F.lit(24)), following))
        .when(k.isin(2, 3), field)
        .otherwise(one(F.concat("t", F.lit("\n")), F.lit(24) - F.length("t") % 2 * 2))
    )
    spans = lines.select("doc_id", "source", "line", F.posexplode(kinds).alias("part", "s"))
    return spans.select(
        F.col("doc_id").alias("file"),
        (F.col("line") * 2 + F.col("part")).alias("span_no"),
        "s.text", "s.font_size", "s.bold",
    ).filter("text <> ''")


SPANS_SQL = r"""
lines AS (
  SELECT doc_id, source, line - 1 AS line, t FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line
    FROM documents)),
styled AS (
  SELECT doc_id AS file, line, (doc_id + line) % 6 AS k, t,
    regexp_replace(string_split(t, ' ')[1], '[^A-Za-z]', '', 'g') AS word, regexp_replace(t, '^[^ ]* ?', '') AS rest
  FROM lines),
spans AS (
  SELECT file, line * 2 AS span_no, left(t, 30) || chr(10) AS text, 28 AS font_size, false AS bold FROM styled WHERE k = 0
  UNION ALL SELECT file, line * 2, left(t, 30) || chr(10), 24, false FROM styled WHERE k = 1
  UNION ALL SELECT file, line * 2 + 1, substring(t, 31) || chr(10), 22, false FROM styled WHERE k IN (0, 1) AND length(t) > 30
  UNION ALL SELECT file, line * 2, word || ':', 24, true FROM styled WHERE k IN (2, 3)
  UNION ALL SELECT file, line * 2 + 1, ' ' || rest || chr(10), 24, false FROM styled WHERE k IN (2, 3)
  UNION ALL SELECT file, line * 2, t || chr(10), 24 - length(t) % 2 * 2, false FROM styled WHERE k > 3)"""


def files(docs: DataFrame) -> DataFrame:
    """One source is a legal text."""
    name = F.when(F.col("source") == "src9", "Legal.rtf").otherwise(F.concat(F.col("source"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file"), name.alias("file_name"), F.col("source").alias("file_stem"))


FILE_NAME_SQL = "CASE WHEN d.source = 'src9' THEN 'Legal.rtf' ELSE d.source || '.txt' END"
