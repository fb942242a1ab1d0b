"""Term mining: phrases of titles and contents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.config import TERM_KEYWORDS, TERM_STOP_PHRASES, TERM_STOP_WORDS
from folioscan.functions import text as T
from folioscan.sources import store

from .normalize import Vocabulary

RUN = r"(?<![\p{L}\p{N}_])[a-z][a-z]+(?: [a-z][a-z]+){1,4}(?![\p{L}\p{N}_])"


def normal_phrase(c: Column) -> Column:
    c = F.regexp_replace(F.translate(T.casefold(c), "_-", "  "), r"\([^)]*\)", " ")
    return T.strip(T.squeeze(F.regexp_replace(c, r"[^a-z0-9\s/]", " ")))


def acceptable(c: Column) -> Column:
    w = F.split(c, " ")
    return (
        (c != "")
        & ~c.isin(*TERM_STOP_PHRASES)
        & F.size(w).between(2, 5)
        & ~c.rlike("^[0-9]")
        & ~F.get(w, F.lit(0)).isin(*TERM_STOP_WORDS)
        & ~F.arrays_overlap(w, F.array(F.lit("license"), F.lit("copyright")))
        & ~c.contains("spell list")
        & ~c.contains("power list")
    )


def title_terms(docs: DataFrame) -> DataFrame:
    """docs: document_title, section_path.  Distinct acceptable phrases of titles
    and of all path elements but the first."""
    names = F.concat(F.array("document_title"), F.slice("section_path", 2, F.greatest(F.size("section_path"), F.lit(1))))
    phrases = docs.select(F.explode(names).alias("name")).select(normal_phrase(F.col("name")).alias("phrase"))
    return phrases.filter(acceptable(F.col("phrase"))).distinct()


def content_terms(chunks: DataFrame) -> DataFrame:
    """Counts of runs of 2 to 5 plain lower-cased words, left to right without
    overlap.  A run is a normal phrase already, so runs are counted, per task
    before the exchange, and only distinct ones are judged."""
    runs = chunks.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(RUN), F.lit(0))).alias("phrase"))
    counted = runs.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(acceptable(F.col("phrase")))


def term_buckets(titles: DataFrame, counts: DataFrame, promote: int = 3, keep: int = 4) -> DataFrame:
    """phrase, is_protected (a title, or promoted by a keyword), is_content.  Each
    phrase once, with both of its marks: the corpus is read once."""
    keyword = F.arrays_overlap(F.split("phrase", " "), F.array(*map(F.lit, TERM_KEYWORDS)))
    zero = F.lit(0).cast("long")
    seen = titles.select("phrase", F.lit(True).alias("title"), zero.alias("n")).unionByName(
        counts.filter(F.col("n") >= min(promote, keep)).select("phrase", F.lit(False).alias("title"), "n")
    )
    by = seen.groupBy("phrase").agg(F.bool_or("title").alias("title"), F.max("n").alias("n"))
    return by.select(
        "phrase",
        (F.col("title") | ((F.col("n") >= promote) & keyword)).alias("is_protected"),
        (F.col("n") >= keep).alias("is_content"),
    ).filter("is_protected or is_content")


#: The files of term assets that people review; candidates are a folder beside them.
REVIEWED = {"protected_phrases": list, "canonical_aliases": dict, "surface_variants": list}
CANDIDATES = "extraction_candidates"


def write_term_assets(
    buckets: DataFrame, root: str, reviewed: list[str] = (), aliases: dict[str, str] | None = None, variants: list[str] = ()
) -> list[str]:
    """One JSON file each for the reviewed phrases, aliases and surface variants, as
    given, and the mined phrases of term_buckets as candidates for review: text
    files, written by the executors in order, one phrase a line."""
    spark = buckets.sparkSession
    values = {"protected_phrases": sorted(set(reviewed)), "canonical_aliases": dict(aliases or {}), "surface_variants": sorted(set(variants))}
    for name, value in values.items():
        store.remove(spark, f"{root}/{name}.json")
        store.create_text(spark, f"{root}/{name}.json", json.dumps(value, indent=2, ensure_ascii=True) + "\n")
    buckets.select("phrase").distinct().orderBy("phrase").write.mode("overwrite").text(f"{root}/{CANDIDATES}")
    return sorted([*(f"{name}.json" for name in values), CANDIDATES])


def read_vocabulary(spark: SparkSession, root: str) -> Vocabulary:
    """The vocabulary of a folder that write_term_assets has written.  In place of a
    JSON file there may be a folder: of text lines for phrases and variants, of
    JSON lines (ord, source, target) for aliases, for lists of any length.  A
    missing or mistyped asset is an error."""

    def phrases(name: str) -> DataFrame:
        if store.exists(spark, f"{root}/{name}"):
            return spark.read.text(f"{root}/{name}").select(F.col("value").alias("phrase"))
        return spark.createDataFrame([(p,) for p in listed(name)], "phrase string")

    def listed(name: str):
        value = json.loads(store.read_text(spark, f"{root}/{name}.json"))
        strings = [*value, *value.values()] if isinstance(value, dict) else value
        if not isinstance(value, REVIEWED[name]) or not all(isinstance(v, str) for v in strings):
            raise ValueError(f"{name}.json is not a {REVIEWED[name].__name__} of texts")
        return value

    if store.exists(spark, f"{root}/canonical_aliases"):
        aliases = spark.read.schema("ord long, source string, target string").json(f"{root}/canonical_aliases", mode="FAILFAST")
    else:
        rows = [(i, s, t) for i, (s, t) in enumerate(listed("canonical_aliases").items())]
        aliases = spark.createDataFrame(rows, "ord long, source string, target string")
    both = phrases("protected_phrases").unionByName(phrases("surface_variants"))
    return Vocabulary(aliases, both.filter("phrase <> ''").distinct())
