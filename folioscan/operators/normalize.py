"""Questions to normalized queries; a batch is a table, and so is the vocabulary."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.config import QUESTION_WORDS, TermAssets
from folioscan.functions import text as T
from folioscan.sources import store

EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Most aliases that follow one another in one text.
ROUNDS = 1_000


@dataclass(frozen=True)
class Vocabulary:
    """aliases: ord, source, target, applied in that order; phrases: phrase, which
    stay whole in tokens, surface variants among them.  Both may be large: they are
    joined to the runs of words of the texts.

    Phrases and sources begin and end with a word character, or are not found."""

    aliases: DataFrame
    phrases: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, assets: TermAssets) -> Vocabulary:
        listed = [(i, s, t) for i, (s, t) in enumerate(assets.aliases.items())]
        phrases = [(p,) for p in dict.fromkeys((*assets.phrases, *assets.variants))]
        return cls(spark.createDataFrame(listed, "ord long, source string, target string"), spark.createDataFrame(phrases, "phrase string"))


def _pieces(c: Column) -> Column:
    """Runs of word characters, and what is between them."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))


def found_in(texts: DataFrame, text: str, keys: list[str], phrases: DataFrame) -> DataFrame:
    """keys and the rows of phrases whose phrase stands in the text between word
    boundaries: runs of as many pieces as some phrase has are joined to them."""
    sized = phrases.withColumn("__n", F.size(_pieces(F.col("phrase"))))
    # a phrase has few words, so the distinct lengths are few
    lengths = [r[0] for r in sized.select("__n").distinct().orderBy("__n").collect() if r[0] > 0]
    if not lengths:
        return texts.select(*keys, F.lit(None).cast("string").alias("phrase")).filter("phrase is not null").join(sized.drop("__n"), "phrase")
    each = texts.select(*keys, _pieces(F.col(text)).alias("__p")).filter(F.size("__p") > 0)
    each = each.withColumn("__at", F.explode(F.expr("sequence(1, size(__p))")))
    each = each.filter(F.element_at("__p", F.col("__at")).rlike(r"^[\p{L}\p{N}_]"))
    runs = F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.array_join(F.slice("__p", F.col("__at"), n), "")))
    runs = each.select(*keys, F.explode(runs).alias("phrase")).distinct()
    return runs.join(sized.drop("__n"), "phrase")


def _literal(c: Column) -> Column:
    """A pattern of the text of a column itself, between word boundaries."""
    whole = F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(EDGE_L + r"\Q"), whole, F.lit(r"\E" + EDGE_R))


def _replacement(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def with_aliases(texts: DataFrame, text: str, key: str, aliases: DataFrame) -> DataFrame:
    """Replaces aliases in their order; what one puts in a later one may match.
    Adds aliases_applied.  Each round takes, per text, the next alias in order that
    stands in it; texts without one are done."""
    none = F.array().cast("array<string>")
    texts = texts.withColumn(text, T.strip(T.squeeze(F.col(text))))
    now = store.stored(texts.withColumns({"__last": F.lit(-1).cast("long"), "aliases_applied": none}), "alias-texts")
    listed, done = aliases.withColumnRenamed("source", "phrase"), []
    for _ in range(ROUNDS):
        hits = found_in(now, text, [key, "__last"], listed).filter("ord > __last")
        following = store.stored(hits.groupBy(key).agg(F.min(F.struct("ord", "phrase", "target")).alias("__a")), "alias-hits")
        if following.isEmpty():
            break
        done.append(now.join(following.select(key), key, "left_anti"))
        replaced = F.regexp_replace(F.col(text), _literal(F.col("__a.phrase")), _replacement(F.col("__a.target")))
        now = now.join(following, key).withColumns(
            {text: replaced, "__last": F.col("__a.ord"), "aliases_applied": F.concat("aliases_applied", F.array("__a.phrase"))}
        )
        now = store.stored(now.select(*texts.columns, "__last", "aliases_applied"), "alias-texts")
    else:
        raise RuntimeError("too many aliases follow one another in one text")
    return reduce(DataFrame.unionByName, [*done, now]).withColumn(text, T.strip(T.squeeze(F.col(text)))).drop("__last")


def tokens_of(text: Column, phrases: Column) -> Column:
    """Words of a text, with the phrases found in it whole: at each word the longest
    phrase that begins there, else the word alone."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    by_size = F.array_sort(F.transform(phrases, lambda p: F.struct((-F.size(F.split(p, " "))).alias("n"), p.alias("p"))))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        here = F.filter(by_size, lambda p: F.slice(words, i + 1, -p["n"]) == F.split(p["p"], " "))
        found = F.get(here, F.lit(0))
        long = F.struct((i - found["n"]).alias("next"), F.concat(s["out"], F.array(found["p"])).alias("out"))
        one = F.struct((i + 1).alias("next"), F.concat(s["out"], F.array(F.get(words, i))).alias("out"))
        return F.when(i < s["next"], s).when(found.isNotNull(), long).otherwise(one)

    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(every, start, step)["out"]


def ordered_phrases(assets: TermAssets) -> list[str]:
    return sorted({*assets.phrases, *assets.variants}, key=lambda p: (-len(p.split()), p))


def query_mode(raw: Column, normal: Column) -> Column:
    asks = "^(" + "|".join(QUESTION_WORDS) + ") "
    text = T.strip(raw)
    is_question = text.endswith("?") | F.lower(text).rlike(asks) | normal.rlike(asks)
    return F.when(is_question, "natural_language").otherwise("keyword_lookup")


def normalize(queries: DataFrame, known: TermAssets | Vocabulary = TermAssets()) -> DataFrame:
    """queries: query_id, raw_query.  Adds normalized_text, tokens,
    protected_phrases (longest first), aliases_applied, applied_rules, query_mode."""
    known = Vocabulary.of(queries.sparkSession, known) if isinstance(known, TermAssets) else known
    raw = F.col("raw_query")
    trimmed = T.strip(raw)
    low = T.casefold(trimmed)
    clean = F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " ")
    flat = T.strip(T.squeeze(clean))
    key = "__query"
    steps = queries.withColumn(key, F.monotonically_increasing_id())
    steps = steps.withColumns({"__trim": trimmed, "__low": low, "__clean": clean, "__flat": flat, "normalized_text": flat})
    named = with_aliases(steps, "normalized_text", key, known.aliases)
    rules = F.array_compact(
        F.array(
            F.when(F.col("__trim") != raw, F.lit("trim_whitespace")),
            F.when(F.col("__low") != F.col("__trim"), F.lit("case_fold")),
            F.when(F.col("__clean") != F.col("__low"), F.lit("punctuation_cleanup")),
            F.when(F.col("__flat") != F.col("__clean"), F.lit("whitespace_normalization")),
            F.when(F.size("aliases_applied") > 0, F.lit("alias_expansion")),
        )
    )
    hits = found_in(named, "normalized_text", [key], known.phrases.select("phrase").distinct())
    size = F.size(F.split("phrase", r"\s+"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-size).alias("n"), "phrase"))), lambda s: s["phrase"])
    hits = hits.groupBy(key).agg(listed.alias("protected_phrases"))
    none = F.array().cast("array<string>")
    whole = named.join(hits, key, "left").withColumn("protected_phrases", F.coalesce("protected_phrases", none))
    text = F.col("normalized_text")
    return whole.select(
        *queries.columns,
        "normalized_text",
        tokens_of(text, F.col("protected_phrases")).alias("tokens"),
        "protected_phrases",
        "aliases_applied",
        rules.alias("applied_rules"),
        query_mode(raw, text).alias("query_mode"),
    )
