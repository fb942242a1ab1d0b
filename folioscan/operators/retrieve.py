"""Search: BM25 over phrases, hard filters, match signals, rerank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan import config as C
from folioscan.functions import text as T
from folioscan.sources import store

from .index import Index, part, places_of

DIGITS = 6


def operands(queries: DataFrame) -> DataFrame:
    """query_id, operand, words: the tokens of a query, and before them its
    whole text if it has more than one.  Repeated tokens stay."""
    parts = F.when(F.size("tokens") > 1, F.concat(F.array("normalized_text"), "tokens")).otherwise(F.col("tokens"))
    each = queries.select("query_id", F.posexplode(parts).alias("operand", "phrase"))
    return each.select("query_id", "operand", T.index_terms(F.col("phrase")).alias("words")).filter(F.size("words") > 0)


def phrase_starts(slots: DataFrame, places: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """slots: phrase, n, j, term (word j of a phrase of n; a prefix has several
    rows).  phrase, chunk_id, col, start of every occurrence.

    Single words are read straight.  For longer phrases the rarest word gives the
    places where one may stand, and those are checked word by word, so that
    frequent words are not multiplied out.  counts: term, cf, if known."""
    terms = places.join(slots.select("term").distinct(), "term", "left_semi")
    singles = terms.join(slots.filter("n = 1").select("phrase", "term"), "term").select("phrase", "chunk_id", "col", F.col("pos").alias("start"))
    many = slots.filter("n > 1")
    if counts is None:
        counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    first = _rarest(many, counts)
    starts = places.join(first, "term").select("phrase", "n", "j", "chunk_id", "col", (F.col("pos") - F.col("j")).alias("start"))
    # written: few as a rule, so that the places are then read without an exchange
    starts = store.stored(starts.filter("start >= 0"), "phrase-starts")
    other = F.explode(F.expr("filter(sequence(0, n - 1), x -> x <> j)"))
    wanted = starts.withColumn("i", other).drop("j").withColumnRenamed("i", "j").withColumn("pos", F.col("start") + F.col("j"))
    found = (
        places.join(many.select("term").distinct(), "term", "left_semi")
        .join(wanted, ["chunk_id", "col", "pos"])
        .join(many.select("phrase", "j", "term"), ["phrase", "j", "term"], "left_semi")
        .groupBy("phrase", "n", "chunk_id", "col", "start")
        .agg(F.count(F.lit(1)).alias("hits"))
        .filter("hits = n - 1")
        .select("phrase", "chunk_id", "col", "start")
    )
    return singles.unionByName(found)


def _rarest(slots: DataFrame, counts: DataFrame) -> DataFrame:
    """The slots of each phrase's rarest word."""
    rarest = (
        slots.join(counts.select("term", "cf"), "term", "left")
        .groupBy("phrase", "n", "j")
        .agg(F.sum(F.coalesce("cf", F.lit(0))).alias("cf"))
        .groupBy("phrase", "n")
        .agg(F.min(F.struct("cf", "j")).alias("r"))
        .select("phrase", "n", "r.j")
    )
    return slots.join(rarest, ["phrase", "n", "j"]).select("phrase", "n", "j", "term")


def scanned_starts(slots: DataFrame, index: Index, counts: DataFrame | None = None) -> DataFrame:
    """As phrase_starts, with the length of the chunk, in one pass over the words of
    a scan_index: at a place of the rarest word the words around it are compared at
    once.  phrase is the words of a phrase, a * behind the last if it is a prefix.
    Slots come from the batch of questions, so they are small beside the texts."""
    # written, so that it is known to be small
    counts = index.counts(slots.select("term")) if counts is None else counts
    asked = F.broadcast(store.stored(_rarest(slots, counts), "rarest-words"))
    found = places_of(index.words).join(asked, "term").withColumn("start", F.col("pos") - F.col("j"))
    # in functions that Spark compiles: as rows of their own the words around would be copied at each place
    here = F.array_join(F.slice("around", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n")), " ")
    begins = F.endswith("phrase", F.lit("*")) & F.startswith(here, F.expr("left(phrase, length(phrase) - 1)"))
    kept = found.filter((F.col("n") == 1) | ((F.col("start") >= 0) & ((here == F.col("phrase")) | begins)))
    return kept.select("phrase", "chunk_id", "length", "col", "start")


def slots_of(phrases: DataFrame) -> DataFrame:
    """phrases: words (array).  phrase (joined words), n, j, term."""
    named = phrases.select(F.array_join("words", " ").alias("phrase"), "words").distinct()
    return named.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("j", "term"))


def phrase_frequencies(phrases: DataFrame, places: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """phrases: distinct words (array).  phrase, chunk_id, f: how often the phrase
    stands in a chunk, in one column."""
    return phrase_starts(slots_of(phrases), places, counts).groupBy("phrase", "chunk_id").agg(F.count(F.lit(1)).alias("f"))


def _held(phrases: DataFrame, index: Index, counts: DataFrame) -> DataFrame:
    """phrases: words.  phrase, chunk_id, length, f."""
    if index.words is None:
        return phrase_frequencies(phrases, index.live(index.postings), counts).join(index.lengths, "chunk_id")
    starts = scanned_starts(store.stored(slots_of(phrases), "phrase-slots"), index, counts)
    return starts.groupBy("phrase", "chunk_id", "length").agg(F.count(F.lit(1)).alias("f"))


def weight(n: Column, n_p: Column) -> Column:
    idf = F.ln((n - n_p + 0.5) / (n_p + 0.5))
    return F.when(idf <= 0, C.BM25_FLOOR).otherwise(idf)


def _average() -> Column:
    return F.col("total") / F.col("n_chunks")


@dataclass(frozen=True)
class Asked:
    """singles: query_id, term, times, idf (terms that are held); longs: query_id,
    chunk_id, gain of operands of several words; sizes: one row."""

    singles: DataFrame
    longs: DataFrame
    sizes: DataFrame


def _weighed(queries: DataFrame, index: Index) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Repeated operands count again.  Weights of single terms come from the index,
    those of phrases from their own search.  (query_id, term, times, idf) of terms,
    and of phrases; phrase, chunk_id, length, f; and the sizes."""
    wanted = operands(queries).withColumn("phrase", F.array_join("words", " "))
    repeated = store.stored(
        wanted.groupBy("query_id", "phrase", "words").agg(F.count(F.lit(1)).alias("times")), "asked-operands"
    )
    # sizes is one row
    sizes = index.sizes.select(F.col("n").alias("n_chunks"), "total")
    one = F.size("words") == 1
    idf = lambda df: weight(F.col("n_chunks"), F.col(df)).alias("idf")
    named = repeated.select("query_id", F.col("phrase").alias("term"), "words", "times")
    # one row per word of the batch
    counts = store.stored(index.counts(repeated.select(F.explode("words").alias("term"))), "asked-counts")
    singles = named.filter(one).join(counts, "term").join(F.broadcast(sizes)).select("query_id", "term", "times", idf("df"))
    several = named.filter(~one)
    freq = store.stored(_held(several.select("words"), index, counts), "phrase-frequencies")
    # one row per phrase of the batch
    spread = store.stored(freq.groupBy(F.col("phrase").alias("term")).agg(F.count(F.lit(1)).alias("n_p")), "phrase-counts")
    longs = several.join(spread, "term").join(F.broadcast(sizes)).select("query_id", "term", "times", idf("n_p"))
    return singles, longs, freq, sizes


def asked(queries: DataFrame, index: Index) -> Asked:
    singles, longs, freq, sizes = _weighed(queries, index)
    held = freq.withColumnRenamed("phrase", "term").join(longs, "term").join(F.broadcast(sizes))
    gain = F.col("times") * F.col("idf") * part(F.col("f"), F.col("length"), _average())
    each = held.groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("gain"))
    return Asked(store.stored(singles, "asked-terms"), store.stored(each, "asked-phrases"), sizes)


def _entries(chosen: DataFrame, index: Index) -> DataFrame:
    """chosen: blocks, with query_id, times, idf and the sizes.  query_id, term,
    chunk_id, gain."""
    more = [c for c in ("segment",) if c in chosen.columns]
    each = chosen.select("query_id", "term", "times", "idf", "n_chunks", "total", *more, F.explode("entries").alias("e"))
    each = each.select("query_id", "term", "times", "idf", "n_chunks", "total", *more, "e.*")
    gain = F.col("times") * F.col("idf") * part(F.col("f"), F.col("length"), _average())
    return index.live(each).select("query_id", "term", "chunk_id", gain.alias("gain"))


def _raw(gain: Column) -> Column:
    return (F.round(-F.sum(gain), DIGITS) + F.lit(0.0)).alias("raw_score")


def bm25(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, chunk_id, raw_score of every chunk that holds an operand: lower is
    better.  Every operand counts, repeated ones again."""
    if index.blocks is None:
        each = _scanned(queries, index)
    else:
        it = asked(queries, index)
        found = _entries(index.blocks.join(it.singles, "term").join(F.broadcast(it.sizes)), index)
        each = found.select("query_id", "chunk_id", "gain").unionByName(it.longs)
    return each.groupBy("query_id", "chunk_id").agg(_raw(F.col("gain")))


def _scanned(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, chunk_id, gain from the words of a scan_index.  A phrase that a
    chunk holds is one more word of it, as often as it stands there, so that sums over
    a chunk need no exchange."""
    singles, longs, freq, sizes = _weighed(queries, index)
    held = freq.groupBy("chunk_id").agg(F.collect_list(F.struct(F.col("phrase").alias("term"), "f")).alias("phrases"))
    whole = index.words.join(held.hint("shuffle_hash"), "chunk_id", "left")
    more = F.flatten(F.transform("phrases", lambda p: F.array_repeat(p["term"], p["f"].cast("int"))))
    listed = F.when(F.col("phrases").isNull(), F.flatten("words")).otherwise(F.concat(F.flatten("words"), more))
    each = whole.select("chunk_id", "length", F.explode(listed).alias("term"))
    # the operands of the batch are small beside the texts
    weights = F.broadcast(store.stored(singles.unionByName(longs), "asked-weights"))
    wanted = F.broadcast(store.stored(weights.select("term").distinct(), "weighed-terms"))
    each = each.join(wanted, "term", "left_semi")
    each = each.groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("f"))
    gain = F.col("times") * F.col("idf") * part(F.col("f"), F.col("length"), _average())
    return each.join(weights, "term").join(F.broadcast(sizes)).select("query_id", "chunk_id", gain.alias("gain"))


#: More than rounding can do to a sum of gains.
SLACK = 1e-5


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    rows = Window.partitionBy("query_id").orderBy(F.desc("gain"))
    ranked = sums.withColumn("n", F.row_number().over(rows)).filter(F.col("n") == k)
    return ranked.select("query_id", (F.col("gain") - SLACK).alias(name))


def term_bounds(it: Asked, index: Index) -> DataFrame:
    """query_id, term, times, idf, best (what the best blocks of the term are like),
    most (what the term can add)."""
    bound = part(F.col("most_f"), F.col("least_length"), _average())
    light = index.blocks.select("term", "most_f", "least_length").join(it.singles.select("term").distinct(), "term", "left_semi")
    best = F.max_by(F.struct("most_f", "least_length"), bound).alias("best")
    tops = light.join(F.broadcast(it.sizes)).groupBy("term").agg(F.max(bound).alias("top"), best)
    return it.singles.join(tops, "term").withColumn("most", F.col("times") * F.col("idf") * F.col("top")).drop("top")


#: Of the least k-th score: what the terms that are left out at first may add.
LIGHT = 0.5


def needed_blocks(it: Asked, bounds: DataFrame, index: Index, k: int) -> tuple[DataFrame, DataFrame]:
    """The blocks that are read for the k best chunks of each query (with query_id,
    times and idf), and per query floor and light.

    The best block of every term gives sums that the k-th score cannot be below:
    floor.  The least of a query's terms that together add no more than light, a
    share of the floor, are left out, and so is a block whose bound stays below the
    floor with all that other terms may add."""
    bound = part(F.col("most_f"), F.col("least_length"), _average())
    # the best blocks of a term: usually one
    heads = index.blocks.join(
        bounds.select("query_id", "term", "times", "idf", F.col("best.most_f").alias("most_f"), F.col("best.least_length").alias("least_length")),
        ["term", "most_f", "least_length"],
    ).join(F.broadcast(it.sizes))
    sums = _entries(heads, index).select("query_id", "chunk_id", "gain").unionByName(it.longs).groupBy("query_id", "chunk_id").agg(F.sum("gain").alias("gain"))
    longest = it.longs.groupBy("query_id").agg(F.max("gain").alias("long"))
    total = bounds.groupBy("query_id").agg(F.sum("most").alias("all"))
    rising = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rated = (
        bounds.withColumn("upto", F.sum("most").over(rising))
        .join(_kth(sums, k, "floor"), "query_id", "left").join(longest, "query_id", "left").join(total, "query_id")
        .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        .withColumn("heavy", F.col("upto") >= LIGHT * F.col("floor"))
        .withColumn("rest", F.col("all") - F.col("most") + F.coalesce("long", F.lit(0.0)))
    )
    rated = store.stored(rated.select("query_id", "term", "times", "idf", "most", "rest", "floor", "heavy"), "rated-terms")
    blocks = index.blocks.join(rated.filter("heavy"), "term").join(F.broadcast(it.sizes))
    limits = rated.groupBy("query_id").agg(F.max("floor").alias("floor"), F.sum(F.when(~F.col("heavy"), F.col("most")).otherwise(0.0)).alias("light"))
    return blocks.filter(F.col("times") * F.col("idf") * bound + F.col("rest") >= F.col("floor")), limits


def top_scores(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The rows of bm25 with rank up to k, ties by chunk_id, without scoring all.

    Of a chunk among the k best no needed block is left out, so light terms are all
    that it can gain beyond the sum of those blocks: chunks that stay below the
    k-th sum even so go before anything else is read, and what is left is scored in
    full from the chunks' profiles.  An index without blocks has no bounds to leave
    anything out by: there the best are taken where the chunks lie."""
    if index.blocks is None:
        return top(bm25(queries, index), "raw_score", k)
    it = asked(queries, index)
    blocks, limits = needed_blocks(it, store.stored(term_bounds(it, index), "term-bounds"), index, k)
    seen = _entries(blocks, index).select("query_id", "chunk_id", "gain").unionByName(it.longs)
    sums = store.stored(seen.groupBy("query_id", "chunk_id").agg(F.sum("gain").alias("gain")), "partial-scores")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    reach = sums.join(_kth(sums, k, "second"), "query_id", "left").join(limits, "query_id", "left")
    least = F.greatest(zero("floor"), zero("second"))
    left = reach.filter(F.col("gain") + zero("light") + SLACK >= least).select("query_id", "chunk_id")
    left = store.stored(left, "scored-in-full")
    held = index.live(index.profiles.join(left.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    each = left.join(held, "chunk_id").select("query_id", "chunk_id", "length", F.explode("freqs").alias("e"))
    gain = F.col("times") * F.col("idf") * part(F.col("e.f"), F.col("length"), _average())
    exact = (
        each.withColumn("term", F.col("e.term")).join(it.singles, ["query_id", "term"]).join(F.broadcast(it.sizes))
        .select("query_id", "chunk_id", gain.alias("gain"))
        .unionByName(it.longs.join(left, ["query_id", "chunk_id"], "left_semi"))
    )
    return top(exact.groupBy("query_id", "chunk_id").agg(_raw(F.col("gain"))), "raw_score", k)


def top(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows of each query, with rank; ties by chunk_id."""
    rows = Window.partitionBy("query_id").orderBy(score, "chunk_id")
    return scores.withColumn("rank", F.row_number().over(rows)).filter(F.col("rank") <= k)


def rejection(constraints: C.Constraints) -> Column:
    """The first failing hard filter in words; null if all pass."""
    reason = F.lit(None).cast("string")
    checks = (
        ("edition", constraints.editions),
        ("source_type", constraints.source_types),
        ("authority_level", constraints.authority_levels),
    )
    reason = F.when(
        F.coalesce("source_id", F.lit("")).isin(*constraints.excluded) if constraints.excluded else F.lit(False),
        F.format_string("source_id '%s' is explicitly excluded", "source_id"),
    )
    for name, allowed in reversed(checks):
        value = F.coalesce(name, F.lit(""))
        listed = "[" + ", ".join(f"'{v}'" for v in sorted(allowed)) + "]"
        bad = ~value.isin(*allowed) if allowed else F.lit(True)
        reason = F.when(bad, F.concat(F.lit(f"{name} '"), value, F.lit(f"' not in {listed}"))).otherwise(reason)
    return reason


def match_signals(found: DataFrame) -> DataFrame:
    """found: normalized_text, protected_phrases, tokens, content, section_path.
    Adds exact_phrase_hits, protected_phrase_hits, section_path_hit,
    token_overlap_count."""
    path = F.lower(F.array_join("section_path", " "))
    hay = F.concat(path, F.lit(" "), F.lower("content"))
    text, phrases = F.col("normalized_text"), F.col("protected_phrases")
    hit = lambda where: lambda p: T.has_phrase(where, F.lower(p))
    terms = F.array_distinct(F.flatten(F.transform("tokens", lambda t: T.words(F.lower(t)))))
    return found.withColumns(
        {
            "exact_phrase_hits": F.when(T.has_phrase(hay, text), F.array(text)).otherwise(F.array().cast("array<string>")),
            "protected_phrase_hits": F.filter(phrases, hit(hay)),
            "section_path_hit": T.has_phrase(path, text) | F.exists(phrases, hit(path)),
            "token_overlap_count": F.size(F.array_intersect(terms, T.words(hay))),
        }
    )


def composite_score() -> Column:
    prior = F.coalesce(
        reduce(lambda acc, kv: acc.when(F.col("chunk_type") == kv[0], kv[1]), C.TYPE_PRIOR.items(), F.when(F.lit(False), 0.0)),
        F.lit(0.0),
    )
    score = (
        F.col("raw_score")
        - F.when(F.col("section_path_hit"), C.PATH_BOOST).otherwise(0.0)
        - F.size("exact_phrase_hits") * C.EXACT_BOOST
        - F.size("protected_phrase_hits") * C.PROTECTED_BOOST
        - F.col("token_overlap_count") * C.OVERLAP_BOOST
        - prior
    )
    return F.round(score, DIGITS)


def rejected(queries: DataFrame, index: Index, constraints: C.Constraints, k: int = 10) -> DataFrame:
    """query_id, chunk_id and reason of what the search found and the hard
    filters refused, among the 2k rows that retrieve looks at."""
    first = top_scores(queries, index, 2 * k).select("query_id", "chunk_id")
    told = first.join(index.live(index.chunks), "chunk_id").select("query_id", "chunk_id", rejection(constraints).alias("reason"))
    return told.filter("reason is not null")


def retrieve(queries: DataFrame, index: Index, constraints: C.Constraints | None, k: int = 10, prefilter: bool = False) -> DataFrame:
    """Ranked candidates of every query.  The search takes 2k, hard filters and
    the rerank work on those, so fewer than k may be left; prefilter=True
    filters before the search takes its rows; constraints None filters nothing."""
    refused = F.lit(None).cast("string") if constraints is None else rejection(constraints)
    meta = index.live(index.chunks)
    if prefilter:
        admitted = meta.filter(refused.isNull()).select("chunk_id")
        first = top(bm25(queries, index).join(admitted, "chunk_id", "left_semi"), "raw_score", 2 * k)
    else:
        first = top_scores(queries, index, 2 * k)
    # few: at most 2k a query
    found = store.stored(first.drop("rank"), "first-rows").join(meta, "chunk_id").filter(refused.isNull())
    about = queries.select("query_id", "normalized_text", "tokens", "protected_phrases")
    rated = match_signals(found.join(about, "query_id")).withColumn("score", composite_score())
    return top(rated, "score", k)
