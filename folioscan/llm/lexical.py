"""Ranked lexical search by TPUT over term-partitioned postings.

The index holds, per term, a list of (document, impact), where impact is all that
the term adds to a document's score.  Lists are range-partitioned by (term,
impact), so a frequent term lies in many partitions and each file starts with the
head of its lists.  A batch of items is answered in three phases:

1. the k first entries of every list give partial sums, and the k-th largest of an
   item's sums is a lower bound of its k-th score; the best of these documents are
   looked up, and the k-th of their exact scores is a higher one;
2. every list of an item is read down to the same threshold, the first bound divided
   by the number of the item's lists.  An entry not seen is below the threshold, so
   each document has an upper bound, and those that cannot reach the second bound,
   or the k-th largest sum seen, go;
3. what is left is looked up: its profile gives the exact score.

Texts that are equal word for word are one class, with the number and the least
doc_id of its documents, so that a third of all documents being copies is one
entry; classes are spread into their documents at the end.

Entries travel as (slice of items, bucket of documents), both bounded, so no task
holds a whole list.  Terms are numbered by their XXH64; where items ask for at most
VOCABULARY different terms, only those are indexed.

Defined results: null and empty texts have no terms and neither count nor match;
an item without terms, or none that any document holds, has no rows; equal scores
go by ascending doc_id, a null one last; repeated rows are documents (or items) of
their own; terms that nearly all documents hold weigh nothing; extra columns are
not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 10
#: Documents of the heads that are looked up for a bound, in multiples of k.
HEADS = 3
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
#: Most different terms that are sent to all tasks; beyond it all terms are kept.
VOCABULARY = 200_000
#: Entries of a bucket and items of a slice (about).
ENTRIES, ITEMS = 200_000, 512


def number(term: str) -> int:
    """The term's XXH64 as Spark gives it."""
    n = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42)
    return n - (n >> 63 << 64)


@dataclass(frozen=True)
class Index:
    """classes: cid, h1, h2, first_id, copies, n, m, terms, tfs.  weights: t, w.
    postings: t, cid, impact, by term and falling impact."""

    classes: DataFrame
    weights: DataFrame
    postings: DataFrame


def _hashes() -> list:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def _impact() -> F.Column:
    return F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")


def _profiles(docs: DataFrame, sent) -> DataFrame:
    def of(texts: pd.Series) -> pd.DataFrame:
        known, out = (sent.value if sent else None), []
        for text in texts:
            words = TERM.findall((text or "").translate(LOWER))
            counts = Counter(words)
            if known is None:
                pairs = [(number(w), c) for w, c in counts.items()]
            else:
                pairs = [(known[w], c) for w, c in counts.items() if w in known]
            out.append((len(words), [t for t, _ in pairs], [c for _, c in pairs]))
        return pd.DataFrame(out, columns=["n", "terms", "tfs"])

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(of, "n bigint, terms array<bigint>, tfs array<bigint>").asNondeterministic()("text")
    return docs.select("doc_id", *_hashes(), made.alias("p")).filter("p.n > 0")


def build_index(docs: DataFrame, vocabulary: list[str] | None = None) -> Index:
    """docs: doc_id, text.  With a vocabulary only its terms get lists; counts are
    those of whole texts either way."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({w: number(w) for w in vocabulary}) if vocabulary is not None else None
    classes = (
        _profiles(docs.select("doc_id", "text"), sent)
        .groupBy("h1", "h2")
        .agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
        .select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "first_id", "copies", "p.*")
    )
    classes = materialize(classes, "text-classes")
    all_ = classes.agg(F.sum("copies").alias("docs"), F.sum(F.col("copies") * F.col("n")).alias("words")).first()
    docs_n, words_n = all_["docs"] or 0, all_["words"] or 1
    # exact beyond 64 bits, too
    m = F.expr(f"10 + (cast(n as decimal(38, 0)) * {90 * docs_n}) div {words_n}")
    classes = classes.withColumn("m", m.cast("bigint"))
    held = classes.select(F.explode("terms").alias("t"), "copies").groupBy("t").agg(F.sum("copies").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs_n + 2) / (2 * F.col("df") + 1)))
    weights = materialize(held.select("t", weight.alias("w")).filter("w > 0"), "term-weights")
    each = classes.select("cid", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
    entries = each.select("cid", "m", F.col("e.terms").alias("t"), F.col("e.tfs").alias("tf")).join(weights, "t")
    entries = entries.select("t", "cid", _impact().alias("impact")).filter("impact > 0")
    falling = ["t", F.desc("impact"), "cid"]
    postings = materialize(entries.repartitionByRange(*falling).sortWithinPartitions(*falling), "postings")
    return Index(classes, weights, postings)


def _best(df: DataFrame, k: int, *order) -> DataFrame:
    rows = Window.partitionBy("iid").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(rows)).filter(F.col("rank") <= k)


def _exact(index: Index, asks: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: iid, cid.  iid, cid, score from the profiles of these classes."""
    profile = index.classes.join(pairs.select("cid").distinct(), "cid", "left_semi").select(
        "cid", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("e")
    )
    return (
        pairs.join(profile.select("cid", "m", F.col("e.terms").alias("t"), F.col("e.tfs").alias("tf")), "cid")
        .join(asks, ["iid", "t"])
        .groupBy("iid", "cid")
        .agg(F.sum(_impact()).alias("score"))
        .filter("score > 0")
    )


def _threshold(k: int):
    """Work on one bucket of documents and one slice of items: documents whose
    upper bound reaches what is known of the k-th score."""

    def of(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entries) and len(asked):
            t = entries["t"].to_numpy()
            order = np.argsort(t, kind="stable")
            t, impact = t[order], entries["impact"].to_numpy()[order]
            cids, at = np.unique(entries["cid"].to_numpy()[order], return_inverse=True)
            for iid, item in asked.groupby("iid"):
                terms, slack = item["t"].to_numpy(), item["slack"].to_numpy(dtype=float)
                least, known = int(item["least"].iloc[0]), float(item["known"].iloc[0])
                lo, hi = np.searchsorted(t, terms), np.searchsorted(t, terms, side="right")
                rows = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
                spent = np.repeat(slack, hi - lo)
                seen = impact[rows] >= least
                rows, spent = rows[seen], spent[seen]
                # sums of integers far below 2^53 are exact in doubles
                total = np.bincount(at[rows], weights=impact[rows], minlength=len(cids))
                upper = total + slack.sum() - np.bincount(at[rows], weights=spent, minlength=len(cids))
                if len(cids) >= k:
                    known = max(known, np.partition(total, -k)[-k])
                keep = np.flatnonzero((total > 0) & (upper >= known))
                found.append(pd.DataFrame({"iid": iid, "cid": cids[keep], "total": total[keep].astype(np.int64), "upper": upper[keep].astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame(columns=["iid", "cid", "total", "upper"])

    return of


def rank_classes(index: Index, asks: DataFrame, k: int = K) -> DataFrame:
    """asks: iid, t, each pair once.  iid, cid, score of the k best classes of each
    item by score, then least doc_id."""
    spark = asks.sparkSession
    asks = materialize(asks.join(index.weights, "t"), "asked-terms")
    # 1: the heads of the lists
    order = Window.partitionBy("t").orderBy(F.desc("impact"), "cid")
    wanted = index.postings.join(asks.select("t").distinct(), "t", "left_semi")
    heads = wanted.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
    heads = materialize(heads, "list-heads")
    sums = asks.select("iid", "t").join(heads, "t").groupBy("iid", "cid").agg(F.sum("impact").alias("sum"))
    first = materialize(_best(sums, HEADS * k, F.desc("sum"), "cid"), "head-sums")
    kth = first.filter(F.col("rank") == k).select("iid", F.col("sum").alias("partial"))
    scored = materialize(_exact(index, asks, first.select("iid", "cid")), "head-scores")
    known = _best(scored, k, F.desc("score"), "cid").filter(F.col("rank") == k).select("iid", F.col("score").alias("known"))
    lists = asks.groupBy("iid").agg(F.count(F.lit(1)).alias("lists"))
    bounds = lists.join(kth, "iid", "left").join(known, "iid", "left").select(
        "iid", F.coalesce("known", F.lit(0)).alias("known"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("partial", F.lit(0)) / F.col("lists"))).alias("least"),
    )
    # 2: all lists of an item down to one threshold
    most = heads.filter("at = 1").select("t", F.col("impact").alias("most"))
    asked = asks.join(most, "t").join(bounds, "iid").withColumn("slack", F.least(F.col("least") - 1, "most"))
    asked = materialize(asked, "asked-thresholds")
    facts = asked.agg(F.countDistinct("iid").alias("items"), F.min("least").alias("least")).first()
    n_slices = max(1, -(-facts["items"] // ITEMS))
    n_buckets = max(1, -(-index.postings.count() // ENTRIES))
    part = asked.withColumn("slice", F.pmod(F.xxhash64("iid"), F.lit(n_slices)).cast("int"))
    floors = part.groupBy("t", "slice").agg(F.min("least").alias("least"))
    entries = index.postings.filter(F.col("impact") >= (facts["least"] or 1)).join(floors, "t").filter("impact >= least")
    entries = entries.select(F.col("slice").alias("slice"), F.pmod(F.xxhash64("cid"), F.lit(n_buckets)).cast("int").alias("bucket"), "t", "cid", "impact")
    spread = part.select("slice", "iid", "t", "known", "least", "slack", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("bucket"))
    found = (
        entries.groupBy("slice", "bucket")
        .cogroup(spread.groupBy("slice", "bucket"))
        .applyInPandas(_threshold(k), "iid bigint, cid bigint, total bigint, upper bigint")
    )
    found = materialize(found, "candidates")
    second = _best(found, k, F.desc("total"), "cid").filter(F.col("rank") == k).select("iid", F.col("total").alias("second"))
    left = found.join(second, "iid", "left").filter("upper >= coalesce(second, 0)").select("iid", "cid")
    # 3: exact scores of what is left
    exact = _exact(index, asks, materialize(left, "looked-up"))
    named = exact.join(index.classes.select("cid", "first_id"), "cid")
    return materialize(_best(named, k, F.desc("score"), F.asc_nulls_last("first_id"), "cid").drop("rank"), "best-classes")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """docs: doc_id, text.  items: item_id, text.  item_id, rank, doc_id, score of
    the k best documents of each item."""
    spark = docs.sparkSession

    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(TERM.findall((t or "").translate(LOWER)))) for t in texts], dtype=object)

    terms.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    words = F.pandas_udf(terms, "array<string>").asNondeterministic()("text")
    asked = materialize(items.select("item_id", words.alias("words")).withColumn("iid", F.monotonically_increasing_id()), "items")
    each = asked.select("iid", F.explode("words").alias("word"))
    known = each.select("word").distinct()
    vocabulary = [r["word"] for r in known.collect()] if known.count() <= VOCABULARY else None
    index = build_index(docs, vocabulary)
    best = rank_classes(index, each.select("iid", F.xxhash64("word").alias("t")), k)
    facts = best.select("iid", "cid", "score").join(index.classes.select("cid", "h1", "h2", "copies", "first_id"), "cid")
    facts = materialize(facts, "best-facts")
    copied = facts.filter("copies > 1").select("cid", "h1", "h2").distinct()
    order = Window.partitionBy("cid").orderBy(F.asc_nulls_last("doc_id"))
    rows = docs.select("doc_id", *_hashes()).join(copied, ["h1", "h2"])
    ids = rows.select("cid", "doc_id", F.row_number().over(order).alias("at")).filter(F.col("at") <= k)
    each = facts.filter("copies = 1").select("iid", "score", F.col("first_id").alias("doc_id")).unionByName(
        facts.filter("copies > 1").join(ids, "cid").select("iid", "score", "doc_id")
    )
    ranked = _best(each, k, F.desc("score"), F.asc_nulls_last("doc_id"))
    return ranked.join(asked.select("iid", "item_id"), "iid").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}"""
