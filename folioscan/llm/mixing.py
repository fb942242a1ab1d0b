"""Mixing sources to target weights.

A low-discrepancy schedule deals slots to the sources: the golden-ratio points
frac(i * phi), as whole numbers of 80 bits, are mapped through the cumulative shares of the sources, the slots
of a source are ranked, and slot k of a source takes the k-th equal-token block
of that source's shuffled words, starting over at its end.  The schedule alone
says what is taken and when: a source gets the slots its points fall to, up to
its need, and the mix is read in the order of the points.  Only DataFrame
functions are used.

A share of k slots out of n is an interval of length k / n.  The gaps between the
first 2n golden-ratio points are below 1.9 / 2n (three-gap theorem), so at least
k of these points fall into it: 2n points serve every source in full.  The points
are exact (i times a whole number, modulo 2^80), and so are the bounds of the
intervals; that number is as far from small fractions as the golden ratio itself
up to about 2^39 points, and a mix with more slots than that is an error.  Should a
source be served fewer slots than it needs, the mix is an error too.

Defined results: a null or empty text has size 0 and is taken 0 times; null
sources form one source, the last; repeated rows are separate rows; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, running_sum

#: A word is a run of characters that are none of these: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Points are whole numbers below 2^BITS; TURN is 2^BITS over the golden ratio, odd.
BITS = 80
TURN = (isqrt(5 << 2 * BITS) - (1 << BITS)) >> 1 | 1
#: Points per slot (see above), and the most slots of a mix.
POINTS, MAX_SLOTS = 2, 2**38


@dataclass(frozen=True)
class MixConfig:
    """weights repeat over the sources in order; max_repeats is how often a
    word may be taken; block is the number of words of a slot; seed shuffles;
    rows_per_chunk bounds what one task orders; broadcast_sources is the most
    sources whose table is broadcast (one row of five numbers and a name each),
    beyond it they are joined by shuffle."""

    weights: tuple[int, ...] = (1, 2, 3)
    max_repeats: int = 3
    block: int = 4_096
    seed: int = 20_231
    rows_per_chunk: int = 200_000
    broadcast_sources: int = 20_000
    grid: int = 4_096


def source_targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """One row per source: sid, source, source_size, target.

    Water filling in closed form: in the order of cap / weight a source is
    capped if its cap is at most its share of what the capped ones before it
    leave; the uncapped ones share the rest by weight."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in config.weights])
    every = Window.partitionBy()
    ranked = by.withColumn("sid", rank).select(
        "*",
        F.element_at(cycle, (F.col("sid") % len(config.weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * F.lit(float(config.max_repeats))).alias("cap"),
    )
    up = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(
        Window.unboundedPreceding, 0
    )
    left = ranked.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))).alias(
            "words_left"
        ),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0))).alias("w_left"),
        F.sum("source_size").over(every).alias("total"),
    )
    full = left.withColumn(
        "full",
        F.min((F.col("cap") * F.col("w_left") <= F.col("w") * F.col("words_left")).cast("int")).over(
            upto
        )
        == 1,
    )
    rate = (
        F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    ) / F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return full.withColumn(
        "target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * rate)
    ).select("sid", "source", "source_size", "target")


def quotas(targets: DataFrame, block: int) -> DataFrame:
    """Adds per source: n_blocks, full (whole passes over its words), rest
    (words of the last, partial pass) and need (slots)."""
    size, quota = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    return (
        targets.withColumn("n_blocks", F.ceil(size / F.lit(block)).cast("long"))
        .withColumn("full", F.when(size > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", (quota - F.col("full") * size).cast("long"))
        .withColumn(
            "need",
            (F.col("full") * F.col("n_blocks") + F.ceil(F.col("rest") / F.lit(block))).cast("long"),
        )
    )


def _whole(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(25, 0)")


def _div(a: Column, b: Column) -> Column:
    """Whole division of decimals; the result is below 2^63 wherever it is used."""
    return F.call_function("div", a.cast("decimal(38, 0)"), b.cast("decimal(38, 0)"))


def point(i: Column) -> Column:
    """Point i of the schedule, below 2^BITS; exact for i below 2^40."""
    return i.cast("decimal(13, 0)") * _whole(TURN) % _whole(1 << BITS)


def bound(before: Column, slots: Column) -> Column:
    """The least point that is not below before / slots of all, exactly: the
    quotient of before * 2^BITS and slots in two halves."""
    half = _whole(1 << BITS // 2)
    first = before.cast("decimal(13, 0)") * half
    rest = (first % slots.cast("decimal(13, 0)")).cast("decimal(13, 0)") * half
    more = F.when(rest % slots.cast("decimal(13, 0)") > 0, 1).otherwise(0)
    return (_div(first, slots).cast("decimal(13, 0)") * half + _div(rest, slots).cast("decimal(13, 0)") + more).cast("decimal(25, 0)")


def _cell(c: Column, config: MixConfig) -> Column:
    return _div(c, _whole((1 << BITS) // config.grid))


def schedule(plan: DataFrame, n_slots: int, config: MixConfig) -> DataFrame:
    """The mix: one row per slot with position, sid, rank, block and words (how
    many words of the block it takes; only a source's last slot takes fewer).
    Points beyond a source's need are passed over."""
    spark, block = plan.sparkSession, config.block
    if n_slots > MAX_SLOTS:
        raise ValueError(f"a mix of {n_slots} slots: take larger blocks, at most {MAX_SLOTS} slots are dealt")
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("need").over(Window.partitionBy())
    spans = (
        plan.filter("need > 0")
        .select(
            "*",
            F.coalesce(F.sum("need").over(upto), F.lit(0)).alias("before"),
            total.alias("slots"),
        )
        .select(
            "sid",
            bound(F.col("before"), F.col("slots")).alias("lo"),
            bound(F.col("before") + F.col("need"), F.col("slots")).alias("hi"),
        )
    )
    cells = spans.withColumn(
        "cell",
        F.explode(F.sequence(_cell(F.col("lo"), config), _cell(F.col("hi") - 1, config))),
    )
    points = spark.range(POINTS * n_slots).withColumn("u", point(F.col("id")))
    points = points.withColumn("cell", _cell(F.col("u"), config))
    dealt = materialize(
        points.join(cells, "cell")
        .filter("u >= lo and u < hi")
        .select("id", "sid", F.expr("id div 65536").alias("part"), F.lit(1).alias("one")),
        "mix-dealt",
    )
    ranked = running_sum(dealt, ["sid"], "part", ["id"], "one", "rank").select("id", "sid", "rank")
    short = dealt.groupBy("sid").agg(F.count(F.lit(1)).alias("served")).join(plan.filter("need > 0"), "sid", "right")
    if not short.filter("coalesce(served, 0) < need").isEmpty():
        raise RuntimeError("the points serve a source fewer slots than it needs")
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    last = F.col("rest") - (F.col("need") - 1 - F.col("full") * F.col("n_blocks")) * block
    return (
        ranked.join(plan, "sid")
        .filter("rank < need")
        .withColumn("block", F.col("rank") % F.col("n_blocks"))
        .select(
            F.col("id").alias("position"),
            "sid",
            "rank",
            "block",
            F.when((F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0), last)
            .otherwise(length)
            .alias("words"),
        )
    )


def _measured(docs: DataFrame, config: MixConfig, columns: list[str]) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    shuffled = F.xxhash64(F.lit(config.seed), "doc_id", "text").alias("h")
    row = F.xxhash64(F.lit(config.seed), *columns).alias("row")
    return materialize(docs.select("doc_id", "source", size.alias("size"), shuffled, row), "mix-sizes")


def _placed(docs: DataFrame, config: MixConfig, columns: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Each document's place in its source's shuffled words (start), the source
    plan and the number of slots.  columns are what tells rows apart."""
    sizes = _measured(docs, config, columns)
    n_rows = sizes.count()
    plan = materialize(quotas(source_targets(sizes, config), config.block), "mix-plan")
    n_sources, n_slots = plan.agg(F.count(F.lit(1)), F.sum("need")).first()
    n_chunks = max(64, -(-n_rows // config.rows_per_chunk))
    keyed = plan.select("sid", F.col("source").alias("source_name"))
    known = sizes.join(
        F.broadcast(keyed) if n_sources <= config.broadcast_sources else keyed,
        F.col("source").eqNullSafe(F.col("source_name")),
    ).drop("source_name")
    # the shuffled order is the order of h; its leading bits are the chunk
    step = -(-(2**63) // n_chunks) * 2
    chunked = known.withColumn("chunk", F.expr(f"(h div 2 + {2**62}) div {step // 2}"))
    placed = running_sum(chunked, ["sid"], "chunk", ["h", "doc_id", "row", "size"], "size", "start")
    return materialize(placed.drop("chunk"), "mix-placed"), plan, n_slots or 0


def _visits(plan: DataFrame, n_slots: int, config: MixConfig) -> DataFrame:
    """Per block of a source the slots that take it, as (position, words): at
    most max_repeats and one partial."""
    return (
        schedule(plan, n_slots, config)
        .groupBy("sid", "block")
        .agg(F.collect_list(F.struct("position", "words")).alias("visits"))
    )


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target,
    taken, the words that the schedule takes of the document, repeats counted,
    and first_position, where the mix first takes of it (null: nowhere)."""
    placed, plan, n_slots = _placed(docs, config, ["doc_id", "text"])
    block = config.block
    end = F.col("start") + F.col("size")
    pieces = (
        placed.filter("size > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        .withColumn("from", F.greatest("start", F.col("block") * block) - F.col("block") * block)
        .withColumn("to", F.least(end, (F.col("block") + 1) * block) - F.col("block") * block)
    )
    taking = F.filter("visits", lambda v: v["words"] > F.col("from"))
    words = F.aggregate(
        taking, F.lit(0).cast("long"), lambda n, v: n + F.least("to", v["words"]) - F.col("from")
    )
    taken = (
        pieces.join(_visits(plan, n_slots, config), ["sid", "block"], "left")
        .groupBy("sid", "start")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("size").alias("size"),
            F.sum(F.coalesce(words, F.lit(0))).cast("long").alias("taken"),
            F.min(F.array_min(F.transform(taking, lambda v: v["position"]))).alias("first_position"),
        )
    )
    none = placed.filter("size = 0").select(
        "sid", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_position")
    )
    by = plan.select("sid", "source", "source_size", "target")
    return (
        taken.unionByName(none)
        .join(by, "sid")
        .select("doc_id", "source", "size", "source_size", "target", "taken", "first_position")
    )


def mixed_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix as rows of docs, all columns kept, in the order of the schedule
    (partitions are ranges of positions): a document is returned at every slot
    that takes its first word, so not at all up to max_repeats times.  Texts
    without words are not in the mix."""
    columns = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    placed, plan, n_slots = _placed(docs, config, columns)
    block = config.block
    offset = F.col("start") - F.col("block") * block
    slots = (
        placed.filter("size > 0")
        .withColumn("block", F.expr(f"start div {block}"))
        .join(_visits(plan, n_slots, config), ["sid", "block"])
        .withColumn("visit", F.explode(F.filter("visits", lambda v: v["words"] > offset)))
        .select("doc_id", "row", F.col("visit")["position"].alias("position"), "start")
    )
    repeated = materialize(placed.groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row"), "mix-repeated")
    h, at, first = fresh(docs, "h"), fresh(docs, "position"), fresh(docs, "start")
    left = docs.withColumn(h, F.xxhash64(F.lit(config.seed), *columns))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["key_id"]) & (x[h] == y["key_h"])
    if not repeated.isEmpty():
        # equal rows: one of them meets the slots of all
        keys = repeated.toDF("key_id", "key_h")
        once = left.join(keys, same(left, keys), "left_semi").dropDuplicates(["doc_id", h])
        left = left.join(keys, same(left, keys), "left_anti").unionByName(once)
    keys = slots.toDF("key_id", "key_h", at, first)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        left.join(keys, same(left, keys))
        .select(*[left[c] for c in docs.columns], keys[at], keys[first])
        .repartitionByRange(parts, at)
        .sortWithinPartitions(at, first)
        .select(*docs.columns)
    )
