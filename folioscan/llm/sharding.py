"""Sharding by histogram sort.

Rows are ordered by (CRC-32 of the text, hash of doc_id), with a row number as
last resort, and cut into shards of nearly equal bytes.  The cuts are found by
counting exact bytes below candidate boundaries over all partitions and refining
the candidates around each cut until the cut is within tolerance; then one
exchange deals every row to the partition that these cuts give it.  Each shard is
cut into pieces in the same way, so that a shard is ordered by several tasks.
Only DataFrame functions are used.

Equal texts are neighbours in this order; a group of copies of any size is split
where a cut falls into it, since the key goes on into doc_id and row number.

Defined results: a null text counts as no bytes (size 1, CRC-32 0); repeated
rows are separate rows; an empty table gives an empty result; extra columns are
not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

KEY_BITS = 63


@dataclass(frozen=True)
class ShardConfig:
    """tolerance is the largest error of a cut between shards, as a share of a
    shard's bytes, and piece_tolerance that of a cut inside a shard, as a share
    of a piece; probe_bits sets the candidates of a round (2 ** probe_bits in
    each cell)."""

    n_shards: int = 16
    tolerance: float = 0.0005
    piece_tolerance: float = 0.25
    probe_bits: int = 12

    def pieces(self, parts: int) -> int:
        """Pieces of a shard, so that the exchange has at least `parts`."""
        return max(1, -(-parts // self.n_shards))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two halves of the sort key."""
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        F.shiftleft(crc.cast("long"), 31).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(2**31 - 1)).alias("key"),
        F.monotonically_increasing_id().alias("tie"),
    )


def find_cuts(rows: DataFrame, config: ShardConfig, pieces: int = 1) -> list[tuple[int, int]]:
    """n_shards * pieces - 1 boundaries (key, tie), ascending: a row is in the
    piece of the number of boundaries at or below it."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = config.n_shards * pieces
    top = 1 << KEY_BITS
    if not total:
        return [(top - 1, top - 1)] * (n - 1)
    goals = [j * total / n for j in range(1, n)]
    slack = [
        (config.piece_tolerance / pieces if j % pieces else config.tolerance) * total / config.n_shards
        for j in range(1, n)
    ]
    cuts: dict[int, tuple[int, int]] = {}
    # cells: the ones that hold an open cut, as (key prefix, tie prefix), with the bytes below them
    level, cells = 0, {(0, 0): 0}
    bits = config.probe_bits
    first = min(KEY_BITS, max(bits, n.bit_length() + 3))
    split = lambda k: [bits] * (k // bits) + [k % bits] * bool(k % bits)
    steps = [(0, first), *[(0, w) for w in split(KEY_BITS - first)], *[(1, w) for w in split(KEY_BITS)]]
    done = [0, 0]
    while cells:
        half, width = steps[level]
        old, new = KEY_BITS - done[half], KEY_BITS - done[half] - width
        part = rows
        if half == 0:
            if level:
                part = rows.filter(F.shiftright("key", old).isin([k for k, _ in cells]))
            ids = [F.shiftright("key", new).alias("a"), F.lit(0).cast("long").alias("b")]
        else:
            inside = [
                (F.col("key") == k) & (F.shiftright("tie", old) == t if old < KEY_BITS else F.lit(True))
                for k, t in cells
            ]
            part = rows.filter(reduce(lambda x, y: x | y, inside))
            ids = [F.col("key").alias("a"), F.shiftright("tie", new).alias("b")]
        counts = sorted((a, b, found) for a, b, found in part.groupBy(*ids).agg(F.sum("size")).collect())
        level += 1
        done[half] += width
        over = level == len(steps)
        inner: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for a, b, found in counts:
            home = (a >> width, 0) if half == 0 else (a, b >> width)
            inner.setdefault(home, []).append((a, b, found))
        following: dict[tuple[int, int], int] = {}
        edge = lambda a, b: (a << new, 0) if half == 0 else (a, b << new)
        for home, below in cells.items():
            for a, b, found in inner.get(home, []):
                for j in range(bisect_left(goals, below), bisect_right(goals, below + found)):
                    if j in cuts:
                        continue
                    low, high = goals[j] - below, below + found - goals[j]
                    if min(low, high) <= slack[j] or over:
                        cuts[j] = edge(a, b) if low <= high else edge(*((a + 1, b) if half == 0 else (a, b + 1)))
                    else:
                        following[(a, b)] = below
                below += found
        cells = following
    return [cuts[j] for j in sorted(cuts)]


def _at_or_below(cuts: list[tuple[int, int]], here: Column) -> Column:
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t")) for k, t in cuts])
    return F.size(F.filter(table, lambda c: c <= here))


def piece_of(cuts: list[tuple[int, int]], pieces: int, key: str, tie: str) -> Column:
    """Number of cuts at or below (key, tie): the shard first, then the piece of
    that shard."""
    here = F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))
    if pieces == 1:
        return _at_or_below(cuts, here) if cuts else F.lit(0)
    shards = [cuts[a : a + pieces - 1] for a in range(0, len(cuts), pieces)]
    borders = cuts[pieces - 1 :: pieces]
    shard = _at_or_below(borders, here) if borders else F.lit(0)
    tables = F.array(
        *[F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t")) for k, t in s]) for s in shards]
    )
    return shard * pieces + F.size(F.filter(F.element_at(tables, shard + 1), lambda c: c <= here))


def _dealt(rows: DataFrame, config: ShardConfig, key: str, tie: str, size: str, piece: str) -> tuple[DataFrame, int]:
    """rows with a column `piece`, each in the partition of its piece and in the
    order of the key, and the number of pieces of a shard.  The one exchange."""
    per = config.pieces(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = find_cuts(rows.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.col(size).alias("size")), config, per)
    dealt = rows.withColumn(piece, piece_of(cuts, per, key, tie)).repartitionById(config.n_shards * per, F.col(piece))
    return dealt.sortWithinPartitions(key, tie), per


def shard(docs: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.  Slots
    count the rows of a shard from 0 in the order of the key."""
    rows = materialize(keyed(docs), "shard-keys")
    dealt, per = _dealt(rows, config, "key", "tie", "size", "piece")
    placed = materialize(
        dealt.select("doc_id", "size", "text_crc32", "piece", F.monotonically_increasing_id().alias("at")), "shard-rows"
    )
    shard = F.expr(f"piece div {per}").cast("int").alias("shard")
    runs = placed.groupBy("piece").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("*", shard).select(
        "piece", "shard", (F.coalesce(F.sum("n").over(up), F.lit(0)) - F.col("first")).alias("shift")
    )
    # one row per piece: as many as the exchange has partitions
    return placed.join(F.broadcast(shifts), "piece").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, config: ShardConfig = ShardConfig()) -> None:
    """Writes docs, whole, to path/shard=N in the order of the key: one exchange.
    A column of docs called shard gives way to the folder."""
    key, tie, size, piece, out = (*[fresh(docs, c) for c in ("key", "tie", "bytes", "piece")], "shard")
    text = F.coalesce("text", F.lit(""))
    base = [c for c in docs.columns if c.lower() != out]
    # written first: the row numbers that part equal rows must not change
    rows = materialize(
        docs.select(
            *base,
            (F.octet_length(text) + 1).cast("long").alias(size),
            F.shiftleft(F.crc32(text.cast("binary")).cast("long"), 31)
            .bitwiseOR(F.xxhash64("doc_id").bitwiseAND(2**31 - 1))
            .alias(key),
            F.monotonically_increasing_id().alias(tie),
        ),
        "shard-documents",
    )
    dealt, per = _dealt(rows, config, key, tie, size, piece)
    (
        dealt.select(*base, F.expr(f"`{piece}` div {per}").cast("int").alias(out))
        .write.partitionBy(out)
        .parquet(path)
    )
