"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, padded with
zeros to 23.  The perfect Golay code [23, 12, 7] decodes every segment to one
codeword within distance 3; a segment that differs in one bit from it then lies
within distance 4 of that codeword, and at most 6 codewords are so near.

Two fingerprints that differ in 3 bits or fewer either have an equal segment, and
then another that differs in one bit or none, or differ in just one bit of each
segment.  So they are keyed in two ways: by one segment's bits with the codeword
of another (6 kinds), and by the codewords of the first two segments with one
half of the third, which must be equal, and the parities that must differ (2
kinds).  One side is keyed by its own codewords (8 keys), the other by all near
ones (up to 6 for each of the 6 kinds, 36 for each of the 2); the sides are joined
on the key and each pair is verified by its differing bits.  A key holds 33 bits
or more, so that the pairs that are verified in vain stay few.

Equal fingerprints are one node, so groups of copies cost one row.  A key with
very many fingerprints is refined by the four 16-bit blocks, one of which must
be equal: this way stays exact.

Defined results: a text without words (null too) has fingerprint zero and is
linked like any other; fewer than three words make one shingle; repeated rows
share a component; null doc_ids are never the smallest unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .graph import connected_components

MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: First bit and length of each segment, and of the halves of the last one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALVES = ((43, 10), (53, 11))
#: Kinds of keys with an equal segment: that one, and the one near a codeword.
EQUAL = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
#: Keys with more fingerprints than this are refined by equal 16-bit blocks.
CROWDED = 2_000
#: Generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Of every 23-bit word the index of the codeword within distance 3, and
    the 23 single bits."""
    words = np.zeros(1, dtype=np.uint32)
    for i in range(12):
        words = np.concatenate([words, words ^ np.uint32(GENERATOR << i)])
    index = np.arange(4096, dtype=np.uint16)
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = np.zeros(1, dtype=np.uint32)
    nearest = np.zeros(1 << 23, dtype=np.uint16)
    for n in range(4):
        nearest[(words[:, None] ^ errors[None, :]).ravel()] = np.repeat(index, len(errors))
        wider = np.unique((errors[:, None] ^ one[None, :]).ravel())
        errors = wider[np.bitwise_count(wider) == n + 1]
    return nearest, one


def near_indices(segments: np.ndarray, bits: int = 23) -> np.ndarray:
    """Six columns: the indices of the codewords that the segments, and those
    that differ from them in one of their bits, decode to, padded with -1.
    They lie within distance 4, hence six at most."""
    nearest, one = _golay()
    around = np.concatenate([segments[:, None], segments[:, None] ^ one[None, :bits].astype(np.int64)], axis=1)
    found = np.sort(nearest[around].astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return np.sort(found, axis=1)[:, :-7:-1]


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    w = text.encode().translate(_TABLE).split() if text else []
    if not w:
        return 0
    if len(w) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    else:
        flat = b" ".join(w)
        size = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: 1 - SHINGLE].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    total, n = np.zeros(64, dtype=np.int64), len(hashes)
    for at in range(0, n, 65_536):
        part = np.array(hashes[at : at + 65_536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def fingerprints(column: str) -> Column:
    return F.pandas_udf(_fingerprints, "bigint").asNondeterministic()(column)


def _bits(values: np.ndarray, place: tuple[int, int]) -> np.ndarray:
    return ((values >> np.uint64(place[0])) & np.uint64((1 << place[1]) - 1)).astype(np.int64)


def _keys(values: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of all keys: of the segments' own codewords alone, or of
    all near ones, with the parities turned."""
    parts = [_bits(values, s) for s in SEGMENTS]
    if every:
        near = [near_indices(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    else:
        near = [_golay()[0][p].astype(np.int64)[:, None] for p in parts]
    at, keys = [], []
    for kind, (i, j) in enumerate(EQUAL):
        row, a = np.nonzero(near[j] >= 0)
        at.append(row)
        keys.append((kind << 41) | (parts[i][row] << 12) | near[j][row, a])
    row, a, b = np.nonzero((near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :])
    codewords = (near[0][row, a] << 12) | near[1][row, b]
    halves = [_bits(values, h) for h in HALVES]
    for k, half in enumerate(halves):
        odd = np.zeros(len(values), dtype=np.int64)
        for part in (parts[0], parts[1], halves[1 - k]):
            odd = (odd << 1) | ((np.bitwise_count(part) & 1) ^ every)
        at.append(row)
        keys.append(((len(EQUAL) + k) << 41) | (odd[row] << 35) | (half[row] << 24) | codewords)
    return np.concatenate(at), np.concatenate(keys)


def _keyed(every: bool):
    def of(batches):
        for batch in batches:
            values = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            at, keys = _keys(values, every)
            yield pd.DataFrame({"fp": batch["fp"].to_numpy()[at], "key": keys})

    return of


def links(nodes: DataFrame) -> DataFrame:
    """nodes: distinct fp (long).  All pairs u > v that differ in 1 to 3 bits,
    found by the join on codeword keys."""
    index = materialize(nodes.mapInPandas(_keyed(False), "fp bigint, key bigint"), "golay-index")
    query = nodes.mapInPandas(_keyed(True), "fp bigint, key bigint")
    verify = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)

    def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        # a table of keys is many times the size that Spark expects of mapInPandas, so neither is broadcast
        both = left.withColumnRenamed("fp", "u").hint("merge").join(right.withColumnRenamed("fp", "v"), on)
        return both.filter(verify).select("u", "v")

    crowded = materialize(
        index.groupBy("key").count().filter(F.col("count") > CROWDED).select("key"), "golay-crowded"
    )
    if crowded.isEmpty():
        found = pairs(query, index, ["key"])
    else:
        block = F.explode(
            F.array(
                *[
                    F.shiftrightunsigned("fp", 16 * b).bitwiseAND(0xFFFF).bitwiseOR(b << 16)
                    for b in range(4)
                ]
            )
        )
        rest = [df.join(crowded, "key", "left_anti") for df in (query, index)]
        split = [df.join(crowded, "key").withColumn("block", block) for df in (query, index)]
        found = pairs(*rest, ["key"]).unionByName(pairs(*split, ["key", "block"]))
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(marked: DataFrame) -> DataFrame:
    """marked: doc_id, fp.  (fp, component_id, root) of every fingerprint; root,
    the component's smallest fingerprint, tells components apart whose ids are
    equal or null."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(links(nodes.select("fp")))
    linked = nodes.join(roots, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return (
        linked.join(least, "root")
        .select("fp", "component_id", "root")
        .unionByName(
            nodes.join(roots, F.col("fp") == F.col("node"), "left_anti").select(
                "fp", F.col("least").alias("component_id"), F.col("fp").alias("root")
            )
        )
    )


def _with_components(marked: DataFrame) -> DataFrame:
    """marked with component_id and root.  Every fingerprint has a component; the
    join is a left one since the rows of marked, whose file is small if many are
    copies, cannot be broadcast in it."""
    return marked.join(components(marked), "fp", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id."""
    marked = materialize(docs.select("doc_id", fingerprints("text").alias("fp")), "simhash")
    return _with_components(marked).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns kept: of every component the row whose doc_id
    is the component's; of equal candidates any one."""
    marked = materialize(
        docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), fingerprints("text").alias("fp")),
        "simhash",
    )
    by = _with_components(marked).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = by.groupBy("root").agg(
        F.first("component_id").alias("component_id"), F.min("h").alias("h"), F.count(F.lit(1)).alias("n")
    )
    chosen = materialize(chosen, "simhash-kept")
    h, one, root = fresh(docs, "h"), fresh(docs, "one"), fresh(docs, "root")
    left = docs.withColumn(h, F.xxhash64("doc_id", "text"))
    right = chosen.select(
        F.col("component_id").alias(fresh(left, "id")), F.col("h").alias(fresh(left, "hash")),
        F.col("n").alias(one), F.col("root").alias(root),
    )
    both = left.join(
        right, left["doc_id"].eqNullSafe(right[right.columns[0]]) & (left[h] == right[right.columns[1]])
    )
    if chosen.filter(F.col("n") > 1).isEmpty():
        return both.select(*docs.columns)
    # several rows may have the chosen doc_id: keep one of those with the chosen text
    single, several = both.filter(F.col(one) == 1), both.filter(F.col(one) > 1)
    return single.unionByName(several.dropDuplicates([root])).select(*docs.columns)
