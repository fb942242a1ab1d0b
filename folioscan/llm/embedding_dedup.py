"""Embedding near-dedup by dual traversal of cover trees.

Vectors of one label are compared by cosine in double precision.  On unit
vectors a cosine of c is a distance of sqrt(2 - 2c), so a cover tree (nested
levels of nodes with halving radii) holds them, and two trees are walked
together: a pair of nodes is dropped when their centres are farther apart than
both covering radii and the threshold distance, and counted whole when even
their farthest members are nearer than that, so that a large group of near
copies is not walked pair by pair.  What is left at the bottom is tested exactly.

Equal vectors of a label are one class.  Labels with more than CELL classes are
cut into cells around pivots, whose covering radii are counted over all members;
pairs of cells are pruned by the same bound.  A cell that still has more members
is dealt to blocks by hash, and each surviving pair of blocks is walked in a task
of its own, so that no task holds more than about two times CELL vectors.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors without label, link with nothing and keep their own id;
repeated rows are separate vectors that link with each other; vectors of
different length never link; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

THRESHOLD = 0.93
#: Most classes of a cell (about), most pivots of a label and of all labels.
CELL, MAX_PIVOTS, ALL_PIVOTS = 8_192, 512, 20_000
#: Rows of one product of vectors, at the leaves and above.
BLOCK, CANDIDATES = 1_024, 128


# --- the tree ---------------------------------------------------------------


class Tree:
    """Nodes in arrays: centre (row of the vectors), radius (exact covering
    radius), children in the node list, rows (all members)."""

    def __init__(self, x: np.ndarray, leaf_radius: float):
        self.x = x
        self.centre, self.radius, self.kids, self.rows = [], [], [], []
        self.leaf_radius = leaf_radius
        if len(x):
            self._grow(np.arange(len(x)))

    def _add(self, centre: int, members: np.ndarray) -> int:
        gap = self.x[members] - self.x[centre]
        self.centre.append(centre)
        self.radius.append(float(np.sqrt((gap * gap).sum(axis=1).max())))
        self.kids.append(())
        self.rows.append(members)
        return len(self.centre) - 1

    def _grow(self, members: np.ndarray) -> None:
        todo = [self._add(int(members[0]), members)]
        while todo:
            node = todo.pop()
            members, radius = self.rows[node], self.radius[node]
            if radius <= self.leaf_radius or len(members) <= 8:
                continue
            # greedy cover by balls of half the radius; the distances from the
            # next candidates come from one product
            least, kids, left = 1 - radius * radius / 8, [], members
            while len(left):
                near = self.x[left] @ self.x[left[:CANDIDATES]].T >= least
                free = np.ones(len(left), dtype=bool)
                for k in range(near.shape[1]):
                    if free[k]:
                        near[k, k] = True
                        mine = near[:, k] & free
                        kids.append(self._add(int(left[k]), left[mine]))
                        free &= ~mine
                left = left[free]
            self.kids[node] = np.array(kids)
            todo.extend(kids)


def close_pairs(a: Tree, b: Tree, reach: float, cosine: float):
    """Yields (i, j, whole) that together hold every close pair of a row of a and
    one of b once.  If whole, all of i are close to all of j; else i and j are
    pairs that may be close (to within rounding) and have to be tested."""
    if not a.centre or not b.centre:
        return
    ra, rb = np.array(a.radius), np.array(b.radius)
    ca, cb = a.x[a.centre], b.x[b.centre]
    todo = [(np.array([0]), np.array([0]))]
    while todo:
        p, q = todo.pop()
        # p and q: kids of one pair of nodes; their distances by one product
        gap = np.sqrt(np.maximum(0, 2 - 2 * (ca[p] @ cb[q].T)))
        radii = ra[p][:, None] + rb[q][None, :]
        near = gap <= radii + reach + 1e-7
        whole = gap + radii <= reach - 1e-7
        at_p, at_q = np.nonzero(near)
        for u, v, every in zip(p[at_p].tolist(), q[at_q].tolist(), whole[at_p, at_q].tolist(), strict=True):
            ku, kv = a.kids[u], b.kids[v]
            if every:
                yield a.rows[u], b.rows[v], True
            elif len(ku) and (not len(kv) or ra[u] > 2 * rb[v]):
                todo.append((ku, np.array([v])))
            elif len(kv) and (not len(ku) or rb[v] > 2 * ra[u]):
                todo.append((np.array([u]), kv))
            elif len(ku):
                todo.extend((ku[s : s + CANDIDATES], kv) for s in range(0, len(ku), CANDIDATES))
            else:
                i, j = a.rows[u], b.rows[v]
                for s in range(0, len(i), BLOCK):
                    at_i, at_j = np.nonzero(a.x[i[s : s + BLOCK]] @ b.x[j].T >= cosine - 1e-9)
                    if len(at_i):
                        yield i[s + at_i], j[at_j], False


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _walk(threshold: float):
    reach = float(np.sqrt(2 - 2 * threshold))

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks: links per class, and edges that span what it found."""
        side = pdf["side"].to_numpy()
        raw = np.stack(pdf["embedding"].to_numpy()).astype(float)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        same = bool(((pdf["i"] == pdf["j"]) & (pdf["a"] == pdf["b"])).iloc[0])
        ids, n = pdf["cid"].to_numpy(), pdf["n"].to_numpy()
        at_a = np.flatnonzero(side == 0)
        at_b = at_a if same else np.flatnonzero(side == 1)
        a = Tree(unit[at_a], reach / 4)
        b = a if same else Tree(unit[at_b], reach / 4)
        links = np.zeros(len(pdf), dtype=np.int64)
        root = np.arange(len(pdf))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        edges = []

        def join(x: np.ndarray, y: np.ndarray) -> None:
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                s, t = find(u), find(v)
                if s != t:
                    root[s] = t
                    edges.append((ids[u], 0, ids[v]))

        # a tree walked with itself meets each pair in both orders: count the left side
        for x, y, whole in close_pairs(a, b, reach, threshold):
            x, y = at_a[x], at_b[y]
            if whole:
                links[x] += n[y].sum()
                if same:
                    own = np.intersect1d(x, y, assume_unique=True)
                    links[own] -= n[own]
                else:
                    links[y] += n[x].sum()
                join(x, np.full(len(x), y[0]))
                join(np.full(len(y), x[0]), y)
                continue
            ok = cosines(raw[x], raw[y]) >= threshold
            if same:
                ok &= x != y
            x, y = x[ok], y[ok]
            np.add.at(links, x, n[y])
            if not same:
                np.add.at(links, y, n[x])
            apart = root[x] != root[y]
            join(x[apart], y[apart])
        got = np.flatnonzero(links)
        return pd.DataFrame(
            [(ids[k], int(links[k]), None) for k in got] + edges, columns=["cid", "links", "other"]
        ).astype({"other": "Int64"})

    return of


# --- cells ------------------------------------------------------------------


def _cells(classes: DataFrame, cell: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """classes with a column `cell`, and the pairs of cells to walk."""
    spark = classes.sparkSession
    big = (
        classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > cell)
        .orderBy(F.desc("m"), "label", "dim").limit(ALL_PIVOTS // 2).collect()
    )
    if not big:
        one = classes.withColumn("cell", F.lit(0))
        return one, one.select("label", "dim", F.lit(0).alias("i"), F.lit(0).alias("j")).distinct()
    want = {(r["label"], r["dim"]): min(MAX_PIVOTS, -(-r["m"] // cell)) for r in big}
    scale = min(1.0, ALL_PIVOTS / sum(want.values()))
    want = {k: max(2, int(v * scale)) for k, v in want.items()}
    sizes = spark.createDataFrame([(*k, v) for k, v in want.items()], classes.select("label", "dim", F.lit(0).alias("k")).schema)
    picked = (
        classes.join(F.broadcast(sizes), ["label", "dim"])
        .withColumn("slot", F.pmod(F.xxhash64("cid"), F.col("k")))
        .groupBy("label", "dim", "slot")
        .agg(F.min_by("embedding", F.xxhash64("cid")).alias("embedding"))
        .collect()
    )
    pivots: dict[tuple, np.ndarray] = {}
    for r in picked:
        v = np.array(r["embedding"], dtype=float)
        v /= np.abs(v).max()
        pivots.setdefault((r["label"], r["dim"]), []).append(v / np.sqrt(v @ v))
    pivots = {k: np.stack(v) for k, v in pivots.items()}
    sent = spark.sparkContext.broadcast(pivots)

    def place(label: pd.Series, dim: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        cells, gaps = np.zeros(len(label), dtype=np.int32), np.zeros(len(label))
        keys = list(zip(label, dim, strict=True))
        for key in set(keys) & set(sent.value):
            at = [i for i, k in enumerate(keys) if k == key]
            x = np.stack([vectors.iloc[i] for i in at]).astype(float)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            gap = 2 - 2 * (x @ sent.value[key].T)
            cells[at] = gap.argmin(axis=1)
            gaps[at] = np.sqrt(np.maximum(0, gap.min(axis=1)))
        return pd.DataFrame({"cell": cells, "gap": gaps})

    place.__annotations__ = {"label": pd.Series, "dim": pd.Series, "vectors": pd.Series, "return": pd.DataFrame}
    at = F.pandas_udf(place, "cell int, gap double").asNondeterministic()("label", "dim", "embedding")
    placed = materialize(classes.withColumn("at", at).select(*classes.columns, "at.cell", "at.gap"), "cells")
    balls = placed.groupBy("label", "dim", "cell").agg(F.max("gap").alias("radius"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        key = (pdf["label"].iloc[0], pdf["dim"].iloc[0])
        cells, radius = pdf["cell"].to_numpy(), pdf["radius"].to_numpy()
        if key not in sent.value:
            i = j = np.zeros(1, dtype=np.int32)
        else:
            c = sent.value[key][cells]
            gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
            ok = np.triu(gap <= radius[:, None] + radius[None, :] + reach + 1e-7)
            np.fill_diagonal(ok, True)
            i, j = (cells[k] for k in np.nonzero(ok))
        return pd.DataFrame({"label": key[0], "dim": key[1], "i": i, "j": j})

    kind = dict(classes.dtypes)
    pairs = balls.groupBy("label", "dim").applyInPandas(
        pair, f"label {kind['label']}, dim {kind['dim']}, i int, j int"
    )
    return placed.drop("gap"), pairs


def _blocks(placed: DataFrame, pairs: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """placed with a column `block` (of its cell), and the pairs of blocks to
    walk, with columns a and b for the blocks of the cells i and j."""
    key = ["label", "dim", "cell"]
    large = materialize(
        placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / cell).alias("blocks")).filter("blocks > 1"), "large-cells"
    )
    if large.isEmpty():
        return placed.withColumn("block", F.lit(0)), pairs.select("*", F.lit(0).alias("a"), F.lit(0).alias("b"))
    if large.count() <= ALL_PIVOTS:
        large = F.broadcast(large)

    def known(df: DataFrame, column: str, name: str) -> DataFrame:
        by = large.withColumnRenamed("cell", column).withColumnRenamed("blocks", name)
        return df.join(by, ["label", "dim", column], "left").withColumn(name, F.coalesce(name, F.lit(1)))

    block = F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("blocks")).cast("int")
    split = (
        known(known(pairs, "i", "na"), "j", "nb")
        .withColumn("a", F.explode(F.expr("sequence(0, cast(na as int) - 1)")))
        .withColumn("b", F.explode(F.expr("sequence(if(i = j, a, 0), cast(nb as int) - 1)")))
    )
    return known(placed, "cell", "blocks").withColumn("block", block).drop("blocks"), split.drop("na", "nb")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """vectors: vec_id, embedding (array of double), label.  One row per vector:
    vec_id, n_links, component_id, kept."""
    e = F.col("embedding").cast("array<double>")
    fine = (
        F.col("label").isNotNull()
        & e.isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    rows = materialize(
        vectors.select("vec_id", "label", e.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
        .withColumn("h1", F.xxhash64("label", "embedding"))
        .withColumn("h2", F.xxhash64(F.lit(1), "embedding", "label")),
        "vectors",
    )
    classes = materialize(
        rows.filter("fine")
        .groupBy("label", "h1", "h2")
        .agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("embedding"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    placed, pairs = _cells(classes.select("cid", "label", "dim", "embedding", "n"), cell, threshold)
    placed, pairs = _blocks(placed, materialize(pairs, "cell-pairs"), cell)
    keys, at = ["label", "dim"], ["label", "dim", "cell", "block"]
    left = placed.join(pairs.selectExpr("*", "i as cell", "a as block"), at).withColumn("side", F.lit(0))
    other = pairs.filter("i <> j or a <> b").selectExpr("*", "j as cell", "b as block")
    right = placed.join(other, at).withColumn("side", F.lit(1))
    found = materialize(
        left.unionByName(right)
        .groupBy(*keys, "i", "j", "a", "b")
        .applyInPandas(_walk(threshold), "cid bigint, links bigint, other bigint"),
        "vector-links",
    )
    links = found.filter("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(
        found.filter("other is not null").select(F.col("cid").alias("u"), F.col("other").alias("v"))
    )
    known = (
        classes.select("label", "h1", "h2", "cid", "n", "least")
        .join(links, "cid", "left")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = known.join(least, "root").select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    linked = rows.filter("fine").join(facts, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fine").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
