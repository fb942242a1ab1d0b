"""Hard-negative mining with a vantage-point tree over norm-augmented vectors.

A row r of integers gets one more component, sqrt(M^2 - |r|^2), and an anchor a
zero, so that |a' - r'|^2 = |a|^2 + M^2 - 2 a.r: the highest inner product is the
smallest distance, and a window of scores is an annulus around the anchor.  A
coarse vantage-point tree, fitted on a sample of about SAMPLE rows, deals all rows
to cells; each cell keeps the least and largest distance of its own members to
every vantage point above it, counted over all rows, so a cell is left out only
where the triangle inequality proves that it holds nothing.  In a task a block of
a cell gets a tree of its own and is walked leaf by leaf, nearest first from the
inner edge of the annulus outwards, until the next leaf lies beyond the outer
edge or beyond the k-th row found.

Each search takes two rounds: the cell nearest to the ask gives a bound, then all
other cells that the bound does not exclude are walked.  Results are exact.

Work grows with anchors times rows where vectors have no structure: no exact
bound excludes a cell then.

Defined results: rows with a null label or vector, or with a null or non-finite
component, take no part; rows with vectors of another length never meet; zero
vectors take part (their scores are 0); a null vec_id is no anchor and comes
after all others among ties; repeated rows are rows of their own, so a copy of
an anchor may be its positive; scores are integers, and components so large that
a score leaves 64 bits are an error; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vector_blocks as B
from .common import materialize

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows of a leaf of a block's tree.
LEAF = 128
#: Bytes of vantage points that a task may hold.
TREE_BYTES = 32 << 20
#: Stand-ins for a missing id, which comes last, and for no score.
LAST, NONE = 2**63 - 1, -(2**62)


# --- the tree -----------------------------------------------------------------


@dataclass
class Tree:
    """points: vantage points, augmented.  nodes: (point, radius, inside, outside)
    with children >= 0 for nodes and ~leaf for leaves.  Per leaf: its vantage
    points above (padded with the last one), and its members' distances to them."""

    points: np.ndarray
    nodes: list[tuple[int, float, int, int]] = field(default_factory=list)
    above: np.ndarray | None = None
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    members: list[np.ndarray] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return len(self.above)


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def grow(x: np.ndarray, leaf: int, most_leaves: int) -> Tree:
    """Halves at the median distance to a vantage point, level by level, until
    parts hold at most leaf rows or there are most_leaves."""
    nodes: list[list] = []
    points: list[int] = []
    parts = [(np.arange(len(x)), None, [])]  # members, where it hangs, (point, distances' rows)
    done = []
    while parts:
        members, hang, path = parts.pop(0)
        split = None
        if len(members) > leaf and len(parts) + len(done) + 2 <= most_leaves:
            vantage = int(members[len(members) // 2])
            gap = gaps(x[members], x[vantage : vantage + 1])[:, 0]
            radius = float(np.median(gap))
            inside = gap <= radius
            if inside.all():
                inside = gap < radius
                radius = float(np.nextafter(radius, 0))
            if inside.any() and not inside.all():
                split = (vantage, radius, inside)
        if split is None:
            done.append((members, hang, path))
            continue
        vantage, radius, inside = split
        points.append(vantage)
        nodes.append([len(points) - 1, radius, 0, 0])
        if hang:
            nodes[hang[0]][hang[1]] = len(nodes) - 1
        deeper = [*path, len(points) - 1]
        parts.append((members[inside], (len(nodes) - 1, 2), deeper))
        parts.append((members[~inside], (len(nodes) - 1, 3), deeper))
    depth = max((len(path) for _, _, path in done), default=0)
    tree = Tree(x[points] if points else np.zeros((0, x.shape[1])))
    tree.above = np.zeros((len(done), depth), dtype=int)
    tree.least, tree.most = np.zeros((len(done), depth)), np.full((len(done), depth), np.inf)
    for i, (members, hang, path) in enumerate(done):
        if hang:
            nodes[hang[0]][hang[1]] = ~i
        tree.above[i, : len(path)] = path
        if path and len(members):
            d = gaps(x[members], tree.points[path])
            tree.least[i, : len(path)], tree.most[i, : len(path)] = d.min(axis=0), d.max(axis=0)
        tree.members.append(members)
    tree.nodes = [tuple(n) for n in nodes]
    return tree


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf of each row, and its distances to the vantage points above."""
    leaf = np.zeros(len(x), dtype=np.int32)
    path = np.zeros((len(x), tree.above.shape[1]))
    todo = [(0 if tree.nodes else ~0, np.arange(len(x)), 0)]
    while todo:
        node, at, level = todo.pop()
        if node < 0:
            leaf[at] = ~node
            continue
        point, radius, inside, outside = tree.nodes[node]
        gap = gaps(x[at], tree.points[point : point + 1])[:, 0]
        path[at, level] = gap
        near = gap <= radius
        todo += [(inside, at[near], level + 1), (outside, at[~near], level + 1)]
    return leaf, path


def bounds(tree: Tree, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible distance of each ask to the members of each leaf."""
    low, high = np.zeros((len(asks), tree.leaves)), np.full((len(asks), tree.leaves), np.inf)
    if len(tree.points):
        gap = gaps(asks, tree.points)
        for j in range(tree.above.shape[1]):
            g, least, most = gap[:, tree.above[:, j]], tree.least[:, j], tree.most[:, j]
            np.maximum(low, np.maximum(g - most, least - g), out=low)
            np.minimum(high, g + most, out=high)
    return low, high


# --- the space ----------------------------------------------------------------


@dataclass(frozen=True)
class Space:
    """square: M^2, at least the square of every row's norm."""

    square: float

    def integers(self, vectors: pd.Series, dim: int) -> np.ndarray:
        x = np.floor(SCALE * B.matrix(vectors, dim))
        # sums of products stay below M^2: exact in doubles, else in 64-bit integers
        return x if self.square < 2**52 else x.astype(np.int64)

    def rows(self, r: np.ndarray) -> np.ndarray:
        r = r.astype(float)
        return np.column_stack([r, np.sqrt(np.maximum(0, self.square - (r * r).sum(axis=1)))])

    def asks(self, a: np.ndarray) -> np.ndarray:
        return np.column_stack([a.astype(float), np.zeros(len(a))])

    def distance(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, norm + self.square - 2.0 * score))

    @property
    def slack(self) -> float:
        """More than rounding can do to a distance."""
        return 1e-6 * (1 + self.square**0.5)


def _search(space: Space, k: int, same: bool):
    """Work on one block and one slice: the k best rows of each ask among those of
    the same (or another) label with a score in [lo, hi]."""

    def of(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim, part in asks.groupby("dim"):
            mine = rows[rows["dim"] == dim]
            if len(mine):
                found += _walk(space, k, same, mine, part, int(dim))
        return pd.DataFrame(found, columns=["aid", "id", "rid", "score"])

    return of


def _walk(space: Space, k: int, same: bool, rows: pd.DataFrame, asks: pd.DataFrame, dim: int) -> list[tuple]:
    # by id, so that equal scores of one leaf are met in the order of ties
    rows = rows.sort_values(["id", "rid"])
    ids, rids, labels = rows["id"].to_numpy(), rows["rid"].to_numpy(), rows["label"].to_numpy()
    r, a = space.integers(rows["x"], dim), space.integers(asks["x"], dim)
    tree = grow(space.rows(r), LEAF, len(r))
    aids, own, label = asks["aid"].to_numpy(), asks["own"].to_numpy(), asks["label"].to_numpy()
    lo, hi = asks["lo"].to_numpy(), asks["hi"].to_numpy()
    norm = (a.astype(float) ** 2).sum(axis=1)
    inner, outer = space.distance(norm, hi) - space.slack, space.distance(norm, lo) + space.slack
    low, high = bounds(tree, space.asks(a))
    key = np.where((high < inner[:, None]) | (low > outer[:, None]), np.inf, np.maximum(low, inner[:, None]))
    order = np.argsort(key, axis=1, kind="stable")
    best = np.full((len(a), k), NONE)
    best_id, best_rid = np.full((len(a), k), LAST), np.full((len(a), k), LAST)
    every = np.arange(len(a))
    for step in range(tree.leaves):
        leaf, worst = order[:, step], best[:, -1]
        limit = np.where(worst == NONE, outer, np.minimum(outer, space.distance(norm, worst) + space.slack))
        active = np.flatnonzero(key[every, leaf] <= limit)
        if not len(active):
            break
        for one in np.unique(leaf[active]):
            who, inside = active[leaf[active] == one], np.sort(tree.members[one])
            score = (a[who] @ r[inside].T).astype(np.int64)
            alike = labels[inside][None, :] == label[who][:, None]
            good = (score >= lo[who][:, None]) & (score <= hi[who][:, None]) & (rids[inside][None, :] != own[who][:, None])
            score = np.where(good & (alike if same else ~alike), score, NONE)
            first = np.argsort(-score, axis=1, kind="stable")[:, :k]
            picked = (np.take_along_axis(score, first, axis=1), ids[inside][first], rids[inside][first])
            known = (best[who], best_id[who], best_rid[who])
            joined = [np.concatenate(p, axis=1) for p in zip(known, picked, strict=True)]
            best[who], best_id[who], best_rid[who] = B.merge_best(*joined, k)
    at_a, at_k = np.nonzero(best != NONE)
    found = (aids[at_a], best_id[at_a, at_k], best_rid[at_a, at_k], best[at_a, at_k])
    return list(zip(*[c.tolist() for c in found], strict=True))


# --- cells --------------------------------------------------------------------


@dataclass
class Cells:
    """The coarse trees by length of vector, and the first cell of each."""

    trees: dict[int, tuple[Tree, int]]
    rest: int


def _fit(rows: DataFrame, space: Space, block: int) -> Cells:
    trees, first = {}, 0
    for dim, count in B.lengths(rows).items():
        most = min(B.MAX_CELLS // B.MAX_LENGTHS, max(1, TREE_BYTES // (8 * (dim + 1))), -(-count // block))
        x = space.rows(space.integers(pd.Series(list(B.sample(rows, dim, count))), dim)) if most > 1 else np.zeros((0, dim + 1))
        trees[dim] = (grow(x, max(1, len(x) // most), most) if len(x) else grow(np.zeros((1, dim + 1)), 1, 1), first)
        first += trees[dim][0].leaves
    return Cells(trees, first)


def _place(rows: DataFrame, cells: Cells, space: Space) -> DataFrame:
    """rows with their cell, written; the trees get the true bounds of all members."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def of(vectors: pd.Series, dims: pd.Series) -> pd.DataFrame:
        cell, path = np.full(len(dims), -1, dtype=np.int32), [None] * len(dims)
        for dim in set(dims) & set(sent.value.trees):
            tree, first = sent.value.trees[dim]
            at = np.flatnonzero(dims.to_numpy() == dim)
            leaf, far = route(tree, space.rows(space.integers(vectors.iloc[at], dim)))
            cell[at] = first + leaf
            for i, f in zip(at, far, strict=True):
                path[i] = f
        return pd.DataFrame({"cell": cell, "path": path})

    of.__annotations__ = {"vectors": pd.Series, "dims": pd.Series, "return": pd.DataFrame}
    at = F.pandas_udf(of, "cell int, path array<double>").asNondeterministic()("x", "dim")
    cell = F.when(F.col("at.cell") < 0, B.rest_cell(cells.rest)).otherwise(F.col("at.cell"))
    placed = materialize(rows.withColumn("at", at).select(*rows.columns, cell.alias("cell"), F.col("at.path").alias("path")), "placed-vectors")
    depth = max((t.above.shape[1] for t, _ in cells.trees.values()), default=0)
    if depth:
        levels = [f(F.get("path", F.lit(j))).alias(f"{n}{j}") for j in range(depth) for n, f in (("least", F.min), ("most", F.max))]
        known = {r["cell"]: r for r in placed.filter(F.col("cell") < cells.rest).groupBy("cell").agg(*levels).collect()}
        for tree, first in cells.trees.values():
            for leaf in range(tree.leaves):
                for j in range(tree.above.shape[1]):
                    r = known.get(first + leaf)
                    # a cell that no row is in can be left out, a padded level excludes nothing
                    tree.least[leaf, j] = (r[f"least{j}"] or 0.0) if r else np.inf
                    tree.most[leaf, j] = r[f"most{j}"] if r and _deep(tree, leaf, j) else np.inf
                    if r and not _deep(tree, leaf, j):
                        tree.least[leaf, j] = 0.0
    return placed.drop("path")


def _deep(tree: Tree, leaf: int, level: int) -> bool:
    """Whether a leaf has a vantage point at this level: points above come in
    the order of the tree, so padding repeats the root."""
    return level == 0 or tree.above[leaf, level] > tree.above[leaf, level - 1]


def _ask_cells(space: Space, home: bool):
    """Cells of each ask: the nearest one that may hold something (home), or all
    the others within its reach."""

    def pick(sent):
        def of(vectors: pd.Series, dims: pd.Series, lo: pd.Series, hi: pd.Series, kth: pd.Series, seen: pd.Series) -> pd.Series:
            out = [np.zeros(0, dtype=np.int32)] * len(dims)
            for dim in set(dims) & set(sent.value.trees):
                tree, first = sent.value.trees[dim]
                at = np.flatnonzero(dims.to_numpy() == dim)
                a = space.integers(vectors.iloc[at], dim)
                low, high = bounds(tree, space.asks(a))
                norm = (a.astype(float) ** 2).sum(axis=1)
                inner = space.distance(norm, hi.iloc[at].to_numpy(dtype=float)) - space.slack
                least = np.fmax(lo.iloc[at].to_numpy(dtype=float), kth.iloc[at].to_numpy(dtype=float))
                outer = space.distance(norm, least) + space.slack
                may = (low <= outer[:, None]) & (high >= inner[:, None]) & ~np.isinf(low)
                key = np.where(may, np.maximum(low, inner[:, None]), np.inf)
                if home:
                    nearest = np.lexsort((low, key), axis=-1)[:, 0]
                    for i, n, ok in zip(at, nearest, may.any(axis=1), strict=True):
                        out[i] = np.array([first + n] if ok else [], dtype=np.int32)
                else:
                    for i, m, s in zip(at, may, seen.iloc[at].to_numpy(), strict=True):
                        c = first + np.flatnonzero(m)
                        out[i] = c[c != s].astype(np.int32)
            return pd.Series(out)

        of.__annotations__ = {n: pd.Series for n in ("vectors", "dims", "lo", "hi", "kth", "seen", "return")}
        return F.pandas_udf(of, "array<int>")

    return pick


def _nearest(placed: DataFrame, blocks: dict[int, int], cells: Cells, space: Space, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """asks: aid, own (row number of the anchor), dim, x, label, lo, hi.  (aid,
    id, rid, score, n): the k best of each, from 1."""
    sent = asks.sparkSession.sparkContext.broadcast(cells)
    none, schema = F.lit(None), "aid bigint, id bigint, rid bigint, score bigint"
    known = F.col("dim").isin(*cells.trees) if cells.trees else F.lit(False)
    near = _ask_cells(space, True)(sent)("x", "dim", "lo", "hi", none.cast("bigint"), none.cast("int"))
    own = asks.withColumn("cell", F.explode(F.when(known, near).otherwise(F.array(B.rest_cell(cells.rest)))))
    own = materialize(own, "asks-home")
    best = Window.partitionBy("aid").orderBy(F.desc("score"), "id", "rid")
    top = lambda df: df.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    found = materialize(top(B.scan(placed, blocks, own, _search(space, k, same), schema)), "near-home")
    if max((t.leaves for t, _ in cells.trees.values()), default=1) == 1:
        return found
    bound = found.filter(F.col("n") == k).select("aid", F.col("score").alias("kth"))
    left = own.filter(known).withColumnRenamed("cell", "seen").join(bound, "aid", "left")
    far = _ask_cells(space, False)(sent)("x", "dim", "lo", "hi", "kth", "seen")
    more = left.withColumn("lo", F.greatest("lo", "kth")).withColumn("cell", F.explode(far)).drop("seen", "kth")
    more = B.scan(placed, blocks, materialize(more, "asks-far"), _search(space, k, same), schema)
    return materialize(top(found.drop("n").unionByName(more)), "near-all")


def mine(
    vectors: DataFrame,
    every: int = 50,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block: int = B.BLOCK,
) -> DataFrame:
    """vectors: vec_id (an integer), embedding, label.  Anchors are the rows whose
    vec_id is divisible by `every`.  One row per negative: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score."""
    number = F.col("vec_id").cast("bigint")
    whole = vectors.select(F.coalesce(number, F.lit(LAST)).alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    rows = B.numbered(whole.filter(F.col("label").isNotNull() & B.usable(F.col("x"))).withColumn("dim", F.size("x")), "mined-vectors")
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + (F.abs(v * SCALE) + 1) * (F.abs(v * SCALE) + 1))
    top = rows.agg(F.max(square).alias("square")).first()["square"] or 0.0
    if top >= 2**62:
        raise ValueError("components are too large: a score would leave 64 bits")
    space = Space(float(top))
    cells = _fit(rows, space, block)
    placed = _place(rows, cells, space)
    blocks = B.counted(placed, block)
    own = F.col("rid").alias("own")
    anchors = rows.filter((F.col("id") % every == 0) & (F.col("id") != LAST)).select(own, F.col("id").alias("anchor_id"), "dim", "x", "label")
    asks = anchors.select(F.col("own").alias("aid"), "own", "dim", "x", "label", F.lit(NONE + 1).alias("lo"), F.lit(-NONE).alias("hi"))
    id_of = lambda name: F.when(F.col("id") != LAST, F.col("id")).alias(name)
    close = _nearest(placed, blocks, cells, space, asks, positives, True)
    close = close.select(F.col("aid").alias("own"), id_of("positive_id"), F.col("score").alias("positive_score"))
    # a window per anchor and score, which positives of one score share; below 0 it is empty
    hundred = lambda part, more: F.expr(f"(cast(positive_score as decimal(38, 0)) * {part} + {more}) div 100")
    windows = close.filter("positive_score >= 0").select("own", "positive_score").distinct()
    windows = windows.withColumns({"lo": hundred(LOW, 99), "hi": hundred(HIGH, 0), "aid": F.monotonically_increasing_id()})
    windows = materialize(windows, "windows")
    wanted = windows.filter("lo <= hi").join(anchors, "own").select("aid", "own", "dim", "x", "label", "lo", "hi")
    hard = _nearest(placed, blocks, cells, space, wanted, negatives, False)
    return (
        hard.select("aid", F.col("n").cast("int").alias("rank"), id_of("negative_id"), F.col("score").alias("negative_score"))
        .join(windows.select("aid", "own", "positive_score"), "aid")
        .join(close, ["own", "positive_score"])
        .join(anchors.select("own", "anchor_id"), "own")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


#: The contract's query over the table embeddings.
ORACLE_SQL = f"""WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM rows a JOIN rows r ON r.vec_id <> a.vec_id AND len(r.q) = len(a.q) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scored WHERE same) WHERE n <= {POSITIVES}),
windows AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= {NEGATIVES}"""
