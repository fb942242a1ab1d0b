"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are rotated by a random orthogonal matrix, so that any few components
tell about the whole distance, and dealt to lists around centroids that are
fitted on a sample of about SAMPLE rows.  A query probes its nearest lists.  In a
list the rotated vectors are held by columns, COLUMNS of them a block: after each
block a hypothesis test on the partial distance drops the candidates that are
farther than the k-th neighbour known so far (the chance of dropping a true one is
set by SURE), and only what outlives all blocks is measured on original vectors.

The first round scans the nearest list and gives each query its k-th distance; the
second scans the other probed lists with it.  How many lists are probed follows
from the sample: the least part of all lists that holds REACH of the true
neighbours within the sample (vectors without structure need most of them).

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; vectors of different length never meet; a query's own
row is no candidate, but a copy of it is; repeated rows are rows of their own; a
null vec_id is no query and comes last among ties; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vector_blocks as B
from .common import materialize

K = 10
#: Rotated components of a column block.
COLUMNS = 16
#: Of the test: a candidate goes when its scaled partial distance is over
#: 1 + SURE / sqrt(components seen) times the k-th distance.
SURE = 2.1
#: Rows of a list (about), and its least share of true neighbours in the sample.
LIST, REACH = 2_048, 0.98
#: Candidates in the first step of a list and in each later one, and the share of
#: pairs alive below which they are followed one by one.
FIRST, STRIDE, SPARSE = 256, 2_048, 0.3
ROUNDS = 12
LAST = 2**63 - 1


@dataclass
class Lists:
    """Of one length of vector: rotation, rotated centroids, lists to probe."""

    turn: np.ndarray
    centroids: np.ndarray
    probes: int
    first: int


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))


def fit_lists(x: np.ndarray, lists: int, first: int, k: int) -> Lists:
    """k-means on the sample, and the number of lists to probe."""
    turn = rotation(x.shape[1])
    y = x @ turn
    rng = np.random.default_rng(3)
    centroids = y[rng.choice(len(y), min(lists, len(y)), replace=False)]
    for _ in range(ROUNDS):
        near = _square(y, centroids).argmin(axis=1)
        for c in range(len(centroids)):
            if (near == c).any():
                centroids[c] = y[near == c].mean(axis=0)
    near = _square(y, centroids).argmin(axis=1)
    asked = rng.choice(len(y), min(256, len(y)), replace=False)
    place = np.argsort(np.argsort(_square(y[asked], centroids), axis=1), axis=1)
    gap = _square(y[asked], y)
    gap[np.arange(len(asked)), asked] = np.inf
    true = np.argsort(gap, axis=1)[:, : min(k, len(y) - 1)]
    ranks = np.sort(np.take_along_axis(place, near[true], axis=1).ravel())
    probes = 1 + int(ranks[min(len(ranks) - 1, int(REACH * len(ranks)))]) if len(ranks) else len(centroids)
    return Lists(turn, centroids, probes, first)


def _fit(rows: DataFrame, k: int, size: int) -> tuple[dict[int, Lists], int]:
    found, first = {}, 0
    for dim, count in B.lengths(rows).items():
        lists = min(B.MAX_CELLS // B.MAX_LENGTHS, -(-count // size))
        x = B.sample(rows, dim, count) if lists > 1 else np.zeros((1, dim))
        found[dim] = fit_lists(x, lists, first, k)
        first += len(found[dim].centroids)
    return found, first


def _near(sent, which: str):
    """The list of each row (own), the nearest list of a query (home), or the
    other lists that it probes (rest); none for lengths without lists."""

    def of(vectors: pd.Series, dims: pd.Series) -> pd.Series:
        out = [None] * len(dims)
        for dim in set(dims) & set(sent.value):
            it, at = sent.value[dim], np.flatnonzero(dims.to_numpy() == dim)
            gap = _square(B.matrix(vectors.iloc[at], dim) @ it.turn, it.centroids)
            order = it.first + np.argsort(gap, axis=1, kind="stable")
            part = order[:, 1 : it.probes] if which == "rest" else order[:, :1]
            for i, cells in zip(at, part.astype(np.int32), strict=True):
                out[i] = cells
        return pd.Series(out)

    of.__annotations__ = {"vectors": pd.Series, "dims": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "array<int>").asNondeterministic()("x", "dim")


def adaptive(columns: list[np.ndarray], query: list[np.ndarray], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test has dropped.  columns and query: the
    rotated components, by column blocks; limit: squared k-th distances."""
    total = sum(c.shape[1] for c in columns)
    seen, at_q, at_c, part = 0, None, None, 0.0
    for c, q in zip(columns, query, strict=True):
        seen += c.shape[1]
        ratio = 1.0 if seen == total else (1 + SURE / seen**0.5) ** 2 * seen / total
        # rounding must not drop a tie
        most = limit * ratio * (1 + 1e-9) + 1e-12
        if at_q is None:
            part = part + _square(q, c)
            alive = part <= most[:, None]
            if seen == total or alive.mean() < SPARSE:
                at_q, at_c = np.nonzero(alive)
                part = part[at_q, at_c]
        else:
            gap = q[at_q] - c[at_c]
            part = part + (gap * gap).sum(axis=1)
            alive = part <= most[at_q]
            at_q, at_c, part = at_q[alive], at_c[alive], part[alive]
    return at_q, at_c


def _search(turns: dict[int, np.ndarray], k: int):
    def of(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim, part in asks.groupby("dim"):
            mine = rows[rows["dim"] == dim]
            if len(mine):
                found.append(_scan_list(turns.get(int(dim)), k, mine, part, int(dim)))
        return pd.concat(found) if found else pd.DataFrame(columns=["aid", "id", "rid", "score"])

    return of


def _scan_list(turn, k: int, rows: pd.DataFrame, asks: pd.DataFrame, dim: int) -> pd.DataFrame:
    x, q = B.matrix(rows["x"], dim), B.matrix(asks["x"], dim)
    turn = rotation(dim) if turn is None else turn
    blocks = range(0, dim, COLUMNS)
    by_column = [np.ascontiguousarray((x @ turn)[:, s : s + COLUMNS]) for s in blocks]
    asked = [np.ascontiguousarray((q @ turn)[:, s : s + COLUMNS]) for s in blocks]
    ids, rids, own = rows["id"].to_numpy(), rows["rid"].to_numpy(), asks["own"].to_numpy()
    limit = np.square(asks["kth"].fillna(np.inf).to_numpy(dtype=float))
    best = np.full((len(q), k), -np.inf)
    best_id, best_rid = np.full((len(q), k), LAST), np.full((len(q), k), LAST)
    for start, end in pairwise([0, *range(FIRST, len(x), STRIDE), len(x)]):
        at_q, at_c = adaptive([c[start:end] for c in by_column], asked, limit)
        at_c = at_c + start
        keep = rids[at_c] != own[at_q]
        at_q, at_c = at_q[keep], at_c[keep]
        # exact distances on original vectors
        score = np.empty(len(at_q))
        for s in range(0, len(at_q), 1 << 16):
            gap = q[at_q[s : s + (1 << 16)]] - x[at_c[s : s + (1 << 16)]]
            score[s : s + (1 << 16)] = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((rids[at_c], ids[at_c], score, at_q))
        at_q, at_c, score = at_q[order], at_c[order], score[order]
        # the k best of each query, as a row of an array
        place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
        at_q, at_c, score, place = (v[place < k] for v in (at_q, at_c, score, place))
        new, new_id, new_rid = np.full(best.shape, -np.inf), np.full(best.shape, LAST), np.full(best.shape, LAST)
        new[at_q, place], new_id[at_q, place], new_rid[at_q, place] = -score, ids[at_c], rids[at_c]
        joined = [np.concatenate(p, axis=1) for p in ((best, new), (best_id, new_id), (best_rid, new_rid))]
        best, best_id, best_rid = B.merge_best(*joined, k)
        limit = np.minimum(limit, np.square(best[:, -1]))
    at_q, at_k = np.nonzero(~np.isneginf(best))
    return pd.DataFrame({"aid": asks["aid"].to_numpy()[at_q], "id": best_id[at_q, at_k], "rid": best_rid[at_q, at_k], "score": -best[at_q, at_k]})


def neighbours(vectors: DataFrame, every: int = 100, k: int = K, size: int = LIST, block: int = B.BLOCK) -> DataFrame:
    """vectors: vec_id (an integer), embedding.  Queries are the rows whose vec_id
    is divisible by `every`.  query_id, rank, vec_id, score (distance)."""
    whole = vectors.select(
        F.coalesce(F.col("vec_id").cast("bigint"), F.lit(LAST)).alias("id"), F.col("embedding").cast("array<double>").alias("x")
    )
    rows = whole.filter(B.usable(F.col("x")) & F.exists("x", lambda v: v != 0)).withColumn("dim", F.size("x"))
    rows = B.numbered(rows, "searched-vectors")
    lists, rest = _fit(rows, k, size)
    sent = rows.sparkSession.sparkContext.broadcast(lists)
    turns = {dim: it.turn for dim, it in lists.items()}
    own_list = F.coalesce(F.get(_near(sent, "own"), F.lit(0)), B.rest_cell(rest))
    placed = materialize(rows.withColumn("cell", own_list), "listed-vectors")
    blocks = B.counted(placed, block)
    queries = placed.filter((F.col("id") % every == 0) & (F.col("id") != LAST))
    asks = queries.select(F.col("rid").alias("aid"), F.col("rid").alias("own"), F.col("id").alias("query_id"), "dim", "x", "cell")
    asks = materialize(asks.withColumn("kth", F.lit(None).cast("double")), "nearest-asks")
    best = Window.partitionBy("aid").orderBy("score", "id", "rid")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    schema = "aid bigint, id bigint, rid bigint, score double"
    found = materialize(top(B.scan(placed, blocks, asks, _search(turns, k), schema)), "nearest-home")
    if any(it.probes > 1 for it in lists.values()):
        bound = found.filter(F.col("rank") == k).select("aid", F.col("score").alias("kth"))
        more = asks.drop("kth", "cell").join(bound, "aid", "left").withColumn("cell", F.explode(_near(sent, "rest")))
        more = B.scan(placed, blocks, materialize(more, "nearest-more"), _search(turns, k), schema)
        found = top(found.drop("rank").unionByName(more))
    return found.join(asks.select("aid", "query_id"), "aid").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != LAST, F.col("id")).alias("vec_id"), "score"
    )
