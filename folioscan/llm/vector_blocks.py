"""Rows and asks in bounded blocks: how the vector searches meet their data.

Rows lie in cells.  A cell with more than `most` rows is dealt to blocks by row
number, and the asks that name a cell are dealt to slices, so a task holds one
block and one slice, however hot the cell is.  Cells are few by construction
(MAX_CELLS), so what is counted per cell may go to the driver and back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block and asks of a slice (about), and the most cells of all lengths.
BLOCK, SLICE, MAX_CELLS = 8_192, 1_024, 2_048
#: Lengths of vectors that get cells of their own; all others share REST cells.
MAX_LENGTHS, REST = 8, 64
#: Rows of the sample that a structure is fitted on (about; at most twice this).
SAMPLE = 16_384


def usable(e: Column) -> Column:
    """Not null, and no component null or not finite."""
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & good, F.lit(False))


def numbered(vectors: DataFrame, name: str) -> DataFrame:
    """The table with a row number `rid` that stays, since it is written."""
    return materialize(vectors.withColumn("rid", F.monotonically_increasing_id()), name)


def lengths(rows: DataFrame) -> dict[int, int]:
    """Rows by length of vector, for the MAX_LENGTHS lengths with most rows."""
    by = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "dim").limit(MAX_LENGTHS)
    return {r["dim"]: r["m"] for r in by.collect()}


def sample(rows: DataFrame, dim: int, count: int, most: int = SAMPLE) -> np.ndarray:
    """About `most` vectors of one length, each row with the same chance."""
    part = rows.filter(F.col("dim") == dim)
    if count > most:
        part = part.sample(False, most / count, 7).limit(2 * most)
    return matrix(part.select("x").toPandas()["x"], dim)


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, dim))


def rest_cell(first: int) -> Column:
    """The cell of a row whose length has no cells of its own."""
    return (F.lit(first) + F.pmod(F.xxhash64("dim"), F.lit(REST))).cast("int")


def counted(placed: DataFrame, most: int = BLOCK) -> dict[int, int]:
    """Blocks of each cell."""
    return {r["cell"]: -(-r["m"] // most) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect()}


def _per_cell(df: DataFrame, column: str, values: dict[int, int]) -> DataFrame:
    """df with the number of its cell; values are as few as there are cells."""
    table = df.sparkSession.createDataFrame(list(values.items()), f"cell int, {column} int")
    return df.join(F.broadcast(table), "cell")


def scan(
    placed: DataFrame, blocks: dict[int, int], asks: DataFrame, work: Callable, schema: str, most: int = SLICE
) -> DataFrame:
    """Every ask (cell, aid, ...) meets every row of the cell it names, one block
    and one slice in each call of work(rows, asks); work gets frames, neither of
    them empty."""
    n = {r["cell"]: -(-r["m"] // most) for r in asks.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect()}
    n = {cell: slices for cell, slices in n.items() if cell in blocks}
    if not n:
        return placed.sparkSession.createDataFrame([], schema)
    key = ["cell", "block", "slice"]
    dealt = _per_cell(_per_cell(placed, "slices", n), "blocks", {c: blocks[c] for c in n})
    rows = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn(
        "slice", F.explode(F.expr("sequence(0, slices - 1)"))
    )
    asked = _per_cell(_per_cell(asks, "slices", n), "blocks", {c: blocks[c] for c in n})
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("aid"), F.col("slices")).cast("int")).withColumn(
        "block", F.explode(F.expr("sequence(0, blocks - 1)"))
    )
    names = [part.split()[0] for part in schema.split(",")]

    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(left, right) if len(left) and len(right) else pd.DataFrame(columns=names)

    left = rows.drop("blocks", "slices").groupBy(*key)
    return left.cogroup(asked.drop("blocks", "slices").groupBy(*key)).applyInPandas(of, schema)


def merge_best(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row: highest score, then smallest id and rid."""
    order = np.lexsort((rids, ids, -scores), axis=-1)[:, :k]
    return tuple(np.take_along_axis(a, order, axis=1) for a in (scores, ids, rids))
