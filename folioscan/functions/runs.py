"""Gaps and islands: runs of neighbouring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_runs(df: DataFrame, keys: list[str], order: str, same: Column, out: str) -> DataFrame:
    """Numbers runs of rows with one value of `same`, in the order, from 1."""
    rows = Window.partitionBy(*keys).orderBy(order)
    turn = F.coalesce((~same.eqNullSafe(F.lag(same).over(rows))).cast("int"), F.lit(1))
    first = F.row_number().over(rows) == 1
    marked = df.withColumn("__turn", F.when(first, 1).otherwise(turn))
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.sum("__turn").over(upto)).drop("__turn")


def number_heads(df: DataFrame, keys: list[str], order: str, head: Column, out: str) -> DataFrame:
    """Numbers the stretches that begin at rows with head; rows before the first have 0."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(head.cast("int")).over(upto))


def joined(text: str, order: str, sep: str) -> Column:
    """Texts of a group in order, joined: order is part of what is collected."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)
