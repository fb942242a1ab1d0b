"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder stands in on a local master only; a
    cluster without the setting is an error, since its executors share no disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioscan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: a cut of the
    lineage that outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    for file in df.inputFiles():
        drop_scratch(df.sparkSession, file.rpartition("/")[0])
        return


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    name, n = f"__{base}", 0
    while name.lower() in have:
        n += 1
        name = f"__{base}_{n}"
    return name


def running_sums(
    df: DataFrame, keys: list[str], chunk: str, order: list, values: dict[str, str]
) -> DataFrame:
    """Adds, per entry out: value of values, the sum of value over all rows of
    the same keys before this row, in the order of (chunk, *order).

    Two levels: sums per chunk give each chunk its offset, and only the rows of
    one chunk are ordered in one task, so a key with a third of all rows is
    split over its chunks.  Keys and chunk must not be null.
    """
    sums = df.groupBy(*keys, chunk).agg(*[F.sum(v).alias(f"__sum_{o}") for o, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        chunk,
        *[F.coalesce(F.sum(f"__sum_{o}").over(before), F.lit(0)).alias(f"__offset_{o}") for o in values],
    )
    within = (
        Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.join(offsets, [*keys, chunk])
        .withColumns(
            {
                o: F.col(f"__offset_{o}") + F.coalesce(F.sum(v).over(within), F.lit(0))
                for o, v in values.items()
            }
        )
        .drop(*[f"__offset_{o}" for o in values])
    )


def running_sum(
    df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str
) -> DataFrame:
    return running_sums(df, keys, chunk, order, {out: value})
