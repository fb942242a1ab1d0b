"""Golden tables: kept results, and how a new result differs from them.

A golden is JSON lines, one record each, in the order of a key.  Two tables are
compared record by record and path by path, in both directions, by one join over
the leaves of their records; absent and null are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = "array<struct<path:string,value:string>>"


def _leaves(c: Column, kind: T.DataType, path: Column) -> Column:
    """Paths and values, as texts, of all that a value holds."""
    none = F.array().cast(LEAF)
    if isinstance(kind, T.StructType):
        parts = [_leaves(c[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
        return F.when(c.isNotNull(), F.concat(none, *parts)).otherwise(none)
    if isinstance(kind, T.ArrayType):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        each = F.flatten(F.transform(c, lambda x, i: _leaves(x, kind.elementType, at(i))))
        # the number of elements, so that an empty array is not an absent one
        size = F.array(F.struct(F.concat(path, F.lit(".size")).alias("path"), F.size(c).cast("string").alias("value")))
        return F.when(c.isNotNull(), F.concat(size, each)).otherwise(none)
    if isinstance(kind, T.MapType):
        entries = F.map_entries(c)
        each = F.flatten(F.transform(entries, lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")))))
        return F.when(c.isNotNull(), each).otherwise(none)
    return F.when(c.isNotNull(), F.array(F.struct(path.alias("path"), c.cast("string").alias("value")))).otherwise(none)


def leaves(rows: DataFrame, key: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """key, copy (of rows of one key, by value), path, value of every leaf."""
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name not in (key, *skip)}
    parts = [_leaves(F.col(f"`{n}`"), k, F.lit(n)) for n, k in kinds.items()]
    each = rows.select(F.col(f"`{key}`").cast("string").alias("key"), F.concat(F.array().cast(LEAF), *parts).alias("l"))
    # a record without any leaf is a record
    whole = F.concat(F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("value"))), F.col("l"))
    numbered = each.groupBy("key", "l").agg(F.count(F.lit(1)).alias("n")).select("key", whole.alias("l"), F.explode(F.expr("sequence(1, int(n))")).alias("k"))
    copy = F.concat_ws("/", F.when(F.lit(True), F.sha2(F.to_json("l"), 256)), "k")
    return numbered.select("key", copy.alias("copy"), F.explode("l").alias("e")).select("key", "copy", "e.path", "e.value")


def differences(got: DataFrame, want: DataFrame, key: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """key, path, got, want of every leaf that differs; path is empty where the
    whole record is in one table only.  Keys that come once in both tables are
    compared by path, others as whole records."""
    a, b = (leaves(t, key, skip) for t in (got, want))
    once = lambda t: t.groupBy("key").agg(F.countDistinct("copy").alias("n")).filter("n = 1").select("key")
    single = once(a).join(once(b), "key")
    sides = []
    for t in (a, b):
        one = t.join(single, "key", "left_semi").withColumn("copy", F.lit(""))
        sides.append(one.unionByName(t.join(single, "key", "left_anti").filter("path = ''")))
    left, right = sides[0].withColumnRenamed("value", "got"), sides[1].withColumnRenamed("value", "want")
    both = left.join(right, ["key", "copy", "path"], "full").filter(~F.col("got").eqNullSafe(F.col("want")))
    return both.select("key", "path", "got", "want")


def write_golden(rows: DataFrame, folder: str, key: str) -> None:
    rows.orderBy(key).write.mode("overwrite").option("ignoreNullFields", True).json(folder)


def read_golden(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A golden with the schema of the result it is compared with; a record that
    does not fit is an error."""
    return spark.read.schema(like.schema).option("mode", "FAILFAST").json(folder)
