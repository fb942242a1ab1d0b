"""Tables in the folder that all executors share, and versioned publishing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local
    master only, since the executors of a cluster share no disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioscan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, n: int, key: str) -> DataFrame:
    """As stored, in n buckets of a key: what is grouped or joined by the key needs
    no exchange.  df is dealt by the key into n parts, so each writes one file, and
    rows are not sorted before."""
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    table = "folioscan_" + unique.replace("-", "_")
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{unique}"
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, None)
    spark.conf.set(writers, "2")
    try:
        df.write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
    finally:
        spark.conf.unset(writers) if before is None else spark.conf.set(writers, before)
    return spark.table(table)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_bytes(df: DataFrame) -> int:
    """Size of the files that df reads; 0 if it reads none."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        p, fs = _fs(spark, spark.sparkContext._jvm.java.net.URI(name))
        total += fs.getFileStatus(p).getLen()
    return total


def _raw(spark: SparkSession, path: str):
    """As _fs; of a local disk without checksum files, since people edit such files."""
    p, fs = _fs(spark, path)
    # of Hadoop or Hive, by session
    return p, fs.getRaw() if fs.getClass().getSimpleName() in ("LocalFileSystem", "ProxyLocalFileSystem") else fs


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder.  Files that are still
    being written have names with a dot in front and are left out."""
    p, fs = _fs(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if not n.startswith("."))


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read on the driver."""
    p, fs = _raw(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Creates a small file whole, or fails if there is one: it is written under
    another name and then renamed, which replaces nothing."""
    p, fs = _raw(spark, path)
    part, _ = _raw(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(part)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(f"{path} was written by another commit")


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _raw(spark, path)
    fs.delete(p, True)


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, the newest last."""
    return children(spark, f"{root}/CURRENT")


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Writes the tables as a new version under root, then marks it as the
    newest by one empty file; at every moment readers find a whole version."""
    spark = next(iter(tables.values())).sparkSession
    last = _versions(spark, root)
    version = f"{int(last[-1].split('-')[0]) + 1 if last else 1:012d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    mark, fs = _fs(spark, f"{root}/CURRENT/{version}")
    if not fs.createNewFile(mark):
        raise OSError(f"could not publish {root}")
    return version


def published(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    found = _versions(spark, root)
    if not found:
        raise FileNotFoundError(f"nothing is published under {root}")
    return {n: spark.read.parquet(f"{root}/{found[-1]}/{n}") for n in names}
