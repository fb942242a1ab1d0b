"""The corpus pipeline: five stages over documents, each written and read again.

Part of the training-data subpackage: it is deleted with it.

Defined results, for every stage: columns beyond those of documents stay, under
any name; repeated rows are rows of their own; an empty table gives an empty one.
Null and empty texts are not toxic, share the fingerprint zero (so one of them
stays), hold no benchmark passage, and have no words, so the mix leaves them out.
A null doc_id is an id like any other.  Rows that are equal in every column are
told apart by nothing, so near-dedup keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import decontamination, mixing, sharding, simhash, toxicity
from folioscan.llm.common import drop_scratch, fresh, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    name = fresh(docs, "score")
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    name = fresh(docs, "contamination")
    found = decontamination.find_contamination(docs, _table(spark, sf_dir, "benchmark"), name=name)
    return found.filter(F.col(name)["n_hit"] == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, not at all up to three times, in
    the order of its schedule."""
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of the mix."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: A classifier and a fingerprint graph are no SQL; the tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_scratch(spark, last)
        last = path
    return docs
