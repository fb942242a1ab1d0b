"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once per turn, each snapshot a prefix of the
next.  Rolling hashes of every turn prefix (three sums of hashes that carry the
turn's place) identify conversations that prefix longer ones or equal others; an
anti-join keeps the maximal ones, which are then rendered.  Only DataFrame
functions are used.

Defined results: turns are ordered by turn, role, text, nulls first; a null role
or text differs from an empty one but is rendered like it; rows without conv_id
belong to no conversation; of equal conversations the smallest conv_id stays;
an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_sums

HASHES = ("a", "b", "c")
#: Turn numbers per chunk of a conversation: what one task orders.
CHUNK = 256
START, END = "<|im_start|>", "<|im_end|>\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k and the rolling hash (a, b, c) of the first k turns."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    rows = (
        turns.filter("conv_id is not null")
        .select("conv_id", "turn", "role", "text", F.lit(1).alias("one"))
        .withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**60))))
    )
    placed = running_sums(rows, ["conv_id"], "chunk", order, {"at": "one"})
    said = F.struct(F.col("role").isNull(), F.col("text").isNull(), "role", "text")
    hashed = materialize(
        placed.select(
            "conv_id",
            "chunk",
            "at",
            # 31 bits each, so that sums stay in range
            *[
                F.xxhash64(F.lit(h), "at", said).bitwiseAND(2**31 - 1).alias(f"own_{h}")
                for h in HASHES
            ],
        ),
        "turn-hashes",
    )
    sums = running_sums(hashed, ["conv_id"], "chunk", ["at"], {h: f"own_{h}" for h in HASHES})
    return sums.select(
        "conv_id",
        (F.col("at") + 1).alias("k"),
        *[(F.col(h) + F.col(f"own_{h}")).alias(h) for h in HASHES],
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies (equal conversations) of the conversations
    that prefix no other one."""
    key = ["k", *HASHES]
    every = materialize(prefixes(turns), "turn-prefixes")
    whole = every.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end"))
    ends = (
        whole.select("conv_id", "end.*")
        .groupBy(*key)
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    length = whole.select("conv_id", F.col("end.k").alias("n"))
    proper = every.join(length, "conv_id").filter("k < n").select(*key).distinct()
    return ends.join(proper, key, "left_anti").select(
        "conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies"
    )


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds chat, the conversation in one string.  A conversation is one row of
    the result, so its turns meet in one task here, and only here."""
    said = F.transform(
        F.array_sort(F.collect_list(F.struct("order", "role", "text"))),
        lambda t: F.concat(
            F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END)
        ),
    )
    ordered = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").isNotNull(), "turn", F.col("role").isNotNull().alias("r"), F.coalesce("role", F.lit("")).alias("rr"),
            F.col("text").isNotNull().alias("t"), F.coalesce("text", F.lit("")).alias("tt"),
        ).alias("order"),
        "role",
        "text",
    )
    return (
        ordered.join(kept, "conv_id")
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_join(said, "").alias("chat"))
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, chat."""
    return render(turns, materialize(maximal(turns), "chats-kept"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, k, string_agg(md5(coalesce('r' || role, 'n')) || md5(coalesce('t' || text, 'n')), '')
    OVER (PARTITION BY conv_id ORDER BY k) AS path,
    max(k) OVER (PARTITION BY conv_id) AS n
  FROM t),
ends AS (
  SELECT path, min(conv_id) AS conv_id, min(n) AS n_turns, count(*) AS n_copies
  FROM p WHERE k = n GROUP BY path),
kept AS (
  SELECT * FROM ends WHERE path NOT IN (SELECT path FROM p WHERE k < n))
SELECT kept.conv_id, kept.n_turns, kept.n_copies,
  string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), '' ORDER BY t.k) AS chat
FROM kept JOIN t ON t.conv_id = kept.conv_id
GROUP BY kept.conv_id, kept.n_turns, kept.n_copies
"""
