"""The inverted index: plain tables of postings, profiles, blocks and terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import config as C
from folioscan.functions import text as T
from folioscan.sources import store

#: The searched columns, in order.
COLUMNS = ("content", "section_path_text", "chunk_type", "source_id", "edition", "source_type")
REQUIRED = {
    "chunk_id", "document_id", "content", "section_path", "chunk_type", "source_id", "edition", "source_type",
    "authority_level", "parent_chunk_id", "previous_chunk_id", "next_chunk_id", "child_no",
}
TABLES = ("chunks", "postings", "profiles", "blocks", "terms", "sizes")
#: Entries of a block (about).
BLOCK = 128
#: Bytes of input files for one bucket of a scan_index (about, and at most).
BUCKET = 4_000_000


@dataclass(frozen=True)
class Index:
    """chunks as given; postings: term, chunk_id, col, pos; profiles: chunk_id,
    length (terms of all columns), freqs (term, f); blocks: term, n, most_f,
    least_length, entries (chunk_id, f, length); terms: term, df (chunks), cf
    (places); sizes: one row of n and total (length).

    Of an index in segments, every table but terms and sizes has a column segment,
    and dead (segment, chunk_id) lists what has been replaced or deleted since.

    An index for one batch of questions (scan_index) has no blocks but words:
    chunk_id, length, words (the terms of each column, in order), and it is dealt
    by chunk_id, so what is counted per chunk needs no exchange.  Its profiles and
    terms are counted when they are read: a batch counts only the terms it asks for."""

    chunks: DataFrame
    postings: DataFrame
    profiles: DataFrame
    blocks: DataFrame | None
    terms: DataFrame
    sizes: DataFrame
    dead: DataFrame | None = None
    words: DataFrame | None = None

    def live(self, rows: DataFrame) -> DataFrame:
        """rows of a table of this index (or of the entries of its blocks) without dead chunks."""
        return rows if self.dead is None else rows.join(self.dead, ["segment", "chunk_id"], "left_anti").drop("segment")

    @property
    def lengths(self) -> DataFrame:
        keep = [c for c in ("segment", "chunk_id", "length") if c in self.profiles.columns]
        return self.live((self.profiles if self.words is None else self.words).select(*keep))

    def counts(self, asked: DataFrame) -> DataFrame:
        """asked: term.  term, df, cf of those that are held."""
        if self.words is None:
            return self.terms.join(asked.distinct(), "term", "left_semi")
        # the terms of a batch are small beside the texts
        wanted = F.broadcast(store.stored(asked.distinct(), "asked-words"))
        return _spread(terms_of(self.words).join(wanted, "term", "left_semi"))


def check_chunks(chunks: DataFrame) -> None:
    if missing := REQUIRED - set(chunks.columns):
        raise ValueError(f"stale index: missing columns {sorted(missing)}")


def postings(chunks: DataFrame) -> DataFrame:
    """One row per term occurrence; positions count from 0 in each column."""
    texts = chunks.withColumn("section_path_text", F.array_join("section_path", " "))
    each = F.explode(
        F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("text")) for i, c in enumerate(COLUMNS)])
    )
    fields = texts.select("chunk_id", each.alias("f")).select("chunk_id", "f.col", "f.text")
    return fields.select("chunk_id", "col", F.posexplode(T.index_terms(F.col("text"))).alias("pos", "term"))


def part(f: Column, length: Column, average: Column) -> Column:
    """What f occurrences in a text of a length add, without the weight of the term.
    It grows with f and falls with the length, so the most f and the least length
    of a block bound it."""
    norm = C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / average)
    return f * (C.BM25_K1 + 1) / (f + norm)


def with_words(chunks: DataFrame) -> DataFrame:
    """Adds words: the terms of each column, in order."""
    none = F.array().cast("array<string>")
    text = {c: F.col(c) for c in COLUMNS} | {"section_path_text": F.array_join("section_path", " ")}
    return chunks.withColumn("words", F.array(*[F.coalesce(T.index_terms(text[c]), none) for c in COLUMNS]))


def length_of() -> Column:
    return F.size(F.flatten("words")).cast("long")


def with_counts(chunks: DataFrame) -> DataFrame:
    """Adds length and freqs to rows with words: the terms of a row are sorted, and
    a term counts up to where the next one begins."""
    terms, at = F.col("__terms"), F.col("__at")
    sorted_ = chunks.withColumn("length", length_of()).withColumn("__terms", F.sort_array(F.flatten("words")))
    every = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(every, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    f = lambda i, k: F.coalesce(F.get(at, k + 1), F.size(terms)) - i
    counted = F.transform(at, lambda i, k: F.struct(F.get(terms, i).alias("term"), f(i, k).cast("long").alias("f")))
    return sorted_.withColumn("__at", begins).withColumn("freqs", counted).drop("__terms", "__at")


def profiles(chunks: DataFrame) -> DataFrame:
    return with_counts(with_words(chunks)).select("chunk_id", "length", "freqs")


def blocks(profiles: DataFrame, size: int = BLOCK) -> DataFrame:
    """Lists of terms in blocks of about size entries that are alike in f and in
    length, so that the bound of a block is near to what it holds.  A frequent term
    has many blocks, in many tasks."""
    each = profiles.select("chunk_id", "length", F.explode("freqs").alias("e")).select("e.term", "chunk_id", "e.f", "length")
    band = F.least("f", F.lit(4)) * 64 + F.floor(F.log2(F.greatest("length", F.lit(1))) * 2).cast("long")
    each = each.withColumn("band", band)
    many = each.groupBy("term", "band").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")).filter("parts > 1")
    dealt = each.join(many, ["term", "band"], "left").withColumn(
        "shard", F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1)))
    )
    return dealt.groupBy("term", "band", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.max("f").alias("most_f"), F.min("length").alias("least_length"),
        F.collect_list(F.struct("chunk_id", "f", "length")).alias("entries"),
    ).drop("band", "shard")


def term_counts(profiles: DataFrame) -> DataFrame:
    each = profiles.select(F.explode("freqs").alias("e"))
    return each.groupBy(F.col("e.term").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.sum("e.f").alias("cf"))


def size_counts(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))


def build_index(chunks: DataFrame) -> Index:
    """Tables are stored in the shared folder, so that a search reads them as
    columns instead of splitting texts again."""
    check_chunks(chunks)
    kept = store.stored(chunks, "chunks")
    places = store.stored(postings(kept), "postings")
    profile = store.stored(profiles(kept), "profiles")
    listed = store.stored(blocks(profile), "blocks")
    return Index(kept, places, profile, listed, store.stored(term_counts(profile), "terms"), store.stored(size_counts(profile), "sizes"))


def scan_index(chunks: DataFrame) -> Index:
    """An index for one batch of questions: the texts are split once and dealt once,
    by chunk_id, and no list of a term is gathered; scores are summed where a chunk
    lies.  What is written and exchanged is about the texts and the words."""
    check_chunks(chunks)
    # a bucket is one task's work: the scores of its chunks should fit the task's memory
    n = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-store.input_bytes(chunks) // BUCKET))
    split = with_words(chunks.repartition(n, "chunk_id")).withColumn("length", length_of())
    whole = store.bucketed(split, "scan-index", n, "chunk_id")
    words = whole.select("chunk_id", "length", "words")
    return Index(
        whole.select(*chunks.columns), places_of(words).select("chunk_id", "col", "pos", "term"), with_counts(words).select("chunk_id", "length", "freqs"), None,
        _spread(terms_of(words)), store.stored(size_counts(words), "sizes"), words=words,
    )


def terms_of(words: DataFrame) -> DataFrame:
    """One row per term occurrence."""
    return words.select("chunk_id", F.explode(F.flatten("words")).alias("term"))


def _spread(terms: DataFrame) -> DataFrame:
    """term, df, cf, counted first where a chunk lies."""
    each = terms.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("f"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("cf"))


def places_of(words: DataFrame) -> DataFrame:
    """One row per term occurrence, with the words of its column (around)."""
    each = words.select("chunk_id", "length", F.posexplode("words").alias("col", "around"))
    return each.select("chunk_id", "length", "col", "around", F.posexplode("around").alias("pos", "term"))


def sorted_tables(index: Index) -> dict[str, DataFrame]:
    """The tables as they are published: by term, so that a search skips row groups."""
    by_term = lambda df, *more: df.repartitionByRange("term", *more).sortWithinPartitions("term", *more)
    return {
        "chunks": index.chunks, "postings": by_term(index.postings, "chunk_id"), "profiles": index.profiles,
        "blocks": by_term(index.blocks, "least_length"), "terms": by_term(index.terms), "sizes": index.sizes,
    }


def publish_index(index: Index, root: str) -> str:
    return store.publish(sorted_tables(index), root)


def open_index(spark: SparkSession, root: str) -> Index:
    """The newest published version, whole or in segments."""
    from . import segments

    if segments.is_segmented(spark, root):
        return segments.open_segments(spark, root)
    tables = store.published(spark, root, *TABLES)
    check_chunks(tables["chunks"])
    return Index(**tables)
