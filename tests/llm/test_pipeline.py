"""The corpus pipeline: each stage against a brute-force version of it."""

from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import decontamination, mixing, toxicity
from test_training_data import brute_roots, brute_simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, docs)
        if name != "sharding":
            assert sorted(docs.columns) == sorted(before.columns)
    before, after = kept["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(before, model).filter("score < 0.5").collect()}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = kept["simhash_near_dedup"]
    rows = before.collect()
    prints = {r.doc_id: brute_simhash(r.text) for r in rows}
    roots = brute_roots(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(roots.values()))
    before, after = kept["decontamination"]
    windows = decontamination._windows([(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 10)
    bad = set()
    for r in before.collect():
        w = decontamination.words(r.text)
        if any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            bad.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = kept["mixing"]
    copies = after.groupBy("doc_id").count().collect()
    assert copies and max(r["count"] for r in copies) <= 3 and {r.doc_id for r in copies} <= {r.doc_id for r in before.collect()}
    # a document is there as often as the schedule takes its first word, in the order of the slots
    facts = {r.doc_id: r for r in mixing.mix(before).collect()}
    rows = {r.doc_id: r["count"] for r in copies}
    assert all(facts[d].taken > 0 for d in rows) and all(rows.get(d) == 3 for d, r in facts.items() if r.taken == 3 * r.size > 0)
    assert kept["sharding"][1].count() == after.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats and clashing names, and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    extra = ["contamination", "__contamination", "score", "__score", "secrets", "h", "__h", "shard", "copies", "__position", "visits"]
    clean = "one two three four five six seven eight nine ten eleven"
    rows = [(1, None, "s"), (2, "", "s"), (None, clean, None), (None, clean + " other words here are many and different", "t")]
    rows += [(3, "xx " + bench + " yy", "s"), (4, "a b c", "s"), (4, "a b c", "s"), (5, "word " * 30_000, "t")]
    odd = spark.createDataFrame([(*r, *["mine"] * len(extra)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in extra))
    odd = odd.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1).cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    for table in (odd, odd.limit(0)):
        for name, stage in stages.items():
            out = stage(spark, table, SF)
            if name == "sharding":
                assert out.count() == table.count()
                continue
            assert out.columns == table.columns
            got = out.collect()
            assert all(r[c] == "mine" for r in got for c in extra)
            ids = sorted(str(r.doc_id) for r in got)
            if table is odd:
                want = {
                    "toxicity": ["1", "2", "3", "4", "4", "5", "None", "None"],
                    "simhash_near_dedup": ["1", "3", "4", "5", "None", "None"],
                    "decontamination": ["1", "2", "4", "4", "5", "None", "None"],
                }
                assert name == "mixing" or ids == want[name]
                assert name != "mixing" or (set(ids) <= {"3", "4", "5", "None"} and ids)
            else:
                assert ids == []
    assert docs.count() > 0


def test_mix_keeps_equal_rows_apart(spark):
    """Equal rows have the copies of all of them."""
    docs = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(2, "d e f g", "t")] * 3, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix(docs, mixing.MixConfig(block=1)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    copies = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs, mixing.MixConfig(block=1)).groupBy("doc_id").count().collect()}
    size = {1: 3, 2: 4}
    assert all(abs(copies[d] * size[d] - taken[d]) <= size[d] * 2 for d in size)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
