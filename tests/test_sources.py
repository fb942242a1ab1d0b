import json
import zipfile

import pytest

from folioscan import schemas
from folioscan.sources import markup, scan, store


def test_rich_text_spans():
    source = r"{\rtf1{\fonttbl{\f0 Arial;}}\fs28 Title\par\plain{\b Range:} far \u233?\'e9{\*\x hidden}\par A\cell B}"
    got = markup.merged(markup.rich_text_pieces(source))
    assert got[0] == {"text": "Title\n", "font_size": 28, "bold": False}
    assert {"text": "Range:", "font_size": 24, "bold": True} in got
    text = "".join(s["text"] for s in got)
    assert " far éé" in text and "hidden" not in text and "Arial" not in text and "A | B" in text
    assert markup.rich_text("{a\\par\\par\\par\\par b}") == "a\n\nb"


def test_unicode_fallback():
    back = chr(92)
    source = "{" + back + "uc2" + back + "u" + "8212 --x" + back + "uc0" + back + "u" + "233y}"
    assert "".join(p[0] for p in markup.rich_text_pieces(source)) == chr(8212) + "x" + chr(233) + "y"


def test_page_spans(spark):
    pages = spark.createDataFrame([(1, "<h1>T &amp; U</h1><p>a <b>b</b></p><script>x</script>"), (2, None)], "file int, html string")
    got = [(r.text, r.font_size, r.bold) for r in markup.spans(pages, "html", "page").orderBy("file", "span_no").collect()]
    assert ("T & U", 36, False) in [(t.strip(), s, b) for t, s, b in got] and all("x" not in t for t, _, _ in got)
    assert ("b", 24, True) in got


def test_safe_unzip(tmp_path):
    good, bad, empty = tmp_path / "a.zip", tmp_path / "b.zip", tmp_path / "c.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("d/x.rtf", "1")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x", "1")
    zipfile.ZipFile(empty, "w").close()
    assert scan.unzip(good, tmp_path / "out") == ["d/x.rtf"]
    for path in (bad, empty):
        with pytest.raises(ValueError):
            scan.unzip(path, tmp_path / "out2")
    with pytest.raises(ValueError):
        scan.verify(good, {"sha1": "00"})
    with pytest.raises(ValueError):
        scan.inside(tmp_path, "../..")


def test_json_scans(spark, tmp_path):
    doc = {"document_id": "a::1", "source_ref": {"source_id": "a", "edition": "e", "source_type": "t", "authority_level": "l", "title": "x"}, "locator": {"section_path": ["p", "q"]}, "content": "hello"}
    (tmp_path / "1.json").write_text(json.dumps(doc))
    (tmp_path / "canonical_report.json").write_text("{}")
    rows = scan.as_documents(scan.read_canonical(spark, str(tmp_path))).collect()
    assert [(r.document_id, r.source_id, r.section_path, r.cuts) for r in rows] == [("a::1", "a", ["p", "q"], [])]
    doc["source_ref"]["source_id"] = "b"
    (tmp_path / "2.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError):
        scan.read_canonical(spark, str(tmp_path))


def test_gold_needs_all_fields(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(json.dumps([{"eval_id": "1"}]))
    with pytest.raises(ValueError):
        scan.read_gold(spark, str(path))


def test_rich_text_scan(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.rtf").write_bytes(rb"{\rtf1 caf\'e9\par}")
    files = scan.read_rich_text(spark, str(tmp_path), 1)
    assert [r.file_stem for r in files.collect()] == ["a"]
    assert "café\n" in [r.text for r in markup.spans(files).collect()]


def test_publish_keeps_the_old_version(spark, tmp_path):
    root = str(tmp_path / "index")
    store.publish({"t": spark.range(3)}, root)
    with pytest.raises(Exception):  # noqa: B017
        store.publish({"t": spark.range(3).selectExpr("raise_error('x') as id")}, root)
    assert store.published(spark, root, "t")["t"].count() == 3
    store.publish({"t": spark.range(5)}, root)
    assert store.published(spark, root, "t")["t"].count() == 5


def rich(*lines):
    """A rich text of (text, size, bold) lines."""
    return b"{\\rtf1 " + b"".join(b"{\\fs%d%s %s}\\par\n" % (size, b"\\b" if bold else b"", text.encode()) for text, size, bold in lines) + b"}"


def test_command_line(spark, tmp_path, capsys):
    """Files to documents, chunks, an index, an answer and a report; entries come
    from a registry and give their titles to citations."""
    from folioscan import cli

    root = tmp_path / "raw"
    root.mkdir()
    body = "The flame burns all creatures near the caster, and each of them takes damage at once. " * 2
    (root / "Spells.rtf").write_bytes(
        rich(("Fire Ball", 28, False), ("Evocation", 24, False), ("Level: 3", 24, True), ("Range: far", 24, True), (body, 24, False))
    )
    (root / "Plain.rtf").write_bytes(rich(("Combat Rules", 28, False), (body.replace("flame", "blade"), 24, False), (body, 24, False)))
    kind = {"name": "spell", "category": "Spells", "chunk_type": "spell_entry", "shape": "entry_with_statblock", "file_match": ["Spell*.rtf"]}
    (tmp_path / "types.json").write_text(json.dumps({"content_types": [kind]}))
    case = dict.fromkeys(("question_type", "expected_answer_notes"), "x") | {"expected_source_ids": ["s"], "expected_behavior": "direct_answer"}
    cases = [case | {"eval_id": "c1", "question": "fire ball", "expected_section_or_entry": ["Spells", "Fire Ball"]}]
    cases += [case | {"eval_id": "c2", "question": "no such thing", "expected_section_or_entry": [], "expected_behavior": "abstain"}]
    (tmp_path / "gold.json").write_text(json.dumps(cases))
    (tmp_path / "chunking.json").write_text(json.dumps({"child_threshold_chars": 50}))
    at = lambda n: str(tmp_path / n)
    cli.ingest(spark, cli.parser().parse_args(["ingest", "--root", str(root), "--output", at("docs"), "--source-id", "s", "--edition", "e", "--source-type", "core", "--types", at("types.json"), "--extracted", at("ext")]))
    docs = {r.document_title: r for r in spark.read.parquet(at("docs")).collect()}
    assert docs["Fire Ball"].entry_title == "Fire Ball" and docs["Fire Ball"].section_path == ["Spells", "Fire Ball"] and docs["Combat Rules"].entry_title is None
    assert spark.read.parquet(at("ext/text")).count() == 2 and spark.read.parquet(at("ext/decisions")).filter("reason_code = 'entry_annotated'").count() == 1
    cli.chunk(spark, cli.parser().parse_args(["chunk", "--documents", at("docs"), "--output", at("chunks"), "--settings", at("chunking.json")]))
    assert spark.read.parquet(at("chunks")).filter("parent_chunk_id is not null and entry_title = 'Fire Ball'").count() > 0
    cli.build(spark, cli.parser().parse_args(["index", "--chunks", at("chunks"), "--output", at("ix")]))
    # the same in segments, with terms as the command of that name writes them
    cli.build(spark, cli.parser().parse_args(["index", "--update", "--chunks", at("chunks"), "--output", at("seg")]))
    (tmp_path / "reviewed.json").write_text(json.dumps({"phrases": ["fire ball"], "aliases": {"fb": "fire ball"}, "variants": ["fire balls"]}))
    cli.mine(spark, cli.parser().parse_args(["terms", "--documents", at("docs"), "--chunks", at("chunks"), "--output", at("terms"), "--reviewed", at("reviewed.json")]))
    capsys.readouterr()
    cli.show(spark, cli.parser().parse_args(["retrieve", "--query", "FB", "--index", at("seg"), "--terms", at("terms"), "--text"]))
    out = capsys.readouterr().out
    for part in ("Normalized: fire ball", "Tokens:     ['fire ball']", "Aliases:    ['fb']", "PIPELINE TRACE", "--- Evidence #1 (rank 1) ---", "signals:     section_path_hit", "exact=['fire ball']", "adjacency:   parent=", "→2 spans"):
        assert part in out, out
    cli.show(spark, cli.parser().parse_args(["retrieve", "--query", "FB", "--index", at("seg"), "--terms", at("terms"), "--debug"]))
    told = json.loads(capsys.readouterr().out)
    assert told["query"]["protected_phrases"] == ["fire ball"] and told["trace"]["total_candidates"] >= len(told["evidence"]) > 0
    assert told["evidence"][0]["locator"]["section_path"] == ["Spells", "Fire Ball"] and told["trace"]["groups"][0]["span_count"] > 0
    cli.search(spark, cli.parser().parse_args(["search", "--expression", 'section_path_text : "fire ball" NOT blade', "--index", at("seg")]))
    assert "Fire Ball" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="malformed"):
        cli.search(spark, cli.parser().parse_args(["search", "--expression", "fire AND", "--index", at("seg")]))
    (tmp_path / "gone.txt").write_text("\n".join(r.chunk_id for r in spark.read.parquet(at("chunks")).select("chunk_id").collect()[1:]))
    cli.build(spark, cli.parser().parse_args(["index", "--delete", at("gone.txt"), "--output", at("seg")]))
    cli.merge(spark, cli.parser().parse_args(["merge", "--index", at("seg"), "--vacuum"]))
    from folioscan.operators import index

    assert index.open_index(spark, at("seg")).sizes.first().n == 1
    # a schema is kept to, or told
    (tmp_path / "schemas").mkdir()
    for name, made in (("chunk", schemas.chunk()), ("common", schemas.common(("core",), ("",)))):
        (tmp_path / f"schemas/{name}.schema.json").write_text(json.dumps(made))
    again = ["chunk", "--documents", at("docs"), "--settings", at("chunking.json"), "--schema", at("schemas/chunk.schema.json"), "--force", "--output"]
    cli.chunk(spark, cli.parser().parse_args([*again, at("chunks2"), "--records", at("records")]))
    # one file per chunk, which reads back as the chunks
    back = scan.as_chunks(scan.read_chunks(spark, at("records")))
    keep = ["chunk_id", "document_id", "source_id", "section_path", "entry_title", "content", "parent_chunk_id", "next_chunk_id", "split_origin", "child_no"]
    assert sorted(map(str, back.select(keep).collect())) == sorted(map(str, spark.read.parquet(at("chunks2")).select(keep).collect()))
    assert any("child_001" in p.name for p in (tmp_path / "records").iterdir())
    (tmp_path / "schemas/common.schema.json").write_text(json.dumps(schemas.common(("other",), ("",))))
    with pytest.raises(ValueError, match=r"source_ref.source_type: enum"):
        cli.chunk(spark, cli.parser().parse_args([*again, at("chunks3")]))
    assert not (tmp_path / "chunks3").exists()
    cli.show(spark, cli.parser().parse_args(["answer", "--query", "fire ball", "--index", at("ix"), "--text"]))
    out = capsys.readouterr().out
    assert "ANSWER (" in out and "locator: Spells > Fire Ball" in out and "Candidates entering shaping" in out
    cli.run_evaluation(spark, cli.parser().parse_args(["evaluate", "--gold", at("gold.json"), "--index", at("ix"), "--edition", "e", "--json", at("r/r.json"), "--markdown", at("r/r.md")]))
    report = json.loads((tmp_path / "r/r.json").read_text())
    assert report["case_count"] == 2 and report["tag_counts"]["_clean"] == 2 and report["behavior_match_rate"] == 1.0
    first = report["cases"][0]
    assert first["actual_summary"]["citations"][0]["entry_title"] == "Fire Ball" and first["citation_checks"][0]["entry_match"] is True
    assert "_2 clean cases (c1, c2)_" in (tmp_path / "r/r.md").read_text() and "_No failing cases._" in (tmp_path / "r/r.md").read_text()


def test_scans_want_their_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"document_id": "d", "source_ref": {"source_id": "s"}, "content": "x"}))
    with pytest.raises(Exception, match="missing locator"):
        scan.read_canonical(spark, str(tmp_path)).collect()


def test_fetch_deletes_only_a_folder_of_its_own(tmp_path):
    manifest = {"source_id": "s", "artifact": {"url": "file:///none", "file_name": "a.zip"}, "local_layout": {"raw_root": "raw", "expanded_root": "."}}
    with pytest.raises(ValueError, match="no folder of its own"):
        scan.fetch(manifest, str(tmp_path), force=True)
    assert tmp_path.exists()
