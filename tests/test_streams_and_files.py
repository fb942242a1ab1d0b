"""Rich text in archives and streams, the history ring, and record files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscan.operators import panels
from folioscan.sources import json_files, markup, scan
from folioscan.streaming.history import history_stream


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/") + ".rtf", text)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "b.rtf").write_bytes(rb"{\rtf1 plain\par}")
    (tmp_path / "z.zip").write_bytes(zipped(d__a=r"{\rtf1 caf\'e9\par}", c="{x}"))
    got = scan.read_rich_text(spark, str(tmp_path), archives=True)
    assert sorted((r.file_stem, r.text) for r in markup.spans(got).join(got.select("file", "file_stem"), "file").collect()) == [("a", "café\n"), ("b", "plain\n"), ("c", "x")]
    assert [r.file_stem for r in scan.read_rich_text(spark, str(tmp_path), 2, archives=True).collect()] == ["a", "b"]
    assert scan.read_rich_text(spark, str(tmp_path)).count() == 1
    (tmp_path / "bad.zip").write_bytes(zipped(**{"..__x": "1"}))
    with pytest.raises(Exception, match="unsafe member"):
        scan.read_rich_text(spark, str(tmp_path), archives=True).collect()


def test_stream_of_rich_text(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()

    def run():
        files = scan.rich_text_stream(spark, str(root), 1)
        writer = markup.spans(files).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    (root / "a.rtf").write_bytes(b"{one}")
    (root / "b.rtf").write_bytes(b"{two}")
    (root / "c.txt").write_bytes(b"{no}")
    assert run() == ["one", "two"]
    (root / "d.rtf").write_bytes(b"{three}")
    assert run() == ["one", "three", "two"] and run() == ["one", "three", "two"]


def test_rich_text_comes_back(spark):
    texts = ["plain", "a{b}c\\d", "two\nlines\tand\r", "é – 漢 😀  x", "7 digits first", "", "'quoted' ~ - _ *"]
    rows = [("f", i, t, 20 + i, i % 2 == 0) for i, t in enumerate(texts)]
    spans = spark.createDataFrame(rows, "file string, span_no int, text string, font_size int, bold boolean")
    got = markup.spans(markup.as_rich_text(spans)).orderBy("span_no").collect()
    assert [(r.text, r.font_size, r.bold) for r in got] == [(t, 20 + i, i % 2 == 0) for i, t in enumerate(texts) if t]
    # half of a pair is no character
    assert markup.merged(markup.rich_text_pieces(r"{a\u-10179?b}"))[0]["text"] == "a�b"


def test_history_ring(spark, tmp_path):
    schema, source, rings = "session long, ran_at long, query string", tmp_path / "in", {}

    def keep(batch, _):
        for r in batch.collect():
            rings.setdefault((r.session, r.change), []).append((r.entry_no, r.ran_at, r["query"]))

    def run(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(str(source / name))
        stream = history_stream(spark.readStream.schema(schema).parquet(f"{source}/*"), 5)
        # a new query each time: the state comes from the checkpoint
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        want = {}
        for r in panels.history(spark.read.parquet(f"{source}/*"), 5).collect():
            want.setdefault(r.session, []).append((r.entry_no, r.ran_at, r["query"]))
        last = {s: max(c for t, c in rings if t == s) for s, _ in rings}
        assert {s: sorted(rings[s, c]) for s, c in last.items()} == {s: sorted(v) for s, v in want.items()}

    run("a", [(s, t, f"q{s}.{t}") for s in (1, 2) for t in range(0, 40, 3)])
    run("b", [(1, 100, "new"), (3, 7, "first"), (2, 1, "late")])
    run("c", [(3, t, f"x{t}") for t in range(20, 29)])
    assert rings[3, 2][0] == (1, 28, "x28") and len(rings[3, 2]) == 5


def test_record_files(spark, tmp_path):
    root = tmp_path / "out"
    made = spark.createDataFrame([(f"chunk::d/{i}", i, None, {"a": i}) for i in range(20)], "id string, n int, none string, more map<string,int>").repartition(3)
    json_files.write_records(made, str(root), "id")
    names = sorted(p.name for p in root.iterdir())
    assert len(names) == 20 and names[0] == "chunk__d__0.json" and json.loads((root / names[0]).read_text()) == {"id": "chunk::d/0", "n": 0, "more": {"a": 0}}
    # what is there stays, without force
    with pytest.raises(Exception, match="already"):
        json_files.write_records(made.withColumn("n", F.lit(9)), str(root), "id")
    assert json.loads((root / names[0]).read_text())["n"] == 0 and sorted(p.name for p in root.iterdir()) == names
    json_files.write_records(made.withColumn("n", F.lit(9)).filter("id = 'chunk::d/0'"), str(root), "id", force=True)
    assert json.loads((root / names[0]).read_text())["n"] == 9 and json.loads((root / names[1]).read_text())["n"] != 9
    # a task that fails, and a name that comes twice, leave nothing
    broken = made.withColumn("n", F.when(F.col("n") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int"))
    for bad, told in ((broken, "lost"), (made.unionByName(made), "two records"), (made.withColumn("id", F.lit("..")), "no file")):
        with pytest.raises(Exception, match=told):
            json_files.write_records(bad, str(tmp_path / "fresh"), "id")
        assert not list((tmp_path / "fresh").glob("*"))
