"""Block-wise search, raw expressions and the segmented index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from folioscan.config import TermAssets
from folioscan.operators import chunks, index, match, normalize, retrieve, segments
from folioscan.streaming.index_stream import index_stream

CHUNK = (
    "chunk_id string, document_id string, content string, section_path array<string>, chunk_type string, source_id string, edition string, "
    "source_type string, authority_level string, parent_chunk_id string, previous_chunk_id string, next_chunk_id string, child_no int"
)
WORDS = ["fire", "ball", "fires", "fireball", "burn", "cold", "ice", "icy", "storm", "é", "x1", "the", "of"]
WEIGHTS = [3, 3, 1, 1, 2, 2, 2, 1, 2, 1, 1, 9, 6]


def rows(n=60, seed=3, first=0):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, WEIGHTS, k=k))
    made = []
    for i in range(first, first + n):
        path = ["part " + rng.choice(WORDS), text(2)]
        made.append((f"c{i:03d}", f"d{i // 3}", text(rng.choice([0, 3, 12, 60])), path, rng.choice(["generic", "table"]), "s" + str(i % 3), "e", "core", "primary", None, None, None, 0))
    return made


@pytest.fixture(scope="module")
def made(spark):
    return index.build_index(spark.createDataFrame(rows(), CHUNK))


@pytest.fixture(scope="module")
def lite():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(chunk_id unindexed, content, section_path_text, chunk_type, source_id, edition, source_type)")
    c.executemany("insert into t values (?, ?, ?, ?, ?, ?, ?)", [(r[0], r[2], " ".join(r[3]), r[4], r[5], r[6], r[7]) for r in rows()])
    return c


EXPRESSIONS = [
    "fire", "FIRE", '"fire ball"', "fire ball", "fire AND ball", "fire OR cold", "fire NOT ball", "fire ball NOT cold OR ice", "fi*", '"the fi" *', "fire + ball",
    '"the" + fir*', "^fire", "content : fire", "{content chunk_type} : (fire OR generic)", "- content : fire", "section_path_text : ^part",
    "NEAR(fire cold)", "NEAR(fire cold, 2)", 'NEAR("the fire" ice storm, 4)', "content : NEAR(fire cold, 0)", "NEAR(the of, 1)", "NEAR(fire)",
    "(fire OR cold) AND (ball OR ice)", "(fire AND ball) OR (cold AND storm)", "fire NOT (ball AND cold)", "(fire NOT ball) NOT cold", "é", "e", "zzz", "zzz OR fire",
    "zzz*", 'fire AND ""', '"" OR fire', '""', '"." NOT fire', 'NEAR("" fire)', 'fire ""', '"" "." fire', '(fire OR "") AND ball', '(fire AND "") OR ball', 'NEAR("")', 'fire + "" ball', 'fire NOT "."', '"say ""fire"" now" OR ball', "fire fire", "fire OR fire", "f* fi* fire",
    "content : (section_path_text : part)", "{source_id chunk_type} : s1", "source_id:s1 AND chunk_type:table", "content:fire ball", "NEAR", "fire NEAR ball", "near OR fire", "the OR of",
    "content : ^the", "^fi* OR ^co*", "fire AND (ball NOT the) OR ice", "NEAR(fire ball the of, 3) OR cold", "x1 OR fire", "NEAR(f* ball, 3)", "(((fire)))", "{content}:fire",
]
BAD = [
    "fire AND", "AND fire", "(fire", "fire)", '"fire', "nocol : fire", "fire ^", "NEAR(fire ball", "NEAR(fire, x)", "fire (ball)", "(fire) ball", "*", "fi**", "fire + ", "a ~ b", "fire.ball",
    "OR", "- content fire", "{content : fire", "NEAR()", "fire NOT", "^ ^fire", "content :", None,
]


def test_expressions_as_in_sqlite(spark, made, lite):
    asked = spark.createDataFrame(list(enumerate(EXPRESSIONS)), "query_id long, expression string")
    assert match.malformed(asked).collect() == []
    got = {}
    for r in match.match_scores(asked, made).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.raw_score
    for i, e in enumerate(EXPRESSIONS):
        want = dict(lite.execute("select chunk_id, bm25(t) from t where t match ?", (e,)).fetchall())
        assert set(got.get(i, {})) == set(want), e
        assert all(abs(got[i][c] - want[c]) < 2e-6 for c in want), (e, sorted(want.items())[:3], sorted(got[i].items())[:3])
    assert sum(map(len, got.values())) > 900


def test_malformed_expressions(spark, made, lite):
    asked = spark.createDataFrame(list(enumerate(BAD)), "query_id long, expression string")
    told = {r.query_id: r.error for r in match.malformed(asked).collect()}
    assert set(told) == set(range(len(BAD))) and "no such column" in told[5] and "unterminated" in told[4]
    for e in BAD[:-1]:
        with pytest.raises(sqlite3.OperationalError):
            lite.execute("select chunk_id from t where t match ?", (e,)).fetchall()
    assert match.match_scores(asked, made).collect() == []
    empty = spark.createDataFrame([(1, ""), (2, "  ")], "query_id long, expression string")
    assert match.malformed(empty).collect() == [] and match.match_scores(empty, made).collect() == []


def test_random_expressions(spark, made, lite):
    rng = random.Random(8)

    def phrase():
        return rng.choice([rng.choice(WORDS), f'"{rng.choice(WORDS)} {rng.choice(WORDS)}"', rng.choice(WORDS)[:2] + "*", "^" + rng.choice(WORDS), f"NEAR({rng.choice(WORDS)} {rng.choice(WORDS)} {rng.choice(WORDS)}, {rng.randrange(6)})"])

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["", "", "", "content : ", "- chunk_type : "]) + phrase()
        return f"({tree(depth - 1)}) {rng.choice(['AND', 'OR', 'NOT'])} ({tree(depth - 1)})"

    some = [tree(3) for _ in range(60)]
    got = {}
    for r in match.match_scores(spark.createDataFrame(list(enumerate(some)), "query_id long, expression string"), made).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.raw_score
    for i, e in enumerate(some):
        want = dict(lite.execute("select chunk_id, bm25(t) from t where t match ?", (e,)).fetchall())
        assert set(got.get(i, {})) == set(want), e
        # behind NOT a phrase adds nothing here; there, now and then, what its search has come to
        assert "NOT" in e or all(abs(got[i][c] - want[c]) < 2e-6 for c in want), e


def test_scan_finds_what_the_index_finds(spark, made):
    """An index for one batch deals texts by chunk: the same rows, and no exchange of
    scores or places."""
    scan = index.scan_index(spark.createDataFrame(rows(), CHUNK))
    listed = lambda df: sorted(map(str, df.collect()))
    by_term = lambda df: df.select("chunk_id", "length", F.array_sort("freqs").alias("freqs"))
    assert listed(scan.postings) == listed(made.postings) and listed(by_term(scan.profiles)) == listed(by_term(made.profiles))
    assert listed(scan.terms) == listed(made.terms) and listed(scan.sizes) == listed(made.sizes)
    asked = questions(spark)
    assert listed(retrieve.bm25(asked, scan)) == listed(retrieve.bm25(asked, made))
    assert listed(retrieve.top_scores(asked, scan, 4)) == listed(retrieve.top_scores(asked, made, 4))
    # NEAR and inner prefixes take the general way, whole batches of others one pass
    for some in (EXPRESSIONS, [e for e in EXPRESSIONS if "NEAR(" not in e], ['fi* + "ball"', "NEAR(fi* ball)"]):
        batch = spark.createDataFrame(list(enumerate(some)), "query_id long, expression string")
        assert listed(match.match_scores(batch, scan)) == listed(match.match_scores(batch, made))
    plan = retrieve.bm25(asked, scan)._jdf.queryExecution().executedPlan().toString()
    # beside the phrases that chunks hold nothing is exchanged, least of all scores
    assert plan.count("Exchange hashpartitioning") <= 1 and "hashpartitioning(query_id" not in plan


def test_links_are_put_in_order_without_texts(spark):
    """A file may hold most of the texts: what is dealt by file is ids alone.  Ids
    that stand twice, in one file or in two, keep their rows and links."""
    ids = [(f, f"d{i:02d}") for f in ("one", "two") for i in range(20)] + [("one", "d03"), ("one", "x1"), ("two", "x2")]
    given = spark.createDataFrame(
        [(d, f"{f}.txt#{d}", [f], f"text of {d}", None) for f, d in ids],
        "document_id string, source_location string, section_path array<string>, content string, chunk_type_hint string",
    )
    linked = chunks.parents(given)
    want = []
    for f in ("one", "two"):
        own = [None, *sorted(f"chunk::{d}" for g, d in ids if g == f), None]
        want += zip(own[1:-1], own, own[2:], strict=False)
    assert sorted(map(str, linked.select("chunk_id", "previous_chunk_id", "next_chunk_id").collect())) == sorted(
        f"Row(chunk_id={c!r}, previous_chunk_id={a!r}, next_chunk_id={b!r})" for c, a, b in want
    )
    lines = linked._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [" ".join(lines[i : i + 2]) for i, line in enumerate(lines) if "Exchange hashpartitioning(file_key" in line]
    assert len(below) == 1 and "document_id" in below[0] and "content" not in below[0]


def test_a_batch_counts_what_it_asks_for(spark, made):
    """The terms of a scan_index are counted when they are asked for, and no list of
    counts is written beside the words."""
    scan = index.scan_index(spark.createDataFrame(rows(), CHUNK))
    wanted = spark.createDataFrame([("fire",), ("of",), ("of",), ("zzz",)], "term string")
    listed = lambda df: sorted(map(str, df.select("term", "df", "cf").collect()))
    assert listed(scan.counts(wanted)) == listed(made.counts(wanted)) == listed(made.terms.filter("term in ('fire', 'of')"))
    written = {f.rpartition("/")[2].partition(".")[0]: f for f in scan.words.inputFiles()}
    assert written and "freqs" not in spark.read.parquet(*written.values()).columns


def test_search_takes_the_best(spark, made):
    asked = spark.createDataFrame([(1, "fire OR ball"), (2, "zzz")], "query_id long, expression string")
    got = match.search(asked, made, 4).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and got[0].raw_score <= got[3].raw_score and got[0].content is not None
    assert match.search(asked, made, 0).count() == 0


def questions(spark, seed=5, n=30):
    rng = random.Random(seed)
    texts = [(i, " ".join(rng.choices(WORDS, WEIGHTS, k=rng.choice([1, 2, 5, 9])))) for i in range(n)] + [(n, ""), (n + 1, "zzz"), (n + 2, "the the of")]
    return normalize.normalize(spark.createDataFrame(texts, "query_id long, raw_query string"), TermAssets({}, ("fire ball",)))


def test_best_rows_without_scoring_all(spark):
    few = [*rows(300, 11), *[(f"z{i:03d}", "d", "storm of ice", ["x"], "generic", "s", "e", "core", "primary", None, None, None, 0) for i in range(120)]]
    made = index.build_index(spark.createDataFrame(few, CHUNK))
    asked = questions(spark)
    for k in (1, 20, 10_000):
        want = retrieve.top(retrieve.bm25(asked, made), "raw_score", k).select("query_id", "chunk_id", "raw_score", "rank")
        got = retrieve.top_scores(asked, made, k).select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    # blocks are dropped before they are read: count what is left for the best row
    it = retrieve.asked(asked, made)
    bounds = retrieve.term_bounds(it, made)
    everything = made.blocks.join(it.singles, "term").agg(F.sum("n")).first()[0]
    needed = {k: retrieve.needed_blocks(it, bounds, made, k)[0].agg(F.sum("n")).first()[0] for k in (1, 20, 10_000)}
    assert needed[1] < 0.6 * everything and needed[1] <= needed[20] <= needed[10_000] == everything


def test_blocks_hold_all_and_bound_all(spark, made):
    small = index.blocks(made.profiles, 4)
    each = small.select("term", "n", "most_f", "least_length", F.explode("entries").alias("e"))
    assert each.filter("e.f > most_f or e.length < least_length").count() == 0
    want = made.postings.groupBy("term", "chunk_id").count()
    got = each.select("term", "e.chunk_id", F.col("e.f").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert small.filter("n <> size(entries)").count() == 0 and small.agg(F.max("n")).first()[0] < 20
    assert {(r.term, r.df, r.cf) for r in made.terms.collect()} == {
        (r.term, r.df, r.cf) for r in made.postings.groupBy("term").agg(F.countDistinct("chunk_id").alias("df"), F.count("*").alias("cf")).collect()
    }


def contents(it):
    """Everything a search can see of an index."""
    entry = F.explode("entries").alias("e")
    keep = ["segment"] if it.dead is not None else []
    lists = it.live(it.blocks.select("term", *keep, entry).select("term", *keep, "e.*"))
    tables = {
        "chunks": it.live(it.chunks), "postings": it.live(it.postings), "lengths": it.lengths, "terms": it.terms, "sizes": it.sizes, "lists": lists,
    }
    return {name: sorted(map(str, t.select(sorted(t.columns)).collect())) for name, t in tables.items()}


def same(spark, root, live, searched=False):
    """The index is that of the live chunks, and (searched) finds the same."""
    got = segments.open_segments(spark, root)
    want = index.build_index(spark.createDataFrame(live, CHUNK))
    assert contents(got) == contents(want)
    if not searched:
        return
    asked = questions(spark, n=8)
    found = [sorted(map(tuple, retrieve.retrieve(asked, it, None, 5).select("query_id", "rank", "chunk_id", "raw_score", "score").collect())) for it in (got, want)]
    assert found[0] == found[1] and found[0]
    told = spark.createDataFrame([(1, "fi* NOT the"), (2, "NEAR(fire ice, 4)")], "query_id long, expression string")
    assert sorted(map(tuple, match.match_scores(told, got).collect())) == sorted(map(tuple, match.match_scores(told, want).collect()))


def test_add_replace_delete_and_merge(spark, tmp_path):
    root, df = str(tmp_path / "ix"), lambda r: spark.createDataFrame(r, CHUNK)
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, root)
    base, more, changed = rows(20, 1), rows(15, 2, 20), rows(8, 3, 12)
    segments.commit(spark, root, df(base))
    segments.commit(spark, root, df([*more, more[0], (None, *more[1][1:])]))
    live = {r[0]: r for r in [*base, *more]}
    same(spark, root, list(live.values()))
    # 12 to 19 come anew, 3 and 30 go, as does one that is not there
    gone = spark.createDataFrame([("c003",), ("c030",), ("nowhere",)], "chunk_id string")
    segments.commit(spark, root, df(changed), gone)
    live |= {r[0]: r for r in changed}
    live = {i: r for i, r in live.items() if i not in ("c003", "c030")}
    same(spark, root, list(live.values()), searched=True)
    # once more, and a dead one comes back
    segments.commit(spark, root, df([base[3], changed[0]]))
    live |= {base[3][0]: base[3], changed[0][0]: changed[0]}
    same(spark, root, list(live.values()))
    before = segments.manifest(spark, root)
    assert len(before["segments"]) == 4 and sum(s["rows"] for s in before["segments"]) == len(live)
    after = segments.merge(spark, root, [s["name"] for s in before["segments"][:3]])
    assert len(after["segments"]) == 2 and all(not s["dead"] for s in after["segments"])
    same(spark, root, list(live.values()))
    assert len(segments.vacuum(spark, root)) == 3
    same(spark, root, list(live.values()), searched=True)
    segments.commit(spark, root, None, df(list(live.values())).select("chunk_id"))
    assert segments.open_segments(spark, root).sizes.first().n == 0


def test_merge_policy():
    state = [{"name": f"s{i}", "rows": n} for i, n in enumerate([1000, 20, 21, 18, 900, 25, 300])]
    assert segments.to_merge(state, 4) == ["s1", "s2", "s3", "s5"] and segments.to_merge(state[:3], 4) == []


def test_stream_to_search(spark, tmp_path):
    root, source = str(tmp_path / "ix"), tmp_path / "in"
    schema = CHUNK + ", gone boolean"
    send = lambda name, made, gone=False: spark.createDataFrame([(*r, gone) for r in made], schema).coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        index_stream(stream, root, str(tmp_path / "cp"), deleted="gone", fanout=2).awaitTermination()

    send("a", rows(12, 1))
    run()
    send("b", rows(5, 2, 10))
    run()
    send("c", rows(2, 1), True)
    run()
    live = {r[0]: r for r in [*rows(12, 1), *rows(5, 2, 10)]}
    live = {i: r for i, r in live.items() if i not in ("c000", "c001")}
    same(spark, root, list(live.values()), searched=True)
    state = segments.manifest(spark, root)
    # nothing new: no batch; a batch that ran before: no commit
    run()
    assert segments.commit(spark, root, spark.createDataFrame(rows(3, 9), CHUNK), stream="chunks", batch=2) == state
    assert segments.manifest(spark, root) == state and len(state["segments"]) < 3
    # of two writers that saw the same state one fails
    segments._publish(spark, root, dict(state))
    with pytest.raises(FileExistsError):
        segments._publish(spark, root, dict(state))


def test_commit_that_fails_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "ix")
    segments.commit(spark, root, spark.createDataFrame(rows(6, 1), CHUNK))
    state = segments.manifest(spark, root)
    broken = spark.createDataFrame(rows(6, 2), CHUNK).withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        segments.commit(spark, root, broken)
    assert segments.manifest(spark, root) == state
    same(spark, root, rows(6, 1))
