"""Each training-data operator against brute force on small, nasty tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscan.llm import chat, decontamination, embedding_dedup, html_extract, mixing, secrets, sharding
from folioscan.llm import simhash, suffix_dedup, toxicity
from folioscan.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns with the names that the operators use inside.
EXTRA = ["size", "h", "shard", "copies", "score", "chunk", "sid", "fp", "key", "contamination_", "__h", "__size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta épsilon zeta Eta theta iota kappa".split()) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.choice([1, 5, 40, 200])) for _ in range(30)]
    shared = prose(rng, 30)
    out = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    out += [(100 + i, base[3] if i < 40 else base[i % 5] + " tail" + str(i), "en", "s0") for i in range(50)]  # a group of copies
    out += [(200, None, None, None), (201, "", "en", None), (None, "no id " + shared, "en", "s1"), (202, prose(rng, 20_000), "en", "s2")]
    out += [(203, "x " + shared + " y", "en", "s3"), (204, shared, "en", "s3"), (204, shared, "en", "s3"), (205, "ab" * 300, "en", "s1"), (206, "\t\n ", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame([(*r, 1, *["x"] * len(EXTRA)) for r in rows], SCHEMA).repartition(3)
    return made


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (8, 7), (2, 1)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert connected_components(edges.limit(0)).count() == 0


def water_fill(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = water_fill(sizes, (1, 2, 3), 3)
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(size(r[1]) for r in rows)
    taken = {}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(none).count() == 0
    assert all((r.first_position is None) == (r.taken == 0) for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0 and mixing.mixed_documents(none).count() == 0


def brute_mix(placed, config):
    """placed: (sid, start, size), plan rows; the slots one by one."""
    order, plan = placed
    total = sum(p.need for p in plan)
    before, spans = 0, []
    for p in sorted(plan, key=lambda p: p.sid):
        spans.append((-(-(before << mixing.BITS) // total), -(-(before + p.need << mixing.BITS) // total), p))
        before += p.need
    words = {p.sid: [d for d, n in order[p.sid] for _ in range(n)] for p in plan}
    used, taken, first = {p.sid: 0 for p in plan}, {}, {}
    for i in range(2 * total):
        u = i * mixing.TURN % 2**mixing.BITS
        p = next((p for lo, hi, p in spans if lo <= u < hi), None)
        if p is None or used[p.sid] >= p.need:
            continue
        k = used[p.sid]
        used[p.sid] += 1
        at = k % p.n_blocks * config.block
        n = min(config.block, p.source_size - at)
        if k == p.need - 1 and p.rest > 0:
            n = p.rest - (p.need - 1 - p.full * p.n_blocks) * config.block
        for d in words[p.sid][at : at + n]:
            taken[d] = taken.get(d, 0) + 1
            first.setdefault(d, i)
    return taken, first


@pytest.mark.parametrize("block", [16, 700])
def test_mixing_follows_the_schedule(spark, docs, block, monkeypatch):
    config = mixing.MixConfig(block=block)
    some = docs.filter("doc_id is not null and doc_id <> 204")
    placed, plan, _ = mixing._placed(some, config, ["doc_id", "text"])
    order = {}
    for r in placed.orderBy("sid", "start", "size").collect():
        order.setdefault(r.sid, []).append((r.doc_id, r.size))
    taken, first = brute_mix((order, plan.collect()), config)
    got = {r.doc_id: (r.taken, r.first_position) for r in mixing.mix(some, config).collect()}
    assert got == {d: (taken.get(d, 0), first.get(d)) for d in got}
    # the points decide: with others the mix is another, and without any an error
    monkeypatch.setattr(mixing, "TURN", (1 << mixing.BITS) - mixing.TURN)
    assert {r.doc_id: (r.taken, r.first_position) for r in mixing.mix(some, config).collect()} != got
    monkeypatch.setattr(mixing, "TURN", 0)
    with pytest.raises(RuntimeError, match="fewer slots"):
        mixing.mix(some, config).collect()


def test_points_and_bounds_are_exact_at_any_size(spark):
    """Near the largest mix: points, bounds of intervals, and that 2n points serve
    intervals of one and of a few slots in full (points in an interval are counted
    by inverting the turn, not one by one)."""
    top, one = 2**mixing.BITS, 1 << 38
    ids = [0, 1, 2**27 + 1, 2**32 + 5, 2**39 + 12_345, 2 * one - 1]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", mixing.point(mixing.F.col("i")).alias("u")).collect()
    assert all(int(r.u) == r.i * mixing.TURN % top for r in got)
    cuts = [(b, n) for n in (3, 2**27 + 9, 2**32 - 5, one) for b in (0, 1, n // 3, n - 1, n)]
    rows = spark.createDataFrame(cuts, "b long, n long")
    got = rows.select("b", "n", mixing.bound(mixing.F.col("b"), mixing.F.col("n")).alias("lo")).collect()
    assert all(int(r.lo) == -(-r.b * top // r.n) for r in got)

    def up_to(n, size, lo):
        """How many i < n have a point in [lo, lo + size)."""
        def floors(n, m, a, b):  # sum of (a * i + b) // m over i < n
            total = 0
            while True:
                total += (n - 1) * n // 2 * (a // m) + n * (b // m)
                a, b = a % m, b % m
                most = a * n + b
                if most < m:
                    return total
                n, b = divmod(most, m)
                m, a = a, m
        return floors(n, top, mixing.TURN, top - lo) - floors(n, top, mixing.TURN, top - lo - size)

    rng = random.Random(7)
    for n in (2**24, 2**28, 2**32, one):
        for need in (1, 2, 7):
            for _ in range(200):
                b = rng.randrange(n - need)
                lo, hi = (-(-x * top // n) for x in (b, b + need))
                assert up_to(2 * n, hi - lo, lo) >= need
    with pytest.raises(ValueError, match="larger blocks"):
        mixing.schedule(spark.createDataFrame([(0, 1)], "sid int, need long"), mixing.MAX_SLOTS + 1, mixing.MixConfig())


def test_mix_is_even_along_its_order(docs):
    """In every prefix of the schedule each source has its share of slots, to a few."""
    config = mixing.MixConfig(block=8)
    _, plan, n_slots = mixing._placed(docs, config, ["doc_id", "text"])
    need = {p.sid: p.need for p in plan.collect()}
    slots = sorted((r.position, r.sid) for r in mixing.schedule(plan, n_slots, config).collect())
    assert len(slots) == n_slots == sum(need.values())
    seen = dict.fromkeys(need, 0)
    for position, sid in slots:
        seen[sid] += 1
        if position < 0.9 * n_slots:
            assert all(abs(seen[s] - (position + 1) * need[s] / n_slots) <= 8 for s in need)


def test_mixed_documents(docs):
    config = mixing.MixConfig(block=8)
    mixed = mixing.mixed_documents(docs, config)
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    facts = {}
    for r in mixing.mix(docs, config).collect():
        facts.setdefault(r.doc_id, []).append(r)
    for d, n in copies.items():
        # a copy starts where the first word is taken
        assert n <= 3 * len(facts[d]) and sum(r.taken for r in facts[d]) >= n
    assert all(copies.get(d, 0) for d, rs in facts.items() if all(r.taken == 3 * r.size > 0 for r in rs))


def test_decontamination(spark, docs, rows, none):
    texts = [t for _, t, _, _ in rows if t and len(t) > 200]
    items = [(1, " ".join(texts[0].split()[3:25])), (2, "zeta 7!"), (3, None), (4, ""), (5, " ".join(texts[0].split()[3:25])), (6, rows[3][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: split.findall((t or "").translate({b: b + 32 for b in range(65, 91)}))
    want = []
    for _, t, _, _ in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            q = words(x)
            for k in range(max(1, len(q) - 9) if q else 0):
                g = q[k : k + 10]
                for j in range(len(w) - len(g) + 1):
                    if w[j : j + len(g)] == g:
                        hit |= set(range(j, j + len(g)))
                        found.add(str(i))
        want.append((len(w), len(hit), sorted(found)))
    for limit in (decontamination.PART_CHARS, 300):
        out = decontamination.find_contamination(docs, bench, part_chars=limit)
        got = out.collect()
        assert out.columns == [*docs.columns, "contamination"]
        key = lambda x: sorted((a, b, tuple(c)) for a, b, c in x)
        assert key((r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) for r in got) == key(want)
        for r in got:
            assert sum(len(words(r.text[s.start : s.end])) for s in r.contamination.spans) == r.contamination.n_hit
    assert decontamination.find_contamination(none, bench).count() == 0
    assert decontamination.find_contamination(docs, bench.limit(0)).filter("contamination.n_hit > 0").count() == 0


def test_sharding(spark, docs, rows, none):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    assert sharding.shard(none).count() == 0
    assert sharding.shard(none.select("doc_id", "text")).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_sharding_is_even_and_in_order(spark):
    rng = random.Random(5)
    texts = [(i, rng.choice(["", "same", "z" * rng.choice([10, 300, 4000])]) + str(i % 900)) for i in range(6000)]
    docs = spark.createDataFrame(texts + [(None, None)] * 2000, "doc_id long, text string")
    got = sharding.shard(docs).collect()
    total = sum(r.size for r in got)
    sums, slots = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append((r.slot, r.text_crc32))
    assert set(sums) == set(range(16)) and all(abs(n - total / 16) <= 0.001 * total / 16 + 4100 for n in sums.values())
    crcs = [c for k in range(16) for _, c in sorted(slots[k])]
    assert crcs == sorted(crcs) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())


def test_cuts_against_prefix_sums(spark):
    rng = random.Random(6)
    rows = sorted((rng.choice([5, rng.randrange(2**63)]), i, rng.randrange(1, 50)) for i in range(500))
    table = spark.createDataFrame(rows, "key long, tie long, size long")
    config = sharding.ShardConfig(n_shards=4, tolerance=0.0, piece_tolerance=0.0, probe_bits=5)
    total, below, sums = sum(r[2] for r in rows), 0, []
    for r in rows:
        sums.append(below)
        below += r[2]
    for pieces in (1, 3):
        cuts = sharding.find_cuts(table, config, pieces)
        n = 4 * pieces
        for j, cut in enumerate(cuts, 1):
            at = sum(r[2] for r in rows if (r[0], r[1]) < cut)
            assert abs(at - j * total / n) == min(abs(s - j * total / n) for s in [*sums, total])
        piece = {r.tie: r.p for r in table.select("tie", sharding.piece_of(cuts, pieces, "key", "tie").alias("p")).collect()}
        assert all(piece[r[1]] == sum(c <= (r[0], r[1]) for c in cuts) for r in rows)


def test_sharding_splits_one_large_group(spark):
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = [r["n"] for r in sharding.shard(same).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.1 * sum(sizes) / 16


def test_write_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_suffix_dedup(spark, docs, rows, none):
    order = [(i, (t or "").encode()) for i, t, _, _ in rows]
    first = {}
    for i, b in order:
        if i is not None:
            for p in range(len(b) - 49):
                g = b[p : p + 50]
                first[g] = min(first.get(g, i), i)
    want = []
    for i, b in order:
        cover = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                cover[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        want.append((str(i), len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_digest(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.dedup_digest(none).count() == 0


def test_suffix_dedup_in_segments(spark, docs, rows, monkeypatch):
    """Segments of long texts, and keys whose mixes collide, change nothing."""
    want = sorted(map(str, suffix_dedup.dedup_digest(docs).collect()))
    table = suffix_dedup.pa.table({"text": [t for _, t, _, _ in rows if t and len(t) > 50]})
    windows = lambda: sorted(
        (int(r[k]), bytes(d[s + x : s + x + 50]))
        for d, o, r, _ in suffix_dedup._batches(table)
        for k, s, c in zip(*suffix_dedup.text_runs(d, o)[:3], strict=True)
        for x in range(c)
    )
    every = windows()
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 300)
    assert windows() == every
    texts = suffix_dedup.pa.table({"sha": ["a", "b"], "least": [1, 2], "text": ["abc " * 500, "q" + "abc " * 400]})
    assert all(len(d) <= 2 * 300 + 49 for d, _, _, _ in suffix_dedup._batches(texts))
    monkeypatch.setattr(suffix_dedup, "_mix_key", lambda a, d: a.astype(np.uint64) & np.uint64(1))
    runs = suffix_dedup._Runs(np.array([5, 7, 5, 9, 2]), np.array([1, 1, 2, 1, 0]))
    assert runs.find(np.array([5, 9, 8, 2, 5, 7]), np.array([2, 1, 1, 0, 3, 1])).tolist() == [2, 3, -1, 4, -1, 1]
    assert len(want) == len(rows)


def test_merged_intervals():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(0, 30))
        row, begin = rng.integers(0, 3, n), rng.integers(0, 40, n)
        end = begin + rng.integers(1, 8, n)
        cover = np.zeros((3, 60), dtype=bool)
        for r, a, b in zip(row, begin, end, strict=True):
            cover[r, a:b] = True
        want = []
        for r in range(3):
            turn = np.flatnonzero(np.diff(np.r_[0, cover[r].astype(int), 0]))
            want += [(r, a, b) for a, b in turn.reshape(-1, 2)]
        assert list(zip(*suffix_dedup._merged(row, begin, end), strict=True)) == want


def test_one_anchor_in_every_document(spark):
    """One gram that all windows of all texts have as their anchor."""
    rng = random.Random(15)
    grams = ["".join(rng.choice("abcdefgh") for _ in range(16)) for _ in range(400)]
    hashes = [int(suffix_dedup.text_runs(np.frombuffer((g * 4)[:50].encode(), np.uint8), np.array([0, 50]))[3][0]) for g in grams]
    hot = grams[int(np.argmin(hashes))]
    texts = [(i, "".join(rng.choice("xyz") for _ in range(34)) + hot + "".join(rng.choice("xyz") for _ in range(34))) for i in range(200)]
    texts += [(1000 + i, texts[i][1][5:75]) for i in range(50)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[1000 + i] == 70 for i in range(50)) and all(got[i] == 0 for i in range(200))


def asked_runs(texts):
    """(anchor, digest) of the runs of the texts, one document each, that are compared."""
    n = len(texts)
    table = suffix_dedup.pa.table({"chunk": np.zeros(n, dtype=np.int32), "least": np.arange(n), "text": texts})
    found = suffix_dedup._shared(suffix_dedup._entries(1)(table)).to_pylist()
    packed = [suffix_dedup._unpack(r["data"], (6, 6, 8))[0] for r in found if r["kind"] == 0]
    return {(int(a), int(h)) for p in packed for a, h in zip(p[0], p[1], strict=True)}


def test_runs_that_only_share_an_anchor_are_not_compared():
    rng = random.Random(17)
    grams = ["".join(rng.choice("abcdefgh") for _ in range(16)) for _ in range(400)]
    runs = lambda t, **more: suffix_dedup.text_runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), **more)
    hot = min(grams, key=lambda g: int(runs((g * 4)[:50])[3][0]))
    texts = ["".join(rng.choice("xyzuvw") for _ in range(34)) + hot + "".join(rng.choice("xyzuvw") for _ in range(34)) for _ in range(200)]
    assert asked_runs(texts) == set()


def test_every_shared_window_is_compared():
    """Random, periodic and mixed texts of few letters; grams that stand in a run often."""
    rng = random.Random(18)
    some = lambda k, letters="ab": "".join(rng.choice(letters) for _ in range(k))
    for _ in range(30):
        parts = [some(rng.randint(20, 90)) for _ in range(4)] + ["abc" * 30, "a" * 70, some(7) * 12]
        texts = list(dict.fromkeys("".join(rng.choice([rng.choice(parts), rng.choice(parts)[rng.randint(0, 9) :], some(rng.randint(0, 40))]) for _ in range(4)) + some(50) for _ in range(8)))
        asked, holders, of = asked_runs(texts), {}, {}
        for i, t in enumerate(texts):
            _, s, count, anchor, digest = suffix_dedup.text_runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
            for at, n, a, h in zip(s, count, anchor, digest, strict=True):
                for x in range(int(at), int(at + n)):
                    holders.setdefault(t[x : x + 50], set()).add(i)
                    of.setdefault(t[x : x + 50], set()).add((int(a), int(h)))
        for window, docs in holders.items():
            assert len(docs) < 2 or of[window] <= asked


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        s = np.r_[rng.integers(1, int(rng.integers(2, 5)), n), 0].astype(np.int16)
        length = int(rng.integers(1, 12))
        rows, interval = suffix_dedup.interval_expansion(s, length)
        text = bytes(s.astype(np.uint8))
        groups = {}
        for r, g in zip(rows.tolist(), interval.tolist(), strict=True):
            groups.setdefault(g, set()).add(text[r : r + length])
        assert sorted(rows.tolist()) == list(range(n + 1)) and all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def brute_simhash(text):
    w = WORD.findall((text or "").translate({b: b + 32 for b in range(65, 91)}))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, rows, none):
    prints = [brute_simhash(t) for _, t, _, _ in rows]
    roots = brute_roots(list(range(len(rows))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[roots[k]] = min(least.get(roots[k], r[0]), r[0])
    want = sorted((str(r[0]), prints[k], str(least.get(roots[k]))) for k, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_keeps_one_of_each_component(spark):
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(7)]
    prints = [brute_simhash(t) for t in texts]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k])
    ids = [None, None, None, 7, 7, 7, 8]
    rows = [*zip(ids, texts, strict=True), (None, texts[0]), (7, texts[3]), (9, texts[6])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, root string, n int")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(table).collect()]
    assert sorted(kept, key=str) == sorted(zip(ids, texts, strict=True), key=str)


def test_golay_keys_meet():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    v = u.copy()
    for _ in range(3):
        v ^= np.uint64(1) << rng.integers(0, 64, len(u), dtype=np.uint64)
    one, far = simhash._keys(u, False), simhash._keys(v, True)
    have = [set() for _ in u]
    for i, k in zip(*far, strict=True):
        have[i].add(k)
    met = np.zeros(len(u), dtype=bool)
    for i, k in zip(*one, strict=True):
        met[i] |= k in have[i]
    assert met.all()


def test_simhash_crowded_keys(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**40, 6, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(20):
            values.add(int(b) ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    values = sorted(values)
    want = {(a, b) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    monkeypatch.setattr(simhash, "CROWDED", 2)
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(nodes).collect()}
    assert got | {(b, a) for a, b in got} == want


def first_join(df):
    """The line of the outermost join in the plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if "Join" in line)


def test_simhash_keys_are_not_broadcast(spark, monkeypatch, tmp_path):
    """A file of fingerprints far below Spark's own threshold has 88 keys a row or so."""
    spark.range(1000).toDF("fp").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    monkeypatch.setattr(simhash, "CROWDED", 100)
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2  # of the keys that are crowded, and of the rest


def test_simhash_rows_are_not_broadcast(spark):
    """Copies make a small file of very many rows: only the components may be broadcast."""
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one text, many times").alias("text"))
    found = simhash.near_duplicates(table)
    assert "BuildLeft" not in first_join(found)
    assert found.groupBy("component_id").count().collect() == [(0, 20_000)]


def test_toxicity(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = prose(rng, 40) + (" you idiot, what a " + rng.choice(["moron", "loser", "clown"]) + " schurk" + rng.choice("abcdef") if bad else "")
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    tags = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, tags)
    got = toxicity.score(docs, model, "s").select("doc_id", toxicity.held_out().alias("h"), "s").collect()
    truth = dict(labels)
    held = [(r.s >= 0.5) == bool(truth[r.doc_id]) for r in got if r.h and r.doc_id in truth]
    assert len(got) == len(rows) and np.mean(held) >= 0.95 and all(0 <= r.s <= 1 for r in got)
    assert {r.s for r in got if r.doc_id >= 9000 for _ in [0]} == {next(r.s for r in got if r.doc_id == 9000)}
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    bare = toxicity.fit(docs, tags.limit(0))
    assert toxicity.score(docs, bare, "s").filter("s < 0.5").count() == len(rows)
    assert toxicity.score(none.drop("score"), model).count() == 0
    assert toxicity.score(docs.limit(3), model).columns == docs.columns  # the given name gives way
    odd = spark.createDataFrame([(None, "x"), (1, "word " * 300_000 + "you idiot")], "doc_id long, text string")
    assert [r.h for r in toxicity.score(odd, model, "s").select(toxicity.held_out().alias("h"), "s").collect()] == [False, zlib.crc32(b"1") % 5 == 0]


def _voted(n=3000, seed=1):
    """Votes of six voters: two good ones, one weak, one random, and a copy of the
    weak one; the sixth abstains."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    of = lambda hit, wrong: np.where(rng.random(n) < np.where(y, hit, wrong), 1, -1)
    weak = of(0.6, 0.35)
    return np.stack([of(0.8, 0.02), of(0.7, 0.05), weak, of(0.3, 0.3), weak, np.full(n, -1)], axis=1), y


def test_label_model_finds_rates_and_dependencies():
    cast, y = _voted()
    gold = y.astype(float)
    post, rates, parent, gain = toxicity.label_model(cast, gold)
    assert np.abs(rates[:4] - [[0.02, 0.8], [0.05, 0.7], [0.35, 0.6], [0.3, 0.3]]).max() < 0.1
    pairs = {frozenset((i, int(p))) for i, p in enumerate(parent) if p >= 0 and gain[i] > 0.1}
    assert pairs == {frozenset((2, 4))}
    # the copy adds nothing: posteriors are those without it
    alone = toxicity.label_model(cast[:, [0, 1, 2, 3, 5]], gold)[0]
    assert np.abs(post - alone).max() < 0.05
    # brute force: posteriors of the true rates
    p = np.log(0.3 / 0.7)
    for k, (hit, wrong) in enumerate(((0.8, 0.02), (0.7, 0.05), (0.6, 0.35))):
        p = p + np.where(cast[:, k] == 1, np.log(hit / wrong), np.log((1 - hit) / (1 - wrong)))
    assert np.abs(post - 1 / (1 + np.exp(-p))).mean() < 0.05
    # wrong labels of a tenth of the rows are overruled by the votes
    flipped = np.where(np.random.default_rng(2).random(len(y)) < 0.1, 1 - gold, gold)
    again = toxicity.label_model(cast, flipped)[0]
    assert ((again >= 0.5) == (post >= 0.5)).mean() > 0.97


def test_toxicity_weighs_its_voters(spark):
    """A word that clean rows hold too, now and then, is no proof: the label
    model tells a row full of it from a long one that has it once."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        words = prose(rng, rng.choice([60, 400])).split()
        if bad:
            words[:: 50] = ["schurk" + rng.choice("abc") for _ in words[::50]]
        elif i % 8 == 1:
            words[rng.randrange(len(words))] = "schurka"
        rows.append((i, " ".join(words), int(bad), len(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, n int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    got = toxicity.score(docs, model).filter(toxicity.held_out()).collect()
    assert any(t.startswith("schurk") for t in model.terms)
    long_clean = [r.score for r in got if not r.toxic and r.n > 300 and "schurk" in r.text]
    assert long_clean and max(long_clean) < 0.5 and np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got if r.n > 300]) > 0.97


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(150):
        v = centres[i % 12] + rng.normal(scale=0.12, size=8)
        rows.append((i, v.tolist(), i % 2))
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [1.0, None] + [0.0] * 6, 0), (303, [float("nan")] * 8, 1), (304, rows[0][1], None), (305, [1.0, 2.0], 0), (306, [float("inf")] * 8, 1), (307, [1e200] * 8, 1), (308, [1e-200] * 8, 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, cell string, n string")
    fine = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]

    def cosine(a, b):
        if len(a) != len(b):
            return -1
        a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))

    linked = {(a[0], b[0]) for a in fine for b in fine if a[0] != b[0] and a[2] == b[2] and cosine(a[1], b[1]) >= 0.93}
    root = brute_roots([r[0] for r in rows], lambda a, b: (a, b) in linked)
    want = sorted((r[0], sum((r[0], o[0]) in linked for o in rows), root[r[0]], root[r[0]] == r[0]) for r in rows)
    for cell, pivots in ((8192, 512), (20, 512), (6, 2)):
        monkeypatch.setattr(embedding_dedup, "MAX_PIVOTS", pivots)
        got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(table, cell=cell).collect())
        assert got == want
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_at_a_lower_threshold(spark):
    x = np.random.default_rng(11).normal(size=(90, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(enumerate(((unit @ unit.T >= 0.3).sum(axis=1) - 1).tolist()))
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for cell in (8192, 4):
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table, 0.3, cell).collect()}
        assert got == want


def test_chat(spark):
    talk = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a"], 4: ["a", "b", "c"], 5: ["x"], 6: ["x", None], 7: [None], 8: [""], 9: list("abcd") * 200}
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t) for c, ts in talk.items() for k, t in enumerate(ts)]
    rows += [(None, 0, "user", "lost"), (10, None, None, "n"), (10, 3, "user", "m")]
    turns = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, k int, order string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.format_chats(turns).collect()}
    assert set(got) == {2, 6, 7, 8, 9, 10} - {2} | set() and got[9][0] == 800
    assert got[10][2] == "<|im_start|>\nn<|im_end|>\n<|im_start|>user\nm<|im_end|>\n"
    assert got[6][:2] == (2, 1)
    assert chat.format_chats(turns.limit(0)).count() == 0
    short = turns.filter("conv_id <> 9")
    assert {r.conv_id: r.n_copies for r in chat.format_chats(short).collect()} == {2: 2, 6: 1, 7: 1, 8: 1, 10: 1}


def test_secrets(spark, docs):
    text = 'x token: secret: hunter22x; API_KEY="abc12345" AKIAABCDEFGHIJKL 0123456789abcdef0123456789abcdef passphrase is xK9#mQ2$vL7p! pwd=password123'
    got = secrets.spans_of(text)
    assert [(k, text[a:b]) for k, a, b in got] == [
        ("assign", "token: secret:"[:0] + text[got[0][1] : got[0][2]]), ("access", "AKIAABCDEFGHIJKL"),
        ("hex", "0123456789abcdef0123456789abcdef"), ("guess", "xK9#mQ2$vL7p"),
    ]
    assert got[0][0] == "assign" and "abc12345" in text[got[0][1] : got[0][2]]
    assert secrets.spans_of(None) == [] and secrets.spans_of("") == []
    assert secrets.guess_bits("password1234") < 20 < 60 < secrets.guess_bits("xK9#mQ2$vL7p")
    assert secrets.guess_bits("a1B" * 30) < secrets.guess_bits("a1B2c3D4e5F6")
    many = "token=abcdefgh1 pwd=" + "pwd=x1 " * 3 + " ".join(f"password=abcdefg{i} passphrase is kqzv{i}xwpjhgtrmnb" for i in range(20_000))
    began = time.process_time()
    assert len(secrets.spans_of(many)) > 40_000 and time.process_time() - began < 20
    assert secrets.spans_of("pwd=İİİİİİİİİİİİ") is not None
    out = secrets.find_secrets(docs)
    assert out.columns == [*docs.columns, "secrets"] and out.filter("secrets is null").count() == 0


_LETTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def _run(text, i, allowed):
    j = i
    while j < len(text) and text[j] in allowed:
        j += 1
    return j


def plain_scan(text):
    """Base spans of a text, letter by letter."""
    out, i = [], 0
    while i < len(text):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[i : i + len(n)].lower() == n and text[i : i + len(n)].isascii()), None)
        if name:
            j = i + len(name)
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            j = _run(text, j, " ")
            if text[j : j + 1] in (":", "=") and j < len(text):
                j = _run(text, j + 1, " ")
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                end = _run(text, j, _LETTERS)
                if end > j:
                    if end - j >= 8:
                        out.append(("assign", i, end))
                    i = end
                    continue
        i += 1
    for kind, first, allowed, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), ("hex", "", set("0123456789abcdef"), 32)):
        i = 0
        while i < len(text):
            end = _run(text, i + len(first), allowed) if text.startswith(first, i) else i
            if end > i + len(first) or (end > i and not first):
                if end - i >= least:
                    out.append((kind, i, end))
                i = end
            else:
                i += 1
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_against_plain_patterns():
    """Base spans of random texts against a scan letter by letter."""
    rng = random.Random(12)
    bits = ["password", "PassWD", "secret", "token", "apikey", "API_KEY", '"', "'", " ", "  ", ":", "=", "AKIA", "abc123", "ABCDEFGHIJKL12", "deadbeef" * 4, "0a" * 17, "é", "\n", "zz"]

    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        got = [s for s in secrets.spans_of(text) if s[0] != "guess"]
        assert got == plain_scan(text), text


def test_corpus_words_decide(spark):
    """With the words of the corpus prose after a credential name is cheap, while
    a secret that many copies hold stays dear."""
    rng = random.Random(13)
    names = ["information", "extraordinary", "correspondence", "unbelievable"]
    texts = [f"{prose(rng, 5)} w{chr(97 + i % 26)}{chr(97 + i // 26)}rd {rng.choice(names)} of things" for i in range(400)]
    texts += ["the secret correspondence and pwd=kqzvxwpjhgtrmnbdlf in copies"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = secrets.corpus_words(docs)
    assert set(names) <= set(words) and "kqzvxwpjhgtrmnbdlf" not in words
    one = docs.filter("doc_id = 400")
    spans = lambda w: [(s.kind, texts[400][s.start : s.end]) for s in secrets.find_secrets(one, w).first().secrets]
    assert spans(None) == [("guess", "correspondence"), ("guess", "kqzvxwpjhgtrmnbdlf")]
    assert spans(words) == [("guess", "kqzvxwpjhgtrmnbdlf")]
    assert secrets.corpus_words(docs.limit(0)) == {}


@pytest.mark.parametrize(
    "text",
    [
        "Authorization: Bearer {}", "pwd={}", "postgres://u:{}@host/db", "AWS_SECRET_ACCESS_KEY={}", "DJANGO_SECRET_KEY = '{}'",
        "STRIPE_LIVE_SECRET_KEY: {}", "_x-api-secret={}", "my__token={}", "app-token={}",
    ],
)
def test_secrets_by_cost_alone(text):
    value = "qzvhxkwrjtgpbmyfdncsulea"
    full = text.format(value)
    found = {full[a:b] for _, a, b in secrets.spans_of(full)}
    assert any(value in x for x in found)
    assert not any("password" in full[a:b] for full in [text.format("password")] for k, a, b in secrets.spans_of(full) if k == "guess")


@pytest.mark.parametrize("unit", ["abcdefghijklmnop", "0123456789abcdef", "a.b.c", "a://b:cccccccc", "pass_", "+-.", "://"])
def test_secrets_of_very_long_runs(unit):
    text = "key " + unit * (1_000_000 // len(unit))
    start = time.time()
    secrets.spans_of(text)
    assert time.time() - start < 2


def test_secrets_value_of_a_million_characters():
    start = time.time()
    found = secrets.spans_of("password=" + "qzvhxk" * 160_000)
    assert [k for k, *_ in found] == ["assign"] and time.time() - start < 30


def test_secrets_in_addresses():
    """The scheme needs a letter, and is looked for backwards."""
    value = "qzvhxkwrjtgpbmyfdncsulea"
    for head, hit in (("https", True), ("a+b.c-9", True), ("9", False), ("+.", False), ("A", False), ("", False)):
        full = f"auth {head}://user:{value}@host"
        assert any(full[a:b] == value for k, a, b in secrets.spans_of(full) if k == "guess") is hit


def test_secrets_long_names():
    start = time.time()
    assert not list(secrets.CONTEXT.finditer("a-" * 100_000 + "b " + "a_" * 100_000))
    assert time.time() - start < 5


@pytest.mark.parametrize(
    "head",
    [
        "<head><title>t</title><body>", "<head><meta charset=x><title>t</title>", "<head><noscript><p>no</p></noscript><link><body class=x>",
        "<head><head><style>p{}</style><body>", "<head><noscript><div><body>", "<head><template><p>no</p></template></head><body>",
    ],
)
def test_html_head_without_end(head):
    article = "<article><h1>Title</h1><p>A first line of the article, which ends here.</p></article>"
    assert html_extract.main_text(f"<html>{head}{article}") == "Title\nA first line of the article, which ends here."


def test_html_head_ended_by_text():
    assert [b.text for b in html_extract.read_page("<head><title>t</title> Plain text.<p>More.")[0]] == ["Plain text.", "More."]


def test_html_math():
    page = (
        "<article><p>The sum <math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow>"
        '<annotation encoding="application/x-tex">x + 1</annotation></semantics></math> is positive here.</p></article>'
    )
    assert html_extract.main_text(page) == "The sum x+1 is positive here."


def test_html(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a></header><nav><ul><li>Home<li>News</ul></nav>'
        '<article><h1>Head &amp; line</h1><p>First   para\n with <b>bold</b> &eacute;.<p>Second one, which is somewhat longer than the first.'
        '<div class="ad-box">Buy this thing now.</div><form><label>Mail</label><input></form><p>Third.</p></article>'
        '<aside><p>Related things you may like to read.</p></aside><section id="comments"><p>I like this article very much, thank you.</p></section>'
        '<script>var t="</p>";</script><footer>&copy; me</footer></body></html>'
    )
    want = "Head & line\nFirst para with bold é.\nSecond one, which is somewhat longer than the first.\nThird."
    assert html_extract.main_text(page) == want
    assert html_extract.main_text(None) == "" and html_extract.main_text("") == "" and html_extract.main_text("<p>") == ""
    rows = [(1, page, "t"), (2, None, "t"), (3, "", "t"), (3, "<" * 5000, "t"), (4, '<article><p>' + "word " * 50_000 + "</article>", "t")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, html string, text string").drop("text")).collect()
    assert [r.text for r in got][:3] == [want, "", ""] and len(got[4].text) == 250_000 - 1


def test_long_page():
    lines = "".join(f"<p>{'A longer line of some text here. ' * 8}{i}</p>" if i % 3 == 0 else f"<div><a href=x>menu {i}</a></div>" for i in range(40_000))
    began = time.process_time()
    text = html_extract.main_text(f"<html><body>{lines}</body></html>")
    assert text.count("\n") >= 13_000 and time.process_time() - began < 30


PROSE = "<p>The first paragraph of the article is long enough to count as prose, with several words and a stop at the end. It goes on.</p>"
ARTICLE = f"<h1>Title</h1>{PROSE}<p>Short.</p>{PROSE}<p>tiny line</p>{PROSE}"
AROUND = "<nav><ul><li><a href=/>Home</a></li></ul></nav>{}<div class='sidebar'><ul><li><a href=x>One</a></li></ul></div><div class='comments'>" + (
    f"<div class='comment'>{PROSE}</div>" * 8
) + "</div><footer><p>Copyright me. All rights reserved, and more words in a line so long that it looks like prose. Really.</p></footer>"


@pytest.mark.parametrize("outer", [
    "div class='layout has-sidebar'", "div class='site with-header'", "div class='page no-sidebar'", "div class='tag-list post'",
    "div class='comments-enabled'", "div id='side-content-main'", "form id='aspnetForm'", "div class='sidebar'",
])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_html_wrappers(outer, inner):
    want = [re.sub("<[^>]*>", "", x) for x in re.findall("<(?:h1|p)>.*?</(?:h1|p)>", ARTICLE)]
    page = f"<body><{outer}>{AROUND.format(f'<{inner}>{ARTICLE}</{inner}>')}</{outer.split()[0]}></body>"
    assert html_extract.main_text(page).split("\n") == want


def test_html_ties_decide():
    """Without the ties short lines are lost and long comments kept."""
    page = f"<body>{AROUND.format(f'<article>{ARTICLE}</article>')}</body>"
    blocks, elements = html_extract.read_page(page)
    alone = [b.text for b in blocks if html_extract.block_bits(b) >= 0]
    cut = html_extract.main_text(page).split("\n")
    assert "tiny line" in cut and "tiny line" not in alone and len([x for x in alone if x.startswith("The first")]) == 11
    bare = f"<body><div><a href=x>Home</a> <a href=x>About</a></div><div>{ARTICLE}</div><div><ul><li><a href=x>One</a><li><a href=x>Two</a></ul></div></body>"
    assert html_extract.main_text(bare).split("\n") == cut


def test_html_inside_the_article():
    page = "<article><p>Press <button>Go</button> now.</p><address>12 Long Street</address><p>A <svg><text>chart</text></svg> here.</p><div class=ad>Buy.</div></article>"
    assert html_extract.main_text(page) == "Press Go now.\n12 Long Street\nA chart here."
    assert html_extract.main_text(f"<div id=content>{ARTICLE}</div><section id=comments><article class=comment>{PROSE}</article></section>").count("\n") == 5


@pytest.mark.parametrize("page", [
    "<div>x " * 140_000, '<b x="y ' * 120_000, '<a "' * 250_000, "<a \"'>" * 150_000, "<i>" * 150_000 + "</b>" * 150_000, "<b><div>" + "<i>" * 150_000 + "</b>" * 150_000,
    "<li>x" * 150_000, "< " * 500_000, "</x " * 250_000, "<!-- " * 200_000, "<script>" * 120_000, ("<div>" + PROSE) * 6_500, "<article>" + "<div>x " * 140_000,
    ("<div>" + PROSE + "<div><a href=x>link</a>") * 6_000, "<h1>" * 200_000 + "x", "<div class=ad>x" * 60_000,
], ids=lambda p: p[:14])
def test_html_reads_in_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 8


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(label):
            own = sum(max(0, -s) if on else max(0, s) for s, on in zip(scores, label, strict=True))  # noqa: B023
            return own + sum(w for i, j, w in ties if label[i] != label[j])  # noqa: B023

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(html_extract.minimum_cut(scores, ties)) - best) < 1e-6
