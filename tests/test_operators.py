"""Single operators on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from folioscan.config import ChunkConfig, Constraints, EntryType, TermAssets
from folioscan.functions import text as T
from folioscan.operators import answer, blocks, chunks, entries, evaluate, evidence, normalize, panels, retrieve, sections

SPAN = "file string, span_no int, text string, font_size int, bold boolean"
BLOCK = (
    "file string, block_no int, block_type string, text string, font_size int, starts_with_bold boolean"
)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("", "empty"), ("a | b", "table_row"), ("1. first", "list_item"), ("- dash", "list_item"),
        ("Combat Rules", "heading_candidate"), ("a small thing", "paragraph"), ("The End.", "paragraph"), ("Ab", "paragraph"),
    ],
)
def test_block_type(spark, line, kind):
    assert value(spark, T.block_type(F.lit(line))) == kind


def test_phrase_boundaries(spark):
    has = lambda h, p: value(spark, T.has_phrase(F.lit(h), F.lit(p)))
    assert has("the été there", "été") and not has("l'étés", "été") and not has("abc", "") and has("a+b c", "a+b")


def test_blocks(spark):
    spans = [("f", 0, "Title", 28, False), ("f", 1, "\n\nbold ", 24, True), ("f", 2, "plain text here\nlast", 24, False)]
    got = blocks.build_blocks(spark.createDataFrame(spans, SPAN)).orderBy("block_no").collect()
    assert [(r.block_id, r.text, r.line_no, r.font_size, r.font_size_class, r.starts_with_bold, r.all_bold) for r in got] == [
        ("b0001", "Title", 0, 28, "body", False, False),
        ("b0002", "bold plain text here", 2, 24, "smaller", True, False),
        ("b0003", "last", 3, 24, "smaller", False, False),
    ]


def statblock(spark):
    rows = [
        ("f", 0, "paragraph", "Fire Ball", 28, False), ("f", 1, "paragraph", "Evocation", 24, False),
        ("f", 2, "paragraph", "Level: 3", 24, True), ("f", 3, "paragraph", "Range: far", 24, True),
        ("f", 4, "paragraph", "It burns.", 24, False), ("f", 5, "heading_candidate", "Next Part", 28, False),
        ("f", 6, "paragraph", "Tail.", 24, False),
    ]
    return spark.createDataFrame(rows, BLOCK)


def test_statblock(spark):
    kind = EntryType("spell", "Spells", "spell_entry", "entry_with_statblock")
    made = statblock(spark)
    found = entries.find_matches(made, [kind])
    assert [(r.start, r.fields_end, r.end) for r in found.collect()] == [(0, 4, 5)]
    roles = [r.entry_role for r in entries.annotate(made, found).orderBy("block_no").collect()]
    assert roles == ["title", "subtitle", "stat_field", "stat_field", "description", None, None]
    with pytest.raises(ValueError):
        entries.find_matches(made, [EntryType("x", "X", "x", "other")])


def test_definitions_need_a_run(spark):
    rows = [("f", i, "paragraph", f"Term {'ABCDE'[i]}: text", 24, i != 3) for i in range(5)]
    kind = EntryType("c", "C", "condition_entry", "definition_list", min_blocks=3)
    found = entries.definitions(spark.createDataFrame(rows, BLOCK), kind)
    assert sorted(r.entry_title for r in found.collect()) == ["Term A", "Term B", "Term C"]


def test_sections_and_boundary(spark):
    made = statblock(spark).withColumns({"file_stem": F.lit("Long Stem"), "entry_index": F.lit(None).cast("int"), "entry_title": F.lit(None).cast("string"), "entry_category": F.lit(None).cast("string"), "entry_chunk_type": F.lit(None).cast("string"), "entry_role": F.lit(None).cast("string")})
    got = sections.split_sections(made).orderBy("section_no").collect()
    assert [(r.section_title, r.block_start_index, r.block_end_index) for r in got] == [("Long Stem", 0, 6)]
    decided = sections.boundary_decisions(sections.split_sections(made).withColumn("file_stem", F.lit("Long Stem")))
    assert decided.first().reason_code == "accepted_clean"


def test_slices_keep_sentences():
    text = "one two. " * 10
    got = chunks.slice_text(text, 20)
    assert all(len(s) <= 20 for s in got) and "".join(s.replace(" ", "") for s in got) == text.replace(" ", "")
    assert chunks.slice_text("a\n\nb" + "c" * 30, 10)[0] == "a" and chunks.slice_text("", 5) == []
    assert chunks.slice_text(None, 5) == []


def test_packing(spark):
    got = value(spark, chunks.pack_paragraphs(F.lit("aaaa\n\nbbbb\n\n \n\ncccc"), 8))
    assert got == ["aaaa\n\nbbbb", "cccc"] and value(spark, chunks.pack_paragraphs(F.lit(""), 8)) == []


def test_chunk_types(spark):
    kind = lambda path, text="x": value(spark, chunks.chunk_type(F.array(*map(F.lit, path)), F.lit(text)))
    assert kind(["A"]) == "rule_section" and kind(["A b", "a-B"]) == "rule_section" and kind(["A", "B"]) == "subsection"
    assert kind(["A", "OGL text"]) == "generic" and kind(["A", "Illegal"]) == "subsection"
    assert kind(["A", "B"], "Open Game License. ok") == "generic"


def test_config_values():
    assert ChunkConfig.of({"child_threshold_chars": 5, "other": 1}).threshold == 5
    for bad in (0, -1, True, "3"):
        with pytest.raises(ValueError):
            ChunkConfig(threshold=bad)


def test_normalize(spark):
    assets = TermAssets({"hp": "hit points", "points": "score"}, ("hit score", "saving throw"))
    rows = spark.createDataFrame([(1, "  What HP for a Saving Throw? "), (2, "")], "query_id int, raw_query string")
    one, two = normalize.normalize(rows, assets).orderBy("query_id").collect()
    assert one.normalized_text == "what hit score for a saving throw" and one.aliases_applied == ["hp", "points"]
    assert one.tokens == ["what", "hit score", "for", "a", "saving throw"] and one.query_mode == "natural_language"
    assert one.applied_rules == ["trim_whitespace", "case_fold", "punctuation_cleanup", "whitespace_normalization", "alias_expansion"]
    assert two.tokens == [] and two.query_mode == "keyword_lookup"


def test_rejections(spark):
    limits = Constraints.of([{"edition": "a", "source_type": "b", "authority_level": "c"}, {"edition": "z", "status": "planned_later"}], ("s9",))
    rows = [("a", "b", "c", "s1"), ("z", "b", "c", "s1"), ("a", None, "c", "s1"), ("a", "b", "c", "s9")]
    got = spark.createDataFrame(rows, "edition string, source_type string, authority_level string, source_id string")
    assert [r[0] for r in got.select(retrieve.rejection(limits)).collect()] == [
        None, "edition 'z' not in ['a']", "source_type '' not in ['b']", "source_id 's9' is explicitly excluded",
    ]


def test_phrase_frequencies(spark):
    rows = [(t, "c1", 0, i) for i, t in enumerate("x x x y".split())] + [("x", "c1", 1, 0), ("y", "c2", 0, 0)]
    places = spark.createDataFrame(rows, "term string, chunk_id string, col int, pos int")
    wanted = spark.createDataFrame([(["x", "x"],), (["x", "y"],), (["y"],), (["q", "x"],)], "words array<string>")
    got = {(r.phrase, r.chunk_id): r.f for r in retrieve.phrase_frequencies(wanted, places).collect()}
    assert got == {("x x", "c1"): 2, ("x y", "c1"): 1, ("y", "c1"): 1, ("y", "c2"): 1}


CAND = "query_id int, rank int, document_id string, section_path array<string>, chunk_id string, child_no int, previous_chunk_id string, next_chunk_id string"


def test_spans_need_mutual_links(spark):
    rows = [
        (1, 3, "d", ["r", "s"], "c1", 1, None, "c2"), (1, 1, "d", ["r", "s"], "c2", 2, "c1", "c3"),
        (1, 2, "d", ["r", "s"], "c3", 3, "c9", None), (1, 4, "d", ["r", "t"], "c4", 4, "c3", None),
    ]
    got = evidence.spans(evidence.groups(spark.createDataFrame(rows, CAND))).orderBy("rank").collect()
    assert [(r.chunk_id, r.chunk_ids, r.merge_reason) for r in got] == [
        ("c2", ["c1", "c2"], "adjacent_span"), ("c3", ["c3"], "singleton"), ("c4", ["c4"], "singleton"),
    ]


def test_spans_follow_links_and_survive_cycles(spark):
    path = ["r", "s"]
    rows = [  # a chain against the reading order, two cycles, a chunk linked with itself, a cycle with a branch
        (1, 1, "d", path, "c9", 1, "c8", None), (1, 2, "d", path, "c7", 3, None, "c8"), (1, 3, "d", path, "c8", 2, "c7", "c9"),
        (2, 1, "d", path, "a", 1, "b", "b"), (2, 2, "d", path, "b", 2, "a", "a"), (2, 3, "d", path, "e", 3, "e", "e"),
        (2, 4, "d", path, "f", 4, "b", None), (3, 1, "d", path, "x", 1, "z", "y"), (3, 2, "d", path, "y", 2, "x", "z"),
        (3, 3, "d", path, "z", 3, "y", "x"), (3, 4, "d", path, "o", 4, None, "p"), (3, 5, "d", path, "p", 5, "o", None),
    ]
    got = evidence.spans(evidence.groups(spark.createDataFrame(rows, CAND))).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.chunk_id, r.chunk_ids, r.merge_reason) for r in got] == [
        (1, 1, "c9", ["c7", "c8", "c9"], "adjacent_span"),
        *[(2, k, c, [c], "singleton") for k, c in enumerate("abef", 1)],
        *[(3, k, c, [c], "singleton") for k, c in enumerate("xyz", 1)],
        (3, 4, "o", ["o", "p"], "adjacent_span"),
    ]


def test_answer_slots(spark):
    schema = "query_id int, rank int, document_id string, section_root string, chunk_id string, content string, exact_phrase_hits array<string>, protected_phrase_hits array<string>, section_path_hit boolean, section_path array<string>, source_id string, edition string"
    rows = [
        (1, 1, "d", "r", "a", "x" * 600, [], ["p"], False, ["r"], "s", "e"), (1, 2, "d", "r", "b", "sib", [], [], False, ["r"], "s", "e"),
        (1, 3, "e", "r", "c", "sub", [], ["p"], False, ["r"], "s", "e"), (1, 4, "e", "r", "d", "new", [], ["q"], False, ["r"], "s", "e"),
        (2, 1, "d", "r", "a", "weak", [], [], False, ["r"], "s", "e"),
    ]
    items = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "query_id int, raw_query string")
    decided = answer.support(queries, items)
    assert {r.query_id: r.trigger_code for r in decided.collect()} == {1: None, 2: "weak_signals", 3: "empty_evidence"}
    segments = answer.compose(items, decided).orderBy("segment_id").collect()
    assert [(r.role, r.chunk_id, r.support_type) for r in segments] == [
        ("primary", "a", "direct_support"), ("sibling", "b", "supported_inference"), ("cross-section", "d", "direct_support"),
    ]
    assert segments[0].text == "x" * 500 + "…"
    slots = {r.slot: (r.outcome, r.n_rejected) for r in answer.slot_decisions(items, decided).collect()}
    assert slots == {"primary": ("filled", 0), "sibling": ("filled", 0), "cross-section": ("filled", 2)}


def test_eval_matching(spark):
    path = F.array(F.lit("Combat: basics"), F.lit("Trip"))
    assert value(spark, evaluate.section_matches(path, F.lit("combat: advanced")))
    assert not value(spark, evaluate.section_matches(path, F.lit("magic")))
    head = lambda *p: value(spark, evaluate.expected_head(F.array(*map(F.lit, p))))
    assert head("Feats.rtf", "Power Attack") == "power attack" and head("Two Words") == "two words"


def test_panels(spark):
    none = "cast(array() as array<string>)"
    row = spark.sql(f"select array('a b', 'c') as exact_phrase_hits, {none} as protected_phrase_hits, true as section_path_hit, 2L as token_overlap_count")
    assert row.select(panels.signal_text()).first()[0] == "exact=['a b', 'c']; section_path_hit; token_overlap=2"
    bare = spark.sql(f"select {none} as exact_phrase_hits, {none} as protected_phrase_hits, false as section_path_hit, 0L as token_overlap_count")
    assert bare.select(panels.signal_text()).first()[0] == "(none)"


def test_history(spark):
    asked = spark.createDataFrame([(s, t, f"q{t}") for s in (1, 2) for t in range(30 if s == 1 else 3)], "session int, ran_at int, query string")
    got = panels.history(asked).collect()
    assert sorted(r.ran_at for r in got if r.session == 1) == list(range(10, 30)) and sum(r.session == 2 for r in got) == 3
    assert all(r.entry_no == 1 for r in got if r.ran_at == 29)


def test_preview(spark):
    schema = "chunk_id string, chunk_type string, section_path array<string>, previous_chunk_id string, next_chunk_id string, content string"
    made = spark.createDataFrame([("c1", "generic", ["a", "b"], None, "c2", "1\n2\n3\n4\n5"), ("c2", "generic", None, "c1", None, None)], schema)
    text = panels.preview(made)
    assert "| `generic` | 2 |" in text and "- path: a > b" in text and "4\n...\n" in text and "5" not in text
    assert panels.preview(made.limit(0)) == "No chunks.\n"


SECTION = (
    "file string, file_name string, file_stem string, section_no int, section_title string, section_slug string, content string, "
    "body_char_count int, block_start_index int, block_end_index int, title_starts_with_bold boolean, n_table_row int, n_paragraph int, entry_index int"
)


def section_rows(spark, name, *rows):
    """rows: (title, content, is_entry)."""
    made = [
        (name, name, name.split(".")[0], i + 1, t, t.lower(), c, len(c), i, i, False, 0, 1, i if e else None)
        for i, (t, c, e) in enumerate(rows)
    ]
    return spark.createDataFrame(made, SECTION)


LONG = "A line of text that is long enough for a section of its own, with a stop."


def log_of(spark, name, *rows):
    from folioscan.config import BoundaryConfig

    decided = sections.boundary_decisions(section_rows(spark, name, *rows), BoundaryConfig(boilerplate=("license",)))
    log = sorted((r.section_no, r.action, r.reason_code, r.body_char_count) for r in sections.decision_log(decided).collect())
    return log, decided


def test_legal_files_pass(spark):
    log, _ = log_of(spark, "Legal.rtf", ("Open", "license", False), ("And", "x", False))
    assert log == [(1, "accepted", "legal_source_passthrough", 7), (2, "accepted", "legal_source_passthrough", 1)]
    log, _ = log_of(spark, "Other.rtf", ("Opening", "license", False), ("Whole Thing", LONG, False))
    assert [x[1:3] for x in log] == [("merged_forward", "boilerplate_opener_stub"), ("accepted", "accepted_clean")]


def test_heads_before_entries_stand_alone(spark):
    log, decided = log_of(spark, "a.rtf", ("Opening", "license", False), ("And", "short", False), ("Fire", LONG, True))
    assert log == [
        (1, "merged_forward", "boilerplate_opener_stub", 7), (2, "merged_forward", "suspicious_short_or_truncated", 5),
        (3, "accepted", "entry_annotated", len(LONG)), (3, "accepted", "forward_bucket_promoted_before_entry", 14),
    ]
    log, _ = log_of(spark, "b.rtf", ("Opening", "license", False), ("And", "short", False))
    assert log[-1] == (3, "accepted", "forward_bucket_promoted_fallback", 14)
    log, _ = log_of(spark, "c.rtf", ("Opening", "license", False))
    assert log == [(1, "dropped", "boilerplate_opener_stub", 7)]


def test_slices_by_rule():
    import random

    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", "c. ", "\n", "\n\n", "dd", ". "]) for _ in range(rng.randrange(0, 60)))
        limit = rng.randrange(2, 20)
        pieces = chunks.slice_text(text, limit)
        flat = lambda s: s.replace("\n", "").replace(" ", "")
        assert flat("".join(pieces)) == flat(text) and all(len(p) <= limit for p in pieces) and "" not in pieces
        at = 0
        for p in pieces[:-1]:
            at = text.index(p, at)
            end, window = at + len(p), text[at : at + limit]
            if "\n\n" in window.lstrip("\n") and window.find("\n\n", 1) > 0:
                assert text[end : end + 1] == "\n"  # a blank line comes before every other mark
            elif len(p) == limit and text[end - 1] != ".":
                assert "\n" not in window[1:] and ". " not in window[1:]
            at = end
    assert chunks.slice_text("One. Two three. Four", 12) == ["One.", "Two three.", "Four"]
    assert chunks.slice_text("one\ntwo. three four", 10) == ["one\ntwo.", "three four"]
    assert chunks.slice_text("abcdefgh", 3) == ["abc", "def", "gh"] and chunks.slice_text("x\n", 9) == ["x\n"] and chunks.slice_text(None, 3) == []


def test_marks_in_phrases_and_targets(spark):
    terms = normalize.Vocabulary.of(spark, TermAssets({"a+b": r"c$1 \d", r"x\ey": "plain"}, (r"p\eq", "r*s")))
    texts = spark.createDataFrame([(1, r"see a+b and x\ey or p\eq or r*s"), (2, "ba+b a+bc"), (3, None)], "i int, t string")
    got = {r.i: (r.t, r.aliases_applied) for r in normalize.with_aliases(texts, "t", "i", terms.aliases).collect()}
    assert got == {1: (r"see c$1 \d and plain or p\eq or r*s", ["a+b", r"x\ey"]), 2: ("ba+b a+bc", []), 3: (None, [])}
    found = normalize.found_in(texts, "t", ["i"], terms.phrases).collect()
    assert sorted((r.i, r.phrase) for r in found) == [(1, r"p\eq"), (1, "r*s")]
    assert value(spark, T.has_phrase(F.lit(r"a p\Eq b"), F.lit(r"p\Eq"))) is True


def test_aliases_in_their_order(spark):
    """What an alias puts in a later one may match, an earlier one not; neighbours
    both change."""
    assets = TermAssets({"b": "c", "a": "b", "c d": "e", "b b": "x"})
    rows = [(1, "a"), (2, "b d"), (3, "a a"), (4, "b b b"), (5, "ab"), (6, ""), (6, "a")]
    got = normalize.normalize(spark.createDataFrame(rows, "query_id int, raw_query string"), assets)
    assert sorted((r.query_id, r.normalized_text, tuple(r.aliases_applied)) for r in got.collect()) == [
        (1, "b", ("a",)), (2, "e", ("b", "c d")), (3, "x", ("a", "b b")), (4, "c c c", ("b",)), (5, "ab", ()), (6, "", ()), (6, "b", ("a",)),
    ]


def test_variants_and_overlapping_phrases(spark):
    assets = TermAssets({}, ("armor class", "touch armor class", "class feature"), ("saving throws", "flat-footed"))
    rows = [(1, "Touch armor class feature; saving throws, flat-footed"), (2, "class armor"), (3, "armor class armor class")]
    got = {r.query_id: r for r in normalize.normalize(spark.createDataFrame(rows, "query_id int, raw_query string"), assets).collect()}
    assert got[1].protected_phrases == ["touch armor class", "armor class", "class feature", "saving throws"]
    assert got[1].tokens == ["touch armor class", "feature", "saving throws", "flat", "footed"]
    assert got[2].tokens == ["class", "armor"] and got[3].tokens == ["armor class", "armor class"] and got[3].protected_phrases == ["armor class"]


def test_case_folding(spark):
    words = ["STRASSE Straße", "ſtraſe ς Σ", "ﬁne ŉ", "İ ẞ", "ΐ", "plain"]
    for w in words:
        assert value(spark, T.casefold(F.lit(w))) == w.casefold(), w


def test_large_vocabulary(spark):
    """100,000 phrases and as many aliases as tables."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    phrases = sorted({" ".join(rng.choices(words, k=rng.choice([2, 3, 4]))) for _ in range(100_000)})
    aliases = [(i, f"q{i}", f"w{i % 3000} w{i % 7}") for i in range(100_000)]
    known = normalize.Vocabulary(
        spark.createDataFrame(aliases, "ord long, source string, target string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    )
    rows = [(i, f"{words[i]} {phrases[i * 37]} q{i} {phrases[i * 11]} tail") for i in range(300)]
    have, seen = set(phrases), 0
    for r in normalize.normalize(spark.createDataFrame(rows, "query_id int, raw_query string"), known).collect():
        text = rows[r.query_id][1].replace(f" q{r.query_id} ", f" w{r.query_id % 3000} w{r.query_id % 7} ").split()
        assert r.normalized_text.split() == text
        runs = {" ".join(text[i : i + n]) for i in range(len(text)) for n in (2, 3, 4) if i + n <= len(text)}
        assert set(r.protected_phrases) == runs & have and r.aliases_applied == [f"q{r.query_id}"]
        seen += len(r.protected_phrases)
    assert seen >= 600


def test_term_buckets_and_assets(spark, tmp_path):
    import json

    from folioscan.operators import terms

    titles = spark.createDataFrame([("old title",)], "phrase string")
    counts = spark.createDataFrame([("old title", 9), ("attack roll", 3), ("plain words", 4), ("rare words", 3)], "phrase string, n long")
    got = {r.phrase: (r.is_protected, r.is_content) for r in terms.term_buckets(titles, counts).collect()}
    assert got == {"old title": (True, True), "attack roll": (True, False), "plain words": (False, True)}
    root = str(tmp_path)
    for _ in range(2):  # a second run replaces the first
        names = terms.write_term_assets(terms.term_buckets(titles, counts), root, ["b c", "a b", "a b"], {"x": "y z", "b": "c"}, ["bs c"])
    assert names == ["canonical_aliases.json", "extraction_candidates", "protected_phrases.json", "surface_variants.json"]
    assert json.loads((tmp_path / "protected_phrases.json").read_text()) == ["a b", "b c"]
    assert [r.value for r in spark.read.text(f"{root}/extraction_candidates").collect()] == sorted(got)
    # what is written can be read, and is used
    known = terms.read_vocabulary(spark, root)
    asked = spark.createDataFrame([(1, "x bs c")], "query_id int, raw_query string")
    assert normalize.normalize(asked, known).first().tokens == ["y", "z", "bs c"]
    (tmp_path / "surface_variants.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="surface_variants"):
        terms.read_vocabulary(spark, root)
    (tmp_path / "surface_variants.json").unlink()
    with pytest.raises(Exception, match="surface_variants"):
        terms.read_vocabulary(spark, root).phrases.collect()
    spark.createDataFrame([("long list",)], "value string").write.text(f"{root}/surface_variants")
    assert {r.phrase for r in terms.read_vocabulary(spark, root).phrases.collect()} == {"a b", "b c", "long list"}


def test_entry_types_from_a_registry(tmp_path):
    import json

    from folioscan.sources import scan

    path = tmp_path / "types.json"
    kind = {"name": "n", "category": "C", "chunk_type": "t", "shape": "definition_list", "shape_params": {"min_blocks": 5, "term_pattern": r"^\w+:"}}
    path.write_text(json.dumps({"content_types": [kind, kind | {"file_match": ["A*.rtf"]}]}))
    first, second = scan.read_content_types(str(path))
    assert (first.files, first.min_blocks, first.pattern) == (None, 5, r"(?U)^\w+:") and second.files == ("A*.rtf",)
    path.write_text("[]")
    with pytest.raises(ValueError):
        scan.read_content_types(str(path))


def test_folded_letters(spark):
    assert value(spark, T.index_terms(F.lit("Čapek Éàñ ǎ"))) == ["capek", "ean", "a"]


def test_rejected_rows_have_reasons(spark):
    from folioscan.operators import index

    columns = "chunk_id string, document_id string, content string, section_path array<string>, chunk_type string, source_id string, edition string, source_type string, authority_level string, parent_chunk_id string, previous_chunk_id string, next_chunk_id string, child_no int"
    rows = [(f"c{i}", f"d{i}", "fire ball burns", ["a"], "generic", "s", e, "core", "primary", None, None, None, 0) for i, e in enumerate(["x", "y", "x"])]
    made = index.build_index(spark.createDataFrame(rows, columns))
    queries = normalize.normalize(spark.createDataFrame([(1, "fire ball")], "query_id long, raw_query string"))
    limits = Constraints(("x",), ("core",), ("primary",))
    assert [(r.chunk_id, r.reason) for r in retrieve.rejected(queries, made, limits).collect()] == [("c1", "edition 'y' not in ['x']")]
    assert {r.chunk_id for r in retrieve.retrieve(queries, made, limits).collect()} == {"c0", "c2"}
    assert retrieve.retrieve(queries, made, None).count() == 3
