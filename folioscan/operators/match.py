"""Raw MATCH expressions over the index: phrases, prefixes, AND, OR, NOT, NEAR,
column filters and first words.

    phrase    word, "some words", a + b; a * behind it makes its last word a prefix
    ^phrase   only at the beginning of a column
    NEAR(p q, n)   phrases with at most n words between first and last (10 if not said)
    col : x   {col1 col2} : x   - col : x      x only in (or only outside) columns
    x y = x AND y, which bind tighter than NOT, NOT tighter than AND, AND than OR

A batch of expressions is a table.  Each expression is read once, into its phrases
and a postfix program over them.  Phrases are found for the whole batch together, as
in the search of questions; prefixes become the terms of the index that they begin;
NEAR keeps the places of a chunk's column that stand together; and a fold over the
program decides each (expression, chunk) and which phrases count for its score.

Defined results: a phrase without a word is left out of what stands side by side
and holds nowhere beside AND, OR and NOT; a malformed expression finds nothing and is told by `malformed`; a
null expression is malformed; phrases behind NOT add nothing to a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.sources import store

from . import retrieve as R
from .index import COLUMNS, Index, part

NEAR_DEFAULT = 10
_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([-(){}:^*+,]))')
_PHRASE = "array<struct<text:string,prefix:boolean>>"
_PARSED = (
    "error string, program array<struct<op:string,arg:int>>, "
    f"sets array<struct<cols:array<int>,first:boolean,distance:int,phrases:array<{_PHRASE}>>>"
)


class Malformed(ValueError):
    pass


@dataclass
class _Reader:
    """Reads one expression by descent; cols: columns that an outer filter leaves."""

    tokens: list[tuple[str, str]]
    at: int = 0
    program: list[tuple[str, int]] = field(default_factory=list)
    sets: list[tuple] = field(default_factory=list)

    def next_is(self, kind: str, value: str | None = None, ahead: int = 0) -> bool:
        at = self.at + ahead
        return at < len(self.tokens) and self.tokens[at][0] == kind and value in (None, self.tokens[at][1])

    def take(self, kind: str, value: str | None = None) -> str:
        if not self.next_is(kind, value):
            got = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise Malformed(f'syntax error near "{got}"')
        self.at += 1
        return self.tokens[self.at - 1][1]

    def binary(self, cols, op: str, inner) -> None:
        inner(cols)
        while self.next_is("word", op):
            self.at += 1
            inner(cols)
            self.program.append((op.lower(), 0))

    def either(self, cols) -> None:
        self.binary(cols, "OR", self.both)

    def both(self, cols) -> None:
        self.binary(cols, "AND", self.without)

    def without(self, cols) -> None:
        self.binary(cols, "NOT", self.unit)

    def unit(self, cols) -> None:
        """A group in brackets, or phrases side by side."""
        if self.next_is("sign", "("):
            self.at += 1
            self.either(cols)
            self.take("sign", ")")
            return
        mark = self.at
        inner = self.columns(cols)
        if self.at > mark and self.next_is("sign", "("):
            self.unit(inner)
            return
        self.one_set(inner)
        while self.starts_set():
            self.one_set(self.columns(cols))
            self.program.append(("beside", 0))

    def starts_set(self) -> bool:
        if self.next_is("word"):
            return self.tokens[self.at][1] not in ("AND", "OR", "NOT")
        return any(self.next_is("sign", s) for s in "-{^") or self.next_is("string")

    def columns(self, cols):
        """A column filter, if one stands here."""
        out = self.next_is("sign", "-")
        name = self.next_is("sign", "{", int(out))
        if not (out or name or ((self.next_is("word") or self.next_is("string")) and self.next_is("sign", ":", 1))):
            return cols
        self.at += int(out)
        names = []
        if self.next_is("sign", "{"):
            self.at += 1
            while not self.next_is("sign", "}"):
                names.append(self.name())
            self.at += 1
        else:
            names.append(self.name())
        self.take("sign", ":")
        known = {c.lower(): i for i, c in enumerate(COLUMNS)}
        if missing := [n for n in names if n.lower() not in known]:
            raise Malformed(f"no such column: {missing[0]}")
        picked = {known[n.lower()] for n in names}
        picked = set(range(len(COLUMNS))) - picked if out else picked
        return sorted(picked if cols is None else picked & set(cols))

    def name(self) -> str:
        return _plain(self.take("string")) if self.next_is("string") else self.take("word")

    def one_set(self, cols) -> None:
        first = self.next_is("sign", "^")
        self.at += int(first)
        phrases, distance = [], NEAR_DEFAULT
        if not first and self.next_is("word", "NEAR") and self.next_is("sign", "(", 1):
            self.at += 2
            phrases.append(self.phrase())
            while not (self.next_is("sign", ")") or self.next_is("sign", ",")):
                phrases.append(self.phrase())
            if self.next_is("sign", ","):
                self.at += 1
                number = self.take("word")
                if not (number.isascii() and number.isdigit()):
                    raise Malformed(f'expected integer, got "{number}"')
                distance = min(int(number), 2**31 - 1)
            self.take("sign", ")")
        else:
            phrases.append(self.phrase())
        self.program.append(("set", len(self.sets)))
        self.sets.append((cols, first, distance, phrases))

    def phrase(self) -> list[tuple[str, bool]]:
        parts = [self.part()]
        while self.next_is("sign", "+"):
            self.at += 1
            parts.append(self.part())
        return parts

    def part(self) -> tuple[str, bool]:
        if self.next_is("string"):
            text = _plain(self.take("string"))
        else:
            if self.next_is("word") and self.tokens[self.at][1] in ("AND", "OR", "NOT"):
                self.take("sign")
            text = self.take("word")
        star = self.next_is("sign", "*")
        self.at += int(star)
        return text, star


def _plain(quoted: str) -> str:
    return quoted[1:-1].replace('""', '"')


def read(expression: str | None) -> tuple:
    """(error, program, sets) of one expression."""
    try:
        if expression is None:
            raise Malformed("no expression")
        tokens, at, end = [], 0, len(expression.rstrip())
        while at < end:
            m = _TOKEN.match(expression, at, end)
            if not m:
                if '"' in expression[at:end].lstrip()[:1]:
                    raise Malformed("unterminated string")
                raise Malformed(f'syntax error near "{expression[at:end].strip()[:1]}"')
            tokens.append((("string", "word", "sign")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        reader = _Reader(tokens)
        if tokens:
            reader.either(None)
        if reader.at < len(tokens):
            raise Malformed(f'syntax error near "{tokens[reader.at][1]}"')
        return None, reader.program, reader.sets
    except (Malformed, RecursionError) as error:
        return str(error) or "too deep", [], []


def parsed(expressions: DataFrame) -> DataFrame:
    """expressions: query_id, expression.  query_id, error, program, sets."""
    reader = F.udf(lambda e: read(e), _PARSED)
    return expressions.select("query_id", reader("expression").alias("p")).select("query_id", "p.*")


def malformed(expressions: DataFrame) -> DataFrame:
    """query_id and error of what cannot be read."""
    return parsed(expressions).filter("error is not null").select("query_id", "error")


def _phrases(read: DataFrame) -> DataFrame:
    """query_id, set_no, phrase_no, cols, first, distance, words (word, prefix), and
    phrase: a name that equal searches share."""
    sets = read.select("query_id", F.posexplode("sets").alias("set_no", "s"))
    each = sets.select("query_id", "set_no", "s.cols", "s.first", "s.distance", F.posexplode("s.phrases").alias("phrase_no", "parts"))

    def words(p: Column) -> Column:
        found = T.index_terms(p["text"])
        return F.transform(found, lambda w, i: F.struct(w.alias("word"), (p["prefix"] & (i == F.size(found) - 1)).alias("prefix")))

    named = each.withColumn("words", F.flatten(F.transform("parts", words))).filter(F.size("words") > 0).drop("parts")
    text = F.transform("words", lambda w: F.concat(w["word"], F.when(w["prefix"], "*").otherwise("")))
    return named.withColumn("phrase", F.array_join(text, " "))


def _slots(phrases: DataFrame, index: Index) -> DataFrame:
    """phrase, n, j, term; a prefix takes all terms that it begins.  Terms are cut
    to their beginnings, up to the longest asked, and joined by them: no prefix is
    compared with every term."""
    distinct = phrases.select("phrase", "words").distinct()
    each = distinct.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("j", "w"))
    whole = each.filter(~F.col("w.prefix")).select("phrase", "n", "j", F.col("w.word").alias("term"))
    begun = each.filter("w.prefix").select("phrase", "n", "j", F.col("w.word").alias("start"))
    lengths = begun.select(F.length("start").alias("l")).distinct().orderBy("l").limit(64).collect()
    if not lengths:
        return whole
    longest = begun.agg(F.max(F.length("start"))).first()[0]
    # as many cuts as there are lengths of prefixes
    at = F.array(*[F.lit(r["l"]) for r in lengths]) if len(lengths) < 64 else F.sequence(F.lit(1), F.lit(longest))
    cuts = index.terms.select("term", F.explode(F.filter(at, lambda n: n <= F.length("term"))).alias("l"))
    cuts = cuts.select("term", F.expr("substring(term, 1, l)").alias("start"))
    return whole.unionByName(begun.join(cuts, "start").select("phrase", "n", "j", "term"))


def near(places: list[list[int]], sizes: list[int], distance: int) -> list[int]:
    """How many places of each phrase stand together: a walk over the sorted places
    of all phrases, in which those that lag behind the last one by more than its
    reach move on, and a standing set counts."""
    at, kept = [0] * len(places), [set() for _ in places]
    while True:
        last = max(p[i] for p, i in zip(places, at, strict=True))
        moved = False
        for k, p in enumerate(places):
            least = last - sizes[k] - distance
            while p[at[k]] < least:
                at[k] += 1
                moved = True
                if at[k] == len(p):
                    return [len(s) for s in kept]
            last = max(last, p[at[k]])
        if moved:
            continue
        for k, p in enumerate(places):
            kept[k].add(p[at[k]])
        k = min(range(len(places)), key=lambda k: places[k][at[k]])
        at[k] += 1
        if at[k] == len(places[k]):
            return [len(s) for s in kept]


def _frequencies(phrases: DataFrame, starts: DataFrame) -> DataFrame:
    """query_id, set_no, phrase_no, chunk_id, f: places that count, after the
    filters of columns and first words and after NEAR."""
    ok = (F.col("cols").isNull() | F.array_contains("cols", F.col("col"))) & (~F.col("first") | (F.col("start") == 0))
    keys = ["query_id", "set_no"]
    size = phrases.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    each = phrases.join(size, keys).withColumn("n", F.size("words")).join(starts, "phrase").filter(ok)
    count = F.count(F.lit(1)).alias("f")
    alone = each.filter("members = 1").groupBy(*keys, "phrase_no", "chunk_id").agg(count)
    # places of one chunk's column: no more than its words
    side = (
        each.filter("members > 1").groupBy(*keys, "members", "distance", "phrase_no", "n", "chunk_id", "col")
        .agg(F.collect_list("start").alias("places"))
        .groupBy(*keys, "members", "distance", "chunk_id", "col").agg(F.array_sort(F.collect_list(F.struct("phrase_no", "n", "places"))).alias("p"))
        .filter(F.size("p") == F.col("members"))
    )
    walk = F.udf(lambda places, sizes, distance: near([sorted(p) for p in places], sizes, distance), "array<int>")
    kept = side.withColumn("kept", walk(F.col("p.places"), F.col("p.n"), F.col("distance")))
    together = kept.select(*keys, "chunk_id", F.explode(F.arrays_zip(F.col("p.phrase_no").alias("phrase_no"), F.col("kept").alias("f"))).alias("e"))
    together = together.select(*keys, "e.phrase_no", "chunk_id", "e.f").filter("f > 0")
    together = together.groupBy(*keys, "phrase_no", "chunk_id").agg(F.sum("f").alias("f"))
    return alone.unionByName(together)


def _decide(program: Column, hits: Column, empty: Column) -> Column:
    """The sets that count, or null if the expression does not hold.  On the stack:
    state 0 (no phrase at all), 1 (does not hold) or 2 (holds), and sets."""
    none = F.array().cast("array<int>")
    item = lambda state, sets: F.struct(state.cast("int").alias("state"), sets.alias("sets"))

    def step(stack: Column, op: Column) -> Column:
        hit = F.array_contains(hits, op["arg"])
        state = F.when(F.array_contains(empty, op["arg"]), 0).when(hit, 2).otherwise(1)
        pushed = F.concat(stack, F.array(item(state, F.when(hit, F.array(op["arg"])).otherwise(none))))
        left, right = F.try_element_at(stack, F.lit(-2)), F.try_element_at(stack, F.lit(-1))
        both = F.concat(left["sets"], right["sets"])
        yes = lambda x: x["state"] == 2
        holds = (
            F.when(op["op"].isin("and", "beside"), yes(left) & yes(right)).when(op["op"] == "or", yes(left) | yes(right)).otherwise(yes(left) & ~yes(right))
        )
        counts = F.when(~holds, none).when(op["op"] == "not", left["sets"]).otherwise(both)
        beside = op["op"] == "beside"
        joined = (
            F.when(beside & (left["state"] == 0), right).when(beside & (right["state"] == 0), left)
            .otherwise(item(F.when(holds, 2).otherwise(1), counts))
        )
        rest = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0)))
        return F.when(op["op"] == "set", pushed).otherwise(F.concat(rest, F.array(joined)))

    start = F.array().cast("array<struct<state:int,sets:array<int>>>")
    top = F.try_element_at(F.aggregate(program, start, step), F.lit(1))
    return F.when(top["state"] == 2, top["sets"])


def _plain_sets(phrases: DataFrame) -> bool:
    """No NEAR, and no prefix before the last word of a phrase."""
    inner = F.exists(F.slice("words", F.lit(1), F.size("words") - 1), lambda w: w["prefix"])
    return phrases.filter(inner | (F.col("phrase_no") > 0)).isEmpty()


def _programs(read: DataFrame, filled: DataFrame) -> DataFrame:
    """query_id, program, empty: the sets without a word.  filled: query_id, set_no."""
    every = F.expr("sequence(0, size(sets) - 1)")
    asked = read.filter(F.size("sets") > 0).select("query_id", "program", every.alias("every"))
    asked = asked.join(filled.groupBy("query_id").agg(F.collect_list("set_no").alias("filled")), "query_id")
    return asked.select("query_id", "program", F.array_except("every", "filled").alias("empty"))


def _scanned_scores(read: DataFrame, phrases: DataFrame, index: Index) -> DataFrame:
    """match_scores over a scan_index, of sets of one phrase each.  All that is
    counted per chunk is counted where the chunk lies; an expression is decided once
    for each combination of its sets that some chunk holds."""
    ok = (F.col("cols").isNull() | F.array_contains("cols", F.col("col"))) & (~F.col("first") | (F.col("start") == 0))
    starts = R.scanned_starts(store.stored(_slots(phrases, index), "match-slots"), index)
    # the phrases of the batch are small beside the texts
    each = starts.join(F.broadcast(phrases.select("query_id", "set_no", "phrase", "cols", "first")), "phrase").filter(ok)
    freq = each.groupBy("query_id", "set_no", "chunk_id", "length").agg(F.count(F.lit(1)).alias("f"))
    hits = F.sort_array(F.collect_list(F.struct("set_no", "f"))).alias("hits")
    held = store.stored(freq.groupBy("query_id", "chunk_id", "length").agg(hits), "match-hits")
    # a phrase weighs by the chunks that hold it in its columns
    spread = held.select("query_id", F.explode("hits.set_no").alias("set_no")).groupBy("query_id", "set_no").agg(F.count(F.lit(1)).alias("n_p"))
    sizes = index.sizes.select(F.col("n").alias("n_chunks"), "total")  # one row
    idf = R.weight(F.col("n_chunks"), F.col("n_p"))
    weights = spread.join(F.broadcast(sizes)).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("set_no", idf.alias("idf")))).alias("weights"))
    known = _programs(read, phrases.select("query_id", "set_no")).join(weights, "query_id")
    kinds = held.select("query_id", F.col("hits.set_no").alias("kind")).distinct().join(known, "query_id")
    kinds = kinds.select("query_id", "kind", "weights", _decide(F.col("program"), F.col("kind"), F.col("empty")).alias("sets")).filter(F.size("sets") > 0)
    kinds = F.broadcast(store.stored(kinds, "match-kinds"))
    rated = held.withColumn("kind", F.col("hits.set_no")).join(kinds, ["query_id", "kind"]).join(F.broadcast(sizes))
    counting = F.filter("hits", lambda h: F.array_contains("sets", h["set_no"]))
    gain = lambda h: F.element_at("weights", h["set_no"]) * part(h["f"], F.col("length"), F.col("total") / F.col("n_chunks"))
    total = F.aggregate(counting, F.lit(0.0), lambda acc, h: acc + gain(h))
    return rated.select("query_id", "chunk_id", (F.round(-total, R.DIGITS) + F.lit(0.0)).alias("raw_score"))


def match_scores(expressions: DataFrame, index: Index) -> DataFrame:
    """expressions: query_id, expression.  query_id, chunk_id, raw_score of every
    chunk for which an expression holds: BM25 over its phrases, lower is better."""
    read = store.stored(parsed(expressions).filter("error is null"), "read-expressions")
    phrases = store.stored(_phrases(read), "match-phrases")
    if index.words is not None and _plain_sets(phrases):
        return _scanned_scores(read, phrases, index)
    starts = store.stored(R.phrase_starts(_slots(phrases, index), index.live(index.postings), index.terms).distinct(), "match-starts")
    freq = store.stored(_frequencies(phrases, starts), "match-frequencies")
    keys = ["query_id", "set_no"]
    members = phrases.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    held = freq.groupBy(*keys, "chunk_id").agg(F.count(F.lit(1)).alias("got")).join(members, keys).filter("got = members")
    hits = held.groupBy("query_id", "chunk_id").agg(F.collect_list("set_no").alias("hits"))
    decided = hits.join(_programs(read, members), "query_id").withColumn("sets", _decide(F.col("program"), F.col("hits"), F.col("empty")))
    counting = decided.filter("sets is not null").select("query_id", "chunk_id", F.explode("sets").alias("set_no"))
    # a phrase weighs by the chunks that hold it in its columns, near others or not
    kinds = phrases.select(*keys, "phrase_no", "phrase", "cols", "first")
    allowed = (F.col("cols").isNull() | F.array_contains("cols", F.col("col"))) & (~F.col("first") | (F.col("start") == 0))
    shown = F.coalesce(F.array_join("cols", ","), F.lit("*"))
    kinds = kinds.withColumn("kind", F.concat_ws("|", "phrase", shown, F.col("first").cast("string")))
    spread = (
        kinds.select("kind", "phrase", "cols", "first").dropDuplicates(["kind"]).join(starts, "phrase").filter(allowed)
        .select("kind", "chunk_id").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n_p"))
    )
    sizes = index.sizes.select(F.col("n").alias("n_chunks"), "total")  # one row
    rated = (
        counting.join(freq, [*keys, "chunk_id"]).join(kinds.select(*keys, "phrase_no", "kind"), [*keys, "phrase_no"])
        .join(spread, "kind").join(index.lengths, "chunk_id").join(F.broadcast(sizes))
    )
    gain = R.weight(F.col("n_chunks"), F.col("n_p")) * part(F.col("f"), F.col("length"), F.col("total") / F.col("n_chunks"))
    return rated.groupBy("query_id", "chunk_id").agg((F.round(-F.sum(gain), R.DIGITS) + F.lit(0.0)).alias("raw_score"))


def search(expressions: DataFrame, index: Index, k: int = 5) -> DataFrame:
    """The k best chunks of each expression, with rank and the columns of chunks;
    none at all for k of 0 or less."""
    best = R.top(match_scores(expressions, index), "raw_score", k)
    return best.join(index.live(index.chunks), "chunk_id")
