"""Benchmark decontamination.

Texts are normalised to words: A-Z are lower-cased, and every ASCII character
but digits and letters separates words.  One Aho-Corasick automaton over word
numbers holds the windows of all items, and each document is scanned once.
Matches are word positions, which are mapped back to offsets in the original.

Defined results: null and empty texts have no words and no hits; an item of
fewer words than a window is one window, one without words none; equal items
and windows all count; an empty benchmark contaminates nothing; extra columns
stay as they are, but one with the name given for the result gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

WINDOW = 10
#: Largest benchmark that is sent to the executors whole, in characters.  A
#: larger one is scanned for in parts of this size, one pass over the documents
#: each, so that a worker holds one automaton of bounded size at a time.
PART_CHARS = 4_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_LOWER = {b: b + 32 for b in range(65, 91)}
RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _windows(items: list[tuple[str, str | None]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[i : i + window]), set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


def _automaton(windows: dict[tuple[bytes, ...], list[str]]):
    number: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, items in windows.items():
        machine.add_word(
            tuple(number.setdefault(w, len(number) + 1) for w in key), (len(key), items)
        )
    if windows:
        machine.make_automaton()
    return machine, number


def scan(text: str | None, machine, number: dict[bytes, int], to_text: bool = True):
    """(number of words, number of hit words, items, spans) of one text."""
    w = words(text)
    if not number or not w:
        return len(w), 0, [], []
    get = number.get
    ids = tuple([get(x, 0) for x in w])
    hit, items, runs = 0, set(), []
    for end, (length, names) in machine.iter(ids):
        items.update(names)
        runs.append((end - length + 1, end + 1))
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    hit = sum(b - a for a, b in merged)
    spans = []
    if merged and to_text:
        at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
        spans = [(at[a][0], at[b - 1][1]) for a, b in merged]
    return len(w), hit, sorted(items), spans


def n_parts(benchmark: DataFrame, limit: int) -> int:
    chars = benchmark.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16)).first()[0] or 0
    return max(1, -(-chars // limit))


def _part(benchmark: DataFrame, k: int, n: int) -> list[tuple[str, str | None]]:
    rows = benchmark.select(F.col("item_id").cast("string"), "text")
    part = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == k) if n > 1 else rows
    return [(str(i), t) for i, t in part.toLocalIterator()]


def _searcher(sent):
    @F.pandas_udf(RESULT)
    def look(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine, number = _automaton(sent.value)
        for batch in texts:
            rows = [scan(t, machine, number) for t in batch]
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "n_hit": [r[1] for r in rows],
                    "items": [r[2] for r in rows],
                    "spans": [[{"start": a, "end": b} for a, b in r[3]] for r in rows],
                }
            )

    return look.asNondeterministic()


def _merge(texts: pd.Series, items: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """The result of all parts: hit words are those inside any span."""
    rows = []
    for text, names, runs in zip(texts, items, spans, strict=True):
        merged: list[list[int]] = []
        for a, b in sorted((s["start"], s["end"]) for s in runs) if runs is not None else ():
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        hit, k = 0, 0
        for x, y in [m.span() for m in WORD.finditer(text.translate(_LOWER))] if merged else ():
            while k < len(merged) and merged[k][1] < y:
                k += 1
            hit += k < len(merged) and merged[k][0] <= x
        found = sorted(set(names)) if names is not None else []
        rows.append((len(words(text)), hit, found, [{"start": a, "end": b} for a, b in merged]))
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_chars: int = PART_CHARS, name: str = "contamination"
) -> DataFrame:
    """docs with a struct column `name`: n_words, n_hit, items (sorted
    ids of items of which a window occurs) and spans (hit runs as offsets in the
    original text, in code points, end exclusive)."""
    n = n_parts(benchmark, part_chars)
    send = docs.sparkSession.sparkContext.broadcast
    if n == 1:
        return docs.withColumn(name, _searcher(send(_windows(_part(benchmark, 0, 1), window)))("text"))
    # one automaton in memory at a time: each part scans by itself and keeps hit rows only
    row = fresh(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    hits = None
    for k in range(n):
        sent = send(_windows(_part(benchmark, k, n), window))
        got = numbered.select(row, _searcher(sent)("text").alias("got")).filter("got.n_hit > 0")
        part = materialize(got.select(row, "got.items", "got.spans"), "decontamination-hits")
        sent.destroy()
        hits = part if hits is None else hits.unionByName(part)
    by = hits.groupBy(row).agg(
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    both = fresh(numbered, "hits")
    merged = numbered.join(by.select(row, F.struct("items", "spans").alias(both)), row, "left")
    found = F.pandas_udf(_merge, RESULT)("text", F.col(both)["items"], F.col(both)["spans"])
    return merged.withColumn(name, found).select(*[c for c in docs.columns if c.lower() != name.lower()], name)
