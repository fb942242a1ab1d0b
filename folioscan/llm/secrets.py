"""Secret scans.

Base spans by pattern: assignments to a credential name, access key ids, long
hexadecimal runs.  Values in a wider credential context (more names, other
assignment forms) are then rated by their guess cost: the cheapest segmentation
of the value, by dynamic programming, into words, dates, repeats, keyboard walks
and brute-force spans, in bits.  Values of MIN_BITS or more are added as spans of
kind `guess`, unless a base span already covers them; the values of base
assignments are rated too, so that placeholders can be told from credentials.

Words are those of a short fixed list of password words, and the words of the
corpus (corpus_words), which cost their share of all words.  A word of the corpus
is one that follows many different words, so that a secret in many copies of a
text does not become one.

Defined results: null and empty texts hold nothing; overlapping kinds are all
kept; offsets are code points, end exclusive; repeated rows repeat; extra
columns stay as they are, but one with the name given for the result gives way
to it; an empty table has no words, and then the fixed list alone counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 36.0
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_WIDER = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "cred", "://")
CONTEXT = re.compile(
    r"""(?i:\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|signing|client)[_-]?(?:key|secret)"""
    r"""|auth(?:orization)?|bearer|credentials?)|"""
    # names of several parts: each is read once, from its first part
    r"""(?<![a-z0-9])(?<![a-z0-9][_-])[a-z0-9]++(?:[_-][a-z0-9]++)*+"""
    r"""(?:(?<=[_-]pass)|(?<=[_-]pwd)|(?<=[_-]passwd)|(?<=[_-]password)|(?<=[_-]secret)|(?<=[_-]token)|(?<=[_-]key)))["']?"""
    r"""(?:\x20*(?:=>|:=|[:=])\x20*|\x20+(?:is\x20+)?)["']?((?:Bearer\x20+|Basic\x20+)?)([^\s"'<>,;]{8,})""",
    re.ASCII,
)
#: The part of an address behind its scheme, which is looked for backwards, so that
#: a run of letters that leads to no address is read once.
URL = re.compile(r"(?<=[a-z0-9+.-])://[^\s/:@]++:([^\s/@]{8,}+)@", re.ASCII)
#: Common words of passwords, most common first (fixed list; the rank is the cost).
WORDS = (
    "password pass admin welcome login letmein master dragon monkey qwerty abc love hello secret "
    "summer winter spring autumn test user guest root default changeme access football baseball "
    "princess sunshine shadow super hunter killer jordan michael charlie thomas george daniel "
    "computer internet server database example sample token value string number company system "
    "private public client service production staging develop local house green black white "
    "january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday the and for you are that with this "
    "from have not was key your name none null true false enter here placeholder redacted xxxx"
).split()
_RANK = {w: log2(i + 2) for i, w in enumerate(WORDS)}
#: Longest word of the corpus that counts; the fewest contexts of one, out of 64
#: classes of the words before it; and its least share of all words: at most
#: 1 / MIN_SHARE words reach that.
LONGEST, MIN_CONTEXTS, MIN_SHARE = 24, 16, 1e-5
_LEET = str.maketrans("013457@$!", "oleasta" + "si")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(b, a) for a, b in _NEXT}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?[01]?\d[-/._]?[0-3]?\d|[0-3]?\d[-/._]?[01]?\d[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
DATE_BITS, WALK_BITS, CUT_BITS = log2(366 * 120), log2(47 * 2), 1.0


def _alphabet(value: str) -> float:
    size = 10 * bool(re.search(r"\d", value)) + 26 * bool(re.search("[a-z]", value))
    size += 26 * bool(re.search("[A-Z]", value)) + 33 * bool(re.search(r"[^A-Za-z0-9]", value))
    return log2(max(size, 2))


class Guesser:
    """Guess costs with the words of a corpus (word: bits) next to the fixed list."""

    #: Values whose costs are remembered.
    KNOWN = 65_536

    def __init__(self, words: Mapping[str, float] | None = None):
        self.words = dict(words or {})
        for w, bits in _RANK.items():
            self.words[w] = min(bits, self.words.get(w, bits))
        self.longest = max(map(len, self.words))
        self.known: dict[str, float] = {}

    def bits(self, value: str) -> float:
        found = self.known.get(value)
        if found is None:
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            found = self.known[value] = self._cheapest(value)
        return found

    def _cheapest(self, value: str) -> float:
        """Bits of the cheapest way to guess value piece by piece.

        best[i] is the cost of the first i characters; a run of brute force pays
        its characters one by one, so the work is proportional to the length."""
        n, low = len(value), value.lower()
        if len(low) != n:  # a letter whose lower case is longer: the value as it stands
            low = value
        plain = low.translate(_LEET)
        letter = _alphabet(value)
        best = [0.0] + [float("inf")] * n
        dates = {m.start(): m.end() for m in _DATE.finditer(value)}
        cost_of = self.words.get
        for i in range(n):
            here = best[i] + CUT_BITS * bool(i)
            if best[i] + letter < best[i + 1]:
                best[i + 1] = best[i] + letter
            for j in range(i + 3, min(n, i + self.longest) + 1):
                cost = cost_of(low[i:j]) or cost_of(plain[i:j])
                if cost:
                    cost += (value[i:j] != low[i:j]) + (low[i:j] != plain[i:j])
                    best[j] = min(best[j], here + cost)
            if i in dates:
                best[dates[i]] = min(best[dates[i]], here + DATE_BITS)
            if not i or (low[i - 1], low[i]) not in _NEXT:  # keyboard walks, from where they begin
                j = i + 1
                while j < n and (low[j - 1], low[j]) in _NEXT:
                    j += 1
                    if j - i >= 3:
                        best[j] = min(best[j], here + WALK_BITS + log2(j - i))
            for width in (1, 2, 3, 4):  # repeats, from where they begin
                if i + 2 * width > n or (i >= width and value[i - width : i] == value[i : i + width]):
                    continue
                j = i + width
                while value[j : j + width] == value[i : i + width] and j + width <= n:
                    j += width
                    best[j] = min(best[j], here + width * letter + log2((j - i) // width))
        return best[n]


_PLAIN = Guesser()


def guess_bits(value: str) -> float:
    """Guess cost with the fixed words alone."""
    return _PLAIN.bits(value)


def _has_scheme(text: str, end: int) -> bool:
    """Whether the characters of a scheme before end hold a letter."""
    while end and text[end - 1] in "0123456789+.-":
        end -= 1
    return bool(end) and "a" <= text[end - 1] <= "z"


def _values(text: str) -> list[tuple[int, int]]:
    """Values in a credential context, without closing punctuation."""
    found = {m.span(2) for m in CONTEXT.finditer(text)} | {m.span(1) for m in URL.finditer(text) if _has_scheme(text, m.start())}
    out = []
    for a, b in sorted(found):
        while b > a and text[b - 1] in ".:!?)]}":
            b -= 1
        if b - a >= 8:
            out.append((a, b))
    return out


def rated_spans(text: str | None, guesser: Guesser = _PLAIN) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits), by start, then kind as listed; bits are those of
    the value, for kinds assign and guess."""
    if not text:
        return []
    found: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [("assign", *m.span(), guesser.bits(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    if any(x in low for x in _WIDER):
        # base spans by start, with the furthest end so far: one search tells
        # whether any of them covers a value
        base = sorted((a, b) for _, a, b, _ in found)
        starts, ends = [a for a, _ in base], []
        for _, b in base:
            ends.append(max(b, ends[-1]) if ends else b)
        for a, b in _values(text):
            k = bisect_right(starts, a)
            if k and ends[k - 1] >= b:
                continue
            bits = guesser.bits(text[a:b])
            if bits >= MIN_BITS:
                found.append(("guess", a, b, bits))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans_of(text: str | None, guesser: Guesser = _PLAIN) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind as listed."""
    return [s[:3] for s in rated_spans(text, guesser)]


def corpus_words(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, min_share: float = MIN_SHARE) -> dict[str, float]:
    """Words of all texts (runs of letters, lower-cased) with their costs in bits.
    A word's contexts are one mask of 64 classes of the words before it, which
    tasks merge before the exchange.  What comes to the driver is bounded by
    1 / min_share words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{3,{LONGEST}}}"), F.lit(0))
    lists = docs.filter("text is not null").select(words.alias("w")).filter(F.size("w") > 1)
    n = F.size("w") - 1
    pairs = F.zip_with(
        F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n),
        lambda x, y: F.struct(F.pmod(F.xxhash64(x), F.lit(64)).cast("int").alias("class"), y.alias("word")),
    )
    seen = lists.select(F.explode(pairs).alias("p")).select("p.word", F.expr("shiftleft(1L, p.class)").alias("mask"))
    counted = materialize(
        seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or("mask")).alias("contexts")), "word-contexts"
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    common = counted.filter((F.col("contexts") >= min_contexts) & (F.col("n") >= min_share * total)).collect()
    return {r["word"]: log2(total / r["n"]) + 1 for r in common}


SPANS = "spans array<struct<kind:string,start:bigint,end:bigint,bits:double>>"


def find_secrets(docs: DataFrame, words: Mapping[str, float] | None = None, name: str = "secrets") -> DataFrame:
    """docs with a column `name`: array of (kind, start, end, bits).  words: costs
    of corpus_words."""
    sent = docs.sparkSession.sparkContext.broadcast(dict(words or {}))

    @F.pandas_udf(SPANS)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        guesser = Guesser(sent.value)
        for batch in texts:
            rows = [rated_spans(t, guesser) for t in batch]
            keys = ("kind", "start", "end", "bits")
            yield pd.DataFrame({"spans": [[dict(zip(keys, s, strict=True)) for s in r] for r in rows]})

    return docs.withColumn(name, found.asNondeterministic()("text")["spans"])
