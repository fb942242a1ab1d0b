"""Marked-up files to formatted spans.

Group-structured markup is a pushdown language, which no built-in function
reads, so one Arrow-batched function per file does it; everything after works on
columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BODY_SIZE = 24  # half-points
SPANS = "array<struct<text:string,font_size:int,bold:boolean>>"
# Groups that show nothing, and the text of control words.
HIDDEN_GROUPS = frozenset(
    "fonttbl colortbl stylesheet info generator filetbl listtable listoverridetable revtbl".split()
)
SHOWN = {
    "par": "\n", "line": "\n", "row": "\n", "tab": "\t", "cell": " | ", "emdash": "--", "endash": "-",
    "lquote": "'", "rquote": "'", "ldblquote": '"', "rdblquote": '"',
}
SYMBOLS = {"{": "{", "}": "}", "\\": "\\", "~": " ", "-": "-", "_": "-"}
_LEX = re.compile(
    r"(?P<open>\{)|(?P<close>\})|\\'(?P<byte>[0-9A-Fa-f]{2})|\\(?P<word>[A-Za-z]+)(?P<arg>[+-]?\d+)? ?"
    r"|\\(?P<symbol>[^A-Za-z])|(?P<text>[^\\{}]+)|\\",
    re.S,
)


class _State:
    __slots__ = ("size", "bold", "hidden", "fallback", "fresh")

    def __init__(self, size=BODY_SIZE, bold=False, hidden=False, fallback=1, fresh=False):
        self.size, self.bold, self.hidden, self.fallback, self.fresh = size, bold, hidden, fallback, fresh

    def inner(self) -> _State:
        return _State(self.size, self.bold, self.hidden, self.fallback, True)


def rich_text_pieces(source: str) -> Iterator[tuple[str, int, bool]]:
    """Visible text in order with its size and weight."""
    state, outer, skip = _State(), [], 0
    for m in _LEX.finditer(source):
        kind = m.lastgroup
        if kind == "open":
            outer.append((state, skip))
            state = state.inner()
            continue
        if kind == "close":
            if outer:
                state, skip = outer.pop()
            continue
        shown = ""
        if kind == "text":
            plain = m["text"].replace("\r", "").replace("\n", "")
            if skip:  # what stands in for an escaped character elsewhere
                plain, skip = plain[skip:], max(0, skip - len(plain))
            shown = plain
            if m["text"].strip():
                state.fresh = False
        elif kind in ("byte", "symbol"):
            if skip:
                skip -= 1
                continue
            if kind == "byte":
                shown = bytes.fromhex(m["byte"]).decode("cp1252", "ignore")
            elif m["symbol"] == "*" and state.fresh:
                state.hidden = True
            else:
                shown = SYMBOLS.get(m["symbol"], "")
            if not (m["symbol"] or "x").isspace():
                state.fresh = False
        elif m["word"]:
            word, arg = m["word"], int(m["arg"]) if m["arg"] else None
            if state.fresh and word in HIDDEN_GROUPS:
                state.hidden = True
            state.fresh = False
            if word == "u" and arg is not None:
                shown, skip = chr(arg % 65536), state.fallback
            elif word == "uc" and arg is not None:
                state.fallback = max(0, arg)
            elif word == "fs" and arg is not None:
                state.size = arg
            elif word == "b":
                state.bold = arg is None or arg != 0
            elif word == "plain":
                state.size, state.bold = BODY_SIZE, False
            else:
                shown = SHOWN.get(word, "")
        if shown and not state.hidden:
            yield shown, state.size, state.bold


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", re.S | re.I)
_SIZES = {"h1": 36, "h2": 32, "h3": 28, "h4": 26}
_LINE_TAGS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 ul ol table section article nav header footer".split())


def page_pieces(source: str) -> Iterator[tuple[str, int, bool]]:
    """The same for web pages: headings are larger, b and strong are bold."""
    size, bold, at = BODY_SIZE, 0, 0

    def shown(part: str):
        text = re.sub(r"\s+", " ", unescape(part))
        return [(text, size, bold > 0)] if text.strip() else []

    for m in _TAG.finditer(source):
        yield from shown(source[at : m.start()])
        at = m.end()
        tag, closing = (m[3] or "").lower(), m[2] == "/"
        if tag in _SIZES:
            size = BODY_SIZE if closing else _SIZES[tag]
        if tag in ("b", "strong"):
            bold = max(0, bold + (-1 if closing else 1))
        if tag in _LINE_TAGS:
            yield "\n", size, bold > 0
    yield from shown(source[at:])


def merged(pieces: Iterator[tuple[str, int, bool]]) -> list[dict]:
    """Neighbours of one format joined, each run once."""
    out: list[tuple[list[str], int, bool]] = []
    for text, size, bold in pieces:
        if out and out[-1][1:] == (size, bold):
            out[-1][0].append(text)
        else:
            out.append(([text], size, bold))
    return [{"text": _paired("".join(t)), "font_size": s, "bold": b} for t, s, b in out]


def _paired(text: str) -> str:
    """Escapes give characters beyond 16 bits in halves; a half alone is no character."""
    if not re.search("[\ud800-\udfff]", text):
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def rich_text(source: str) -> str:
    """Plain text with tidy white space."""
    text = "".join(p[0] for p in rich_text_pieces(source)).replace("\r", "\n")
    for pattern, to in ((r"\n{3,}", "\n\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " ")):
        text = re.sub(pattern, to, text)
    return text.strip()


def spans(files: DataFrame, column: str = "content", kind: str = "rich_text") -> DataFrame:
    """files: file and a text column.  file, span_no, text, font_size, bold."""
    reader = {"rich_text": rich_text_pieces, "page": page_pieces}[kind]

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([merged(reader(t or "")) for t in batch], dtype=object)

    found = files.select("file", F.pandas_udf(of, SPANS)(column).alias("s"))
    return found.select("file", F.posexplode("s").alias("span_no", "x")).select(
        "file", "span_no", "x.text", "x.font_size", "x.bold"
    )


def _escaped(c: Column) -> Column:
    """A character as rich text writes it."""
    code = F.ascii(c)
    unit = lambda n: F.concat(F.lit("\\u"), F.when(n > 32767, n - 65536).otherwise(n).cast("string"), F.lit("?"))
    over = code - 65536
    return (
        F.when(c.isin("\\", "{", "}"), F.concat(F.lit("\\"), c))
        .when(c == "\n", F.lit("\\par ")).when(c == "\t", F.lit("\\tab ")).when(c == "\r", F.lit("\\'0d"))
        .when(code > 65535, F.concat(unit(F.lit(0xD800) + F.shiftright(over, 10)), unit(F.lit(0xDC00) + over.bitwiseAND(1023))))
        .when(code > 127, unit(code)).otherwise(c)
    )


def as_rich_text(spans: DataFrame) -> DataFrame:
    """spans: file, span_no, text, font_size, bold.  file and content: one rich text
    each, which reads back as these spans, neighbours of one format joined."""
    text = F.array_join(F.transform(F.split("text", ""), _escaped), "")
    mark = F.concat(F.lit("{\\fs"), F.col("font_size").cast("string"), F.when(F.col("bold"), "\\b ").otherwise("\\b0 "), text, F.lit("}"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("span_no", mark.alias("m")))), lambda s: s["m"])
    whole = F.concat(F.lit("{\\rtf1\\ansi\\uc1{\\fonttbl{\\f0 Serif;}}"), F.array_join(parts, ""), F.lit("}"))
    return spans.groupBy("file").agg(whole.alias("content"))
