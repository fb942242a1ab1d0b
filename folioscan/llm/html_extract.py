"""HTML extraction by minimum-cut labelling.

A page is read into text blocks and the elements around them.  Blocks and
elements are the nodes of a graph.  A small linear classifier gives each node its
costs of being called content and of being called boilerplate, the capacities to
source and sink: blocks by their length, links and sentences, elements by their
tag and names.  Smoothness edges tie each block to its element, each element to
its parent, and neighbouring blocks to each other, weaker with their distance in
the document tree.  The maximum flow separates the article from the rest, so
that short lines stay with their article, long comments go with their section,
and an element whose name misleads is outvoted by the text inside it.

Names are read as words: `has-sidebar`, `comments-enabled` and the like say
nothing, and an element around the article itself (a wrapper, a form around the
page) is not boilerplate whatever it is called.

Reading is linear in the length of the page, also for elements nested without
end, tags and quotes left open, and end tags without a start.

Defined results: null, empty and textless pages give an empty text; broken
markup is read as browsers' tokenizers do, with unclosed elements open to the
end; a tag left open at the end of the page is dropped; repeated rows repeat;
extra columns stay as they are, but one with the name given for the result gives
way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is never shown, or is the value of a form control.
HIDDEN = frozenset("script style noscript template head title desc metadata iframe object canvas audio video select option datalist textarea annotation annotation-xml".split())
#: Elements that may stand in a head; any other ends an open one.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption li dd dt option optgroup legend summary html body".split())
#: Elements that are boilerplate by their tag.
CHROME = frozenset("nav footer aside menu dialog form fieldset header".split())
#: Words of class and id names (fixed lists; a final * stands for any ending).
BAD_WORDS = (
    "ad ads advert* adsense sponsor* promo* banner cookie* consent gdpr popup modal overlay nav* menu* breadcrumb* sidebar* "
    "footer header masthead topbar toolbar comment comments commentlist respond disqus replies share sharing social related "
    "recommend* newsletter subscribe signup widget* pagination pager copyright disclaimer"
).split()
#: These alone are boilerplate; in a longer name they count less.
SOFT_WORDS = "side foot notice alert tag tags legal skip form search login discussion".split()
GOOD_WORDS = "article* post posting entry content main story text body".split()
#: A name with one of these tells of something else than its element's content.
QUALIFIERS = frozenset("has with no not without is are enabled disabled open closed active on off count layout".split())
ROLES = {
    "navigation": False, "complementary": False, "contentinfo": False, "banner": False, "search": False, "dialog": False,
    "alert": False, "alertdialog": False, "menu": False, "menubar": False, "form": False, "main": True, "article": True,
}
#: Bits of the classifier (positive: content) ...
B_BASE, B_LINKS, B_LONG, B_STOPS, B_SHORT, B_TITLE = -0.5, -5.0, 2.0, 1.0, -0.5, 2.0
E_SOFT, E_GOOD, E_MAIN, E_BUTTON = -2.5, 2.0, 4.0, -1.0
#: ... an element with strong evidence carries it for each of its blocks ...
E_STRONG, E_PER_BLOCK = 6.0, 8.0
#: ... and bits of the ties.
T_BLOCK, T_STRONG, T_PARENT, T_NAMED, T_NEXT, ACROSS = 0.8, 8.0, 1.0, 0.5, 0.5, 0.1
#: Elements that hold more of a page than this are wrappers where no article,
#: main element or first-level heading tells.
WRAPS = 0.6
FAR = 16

STOP = re.compile(r"[.!?…][\"'»”)]?(?:\s|$)")
TAG = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s/>="'<][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
#: One step inside a tag: white space, an attribute, or a stray character.
STEP = re.compile(r"""[\s/]+|[^\s/>=][^\s/>=]*(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?|=""")
NAMED = re.compile(r"\b(?:class|id|role|hidden|style|itemprop)\b", re.I)
#: Elements whose content is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in "script style title textarea iframe noembed noframes xmp".split()}
#: What an item of these kinds closes, and where the search for it ends.
ITEMS = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)),
}


def _words(names: list[str]) -> re.Pattern:
    return re.compile("|".join(n[:-1] + r"\w*" if n[-1] == "*" else n for n in names))


_BAD, _SOFT, _GOOD = _words(BAD_WORDS), _words(SOFT_WORDS), _words(GOOD_WORDS)
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


def _name_evidence(name: str) -> tuple[float, bool]:
    """Bits and whether they are strong, of one word of a class or id."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    if not parts or QUALIFIERS & set(parts):
        return 0.0, False
    bad = [x for x in parts if _BAD.fullmatch(x)]
    good = any(_GOOD.fullmatch(x) for x in parts)
    if bad and not (good and set(bad) == {"header"}):
        return -E_STRONG, True
    if any(_SOFT.fullmatch(x) for x in parts):
        return (-E_STRONG, True) if len(parts) == 1 else (0.0 if good else E_SOFT, False)
    return (E_GOOD, False) if good else (0.0, False)


@lru_cache(4096)
def _attributes(raw: str) -> tuple[float, bool, bool]:
    """Evidence of an element's names, whether it is strong, and whether they
    name the main part of the page."""
    found = {k.lower(): v.strip("\"'") for k, v in reversed(ATTRIBUTE.findall(raw))}
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or "display:none" in style or found.get("aria-hidden") == "true":
        return -E_STRONG, True, False
    role = ROLES.get(found.get("role", "").strip().lower())
    if role is not None:
        return (E_MAIN, False, True) if role else (-E_STRONG, True, False)
    rated = [_name_evidence(x) for k in ("class", "id") if found.get(k) for x in unescape(found[k]).split()]
    main = "articlebody" in found.get("itemprop", "").lower()
    if any(strong for _, strong in rated):
        return -E_STRONG, True, main
    return max(-E_STRONG, min(E_MAIN, sum(x for x, _ in rated) + E_MAIN * main)), False, main


class Element:
    __slots__ = ("tag", "up", "depth", "bits", "strong", "main", "region")

    def __init__(self, tag: str, up: int, depth: int, bits: float, strong: bool, main: bool):
        self.tag, self.up, self.depth, self.bits, self.strong, self.main = tag, up, depth, bits, strong, main


class Block:
    __slots__ = ("parts", "element", "links", "heading", "text")

    def __init__(self, element: int, heading: str):
        self.parts: list[str] = []
        self.element, self.heading = element, heading
        self.links, self.text = 0, ""


class _Reader:
    def __init__(self):
        self.elements: list[Element] = [Element("", -1, 0, 0.0, False, False)]
        # open elements as (tag, number of the element), and per tag its places in that stack
        self.open: list[tuple[str, int]] = [("", 0)]
        self.at: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []
        self.hidden = 0
        self.in_link = 0
        self.loose = False
        self.blocks: list[Block] = []
        self.now: Block | None = None

    def feed(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            start = html.find("<", at)
            # a < that begins no tag is text
            while start >= 0 and not (html[start + 1 : start + 2] in "!?/" or TAG.match(html, start + 1)):
                start = html.find("<", start + 1)
            if start < 0 or start + 1 >= n:
                self.text(html[at:])
                return
            if start > at:
                self.text(html[at:start])
            kind = html[start + 1]
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                at = n if end < 0 else end + 3
                continue
            if kind in "!?/":
                end = html.find(">", start)
                at = n if end < 0 else end + 1
                name = TAG.match(html, start + 2) if kind == "/" and end > 0 else None
                if name:
                    self.end(name[0].lower())
                continue
            name = TAG.match(html, start + 1)
            tag, begin = name[0].lower(), name.end()
            end = self._tag_end(html, begin)
            if end < 0:
                return  # a tag that the page does not end
            at = end + 1
            self._leave_head(tag)
            if tag in RAW:
                close = RAW[tag].search(html, at)
                at = close.end() if close else n
                continue
            self.start(tag, html[begin:end])

    def _tag_end(self, html: str, begin: int) -> int:
        """Place of the > that ends the tag; quoted values may hold one.  Once a
        quote of the page is left open, tags end at their next >."""
        end = html.find(">", begin)
        if end < 0 or self.loose:
            return end
        if html.count('"', begin, end) % 2 == 0 and html.find("'", begin, end) < 0:
            return end
        at = begin
        while m := STEP.match(html, at):
            at = m.end()
        if html[at : at + 1] == ">":
            return at
        self.loose = True
        return end

    def _close_to(self, at: int) -> None:
        for tag, _ in reversed(self.open[at:]):
            self.at[tag].pop()
            if tag in BLOCK:
                self.open_blocks.pop()
            self.hidden -= tag in HIDDEN
            self.in_link -= tag == "a"
        del self.open[at:]

    def _last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _leave_head(self, tag: str) -> None:
        """The end tag of a head may be left out."""
        head = self.at.get("head")
        if head and not self.at.get("template") and (tag == "body" or (self.open[-1][0] == "head" and tag not in IN_HEAD)):
            self._close_to(head[0])

    def start(self, tag: str, raw: str) -> None:
        if tag == "head" and self.at.get("head"):
            return
        if tag == "br":
            if self.now is not None:
                self.now.parts.append(" ")
            return
        block = tag in BLOCK
        if block:
            self.now = None
        if tag in VOID:
            return
        if block and tag in ENDS_P and self.open_blocks and self.open[self.open_blocks[-1]][0] == "p":
            # inline elements left open in the paragraph end with it
            self._close_to(self.open_blocks[-1])
        if tag in ITEMS:
            same, stop = ITEMS[tag]
            if self._last(*same) > self._last(*stop):
                self._close_to(self._last(*same))
        bits, strong, main = (0.0, False, False)
        if raw and tag not in ("html", "body") and NAMED.search(raw):
            bits, strong, main = _attributes(raw)
        if tag == "article" or tag == "main":
            bits, strong, main = (E_STRONG if tag == "article" else E_MAIN), tag == "article", True
        elif tag in CHROME and not (tag == "header" and self.at.get("article")):
            bits, strong = -E_STRONG, True
        elif tag == "button" and not strong:
            bits = min(bits, E_BUTTON)
        self.at.setdefault(tag, []).append(len(self.open))
        number = self.open[-1][1]
        if block or bits:
            up = number
            number = len(self.elements)
            self.elements.append(Element(tag, up, self.elements[up].depth + 1, bits, strong, main))
        if block:
            self.open_blocks.append(len(self.open))
        self.open.append((tag, number))
        self.hidden += tag in HIDDEN
        self.in_link += tag == "a"

    def end(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self.now = None
        at = self._last(tag)
        # inline elements do not end across the border of a block
        if at and (block or not self.open_blocks or at > self.open_blocks[-1]):
            self._close_to(at)

    def text(self, data: str) -> None:
        if self.at.get("head") and data.strip():
            self._leave_head("")
        if self.hidden > 0:
            return
        if "&" in data:
            data = unescape(data)
        if self.now is None:
            if not data.strip():
                return
            heading = next((h for h in HEADINGS if self.at.get(h)), "")
            self.now = Block(self.open[-1][1], heading)
            self.blocks.append(self.now)
        self.now.parts.append(data)
        if self.in_link > 0:
            self.now.links += len(data.strip())


def read_page(html: str | None) -> tuple[list[Block], list[Element]]:
    reader = _Reader()
    reader.feed(html or "")
    for b in reader.blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in reader.blocks if b.text], reader.elements


def block_bits(b: Block) -> float:
    """Log odds of content, by the block alone."""
    n = len(b.text)
    bits = B_BASE + B_LINKS * min(1.0, b.links / n)
    bits += B_LONG * (n >= 80) + B_LONG * (n >= 250) + B_STOPS * bool(STOP.search(b.text))
    if b.heading:
        return bits + B_TITLE * (b.heading == "h1")
    return bits + B_SHORT * (n < 25)


def minimum_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of the minimum cut.  Terminal capacities are the
    scores (their sign says which terminal); ties are undirected edges.  Flow is
    pushed in rounds: each levels the nodes by their distance from those with
    flow to spare and fills every shortest way, so long pages take few rounds."""
    n = len(scores)
    if max(scores, default=0.0) <= 0:  # nothing flows
        return [False] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, w in ties:
        near[u][v] = near[u].get(v, 0.0) + w
        near[v][u] = near[v].get(u, 0.0) + w
    ends = [list(d) for d in near]
    spare = [max(0.0, s) for s in scores]
    room = [max(0.0, -s) for s in scores]
    eps = 1e-9
    while True:
        level = [0 if x > eps else -1 for x in spare]
        sources = [u for u in range(n) if level[u] == 0]
        todo, open_end = list(sources), False
        for u in todo:
            open_end = open_end or room[u] > eps
            for v, w in near[u].items():
                if w > eps and level[v] < 0:
                    level[v] = level[u] + 1
                    todo.append(v)
        if not open_end:
            return [x >= 0 for x in level]
        arc = [0] * n
        for source in sources:
            way = [source]
            while spare[source] > eps:
                u = way[-1]
                if room[u] > eps:
                    steps = list(zip(way, way[1:], strict=False))
                    push = min([spare[source], room[u], *[near[a][b] for a, b in steps]])
                    spare[source] -= push
                    room[u] -= push
                    for a, b in steps:
                        near[a][b] -= push
                        near[b][a] += push
                    way = [source]
                elif arc[u] < len(ends[u]):
                    v = ends[u][arc[u]]
                    if level[v] == level[u] + 1 and near[u][v] > eps:
                        way.append(v)
                    else:
                        arc[u] += 1
                elif len(way) > 1:
                    way.pop()
                    arc[way[-1]] += 1
                else:
                    break


def _sums(blocks: list[Block], elements: list[Element]) -> tuple[list[int], list[int]]:
    """Blocks and characters inside each element."""
    count, chars = [0] * len(elements), [0] * len(elements)
    for b in blocks:
        count[b.element] += 1
        chars[b.element] += len(b.text)
    for k in range(len(elements) - 1, 0, -1):
        count[elements[k].up] += count[k]
        chars[elements[k].up] += chars[k]
    return count, chars


def _wrappers(blocks: list[Block], elements: list[Element], chars: list[int]) -> set[int]:
    """Elements around the article: their names say nothing against it."""

    def around(k: int) -> Iterator[int]:
        while k > 0:
            yield k
            k = elements[k].up

    # nearest element above that tells against its content
    above = [0] * len(elements)
    for k in range(1, len(elements)):
        up = elements[k].up
        above[k] = up if elements[up].bits < 0 else above[up]
    titles = {b.element for b in blocks if b.heading == "h1"}
    titled = {k for t in titles for k in around(t)}
    best, found = (), 0
    for k, e in enumerate(elements):
        if e.main and chars[k]:
            outer = above[k]
            while outer and outer in titled:
                outer = above[outer]
            if outer and titles:  # the title is elsewhere: this is no wrapper of the article
                continue
            rank = (not above[k], k in titled, chars[k])
            if rank > best:
                best, found = rank, k
    if found:
        return set(around(found)) - {found}
    chrome = {"nav", "footer", "aside"}
    for b in blocks:
        if b.heading == "h1" and not any(elements[k].tag in chrome for k in around(b.element)):
            return set(around(b.element))
    return {k for k in range(1, len(elements)) if chars[k] > WRAPS * max(1, chars[0])}


def build_graph(blocks: list[Block], elements: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Scores of the nodes (blocks, then elements) and the ties between them."""
    n = len(blocks)
    count, chars = _sums(blocks, elements)
    wrap = _wrappers(blocks, elements, chars)
    scores = [block_bits(b) for b in blocks]
    ties: list[tuple[int, int, float]] = []
    node: list[int] = []  # per element its node of the graph
    region: list[int] = []  # per element the nearest one with evidence
    bad: list[bool] = []  # inside an element that is boilerplate by itself
    bits: list[float] = []
    for k, e in enumerate(elements):
        up = e.up
        own, strong = e.bits, e.strong
        if own < 0 and k in wrap:
            own, strong = 0.0, False
        if k and bad[up] and own > 0:
            own, strong = 0.0, False
        bits.append(own if strong else 0.0)
        bad.append((k > 0 and bad[up]) or (strong and own < 0))
        region.append(k if own or not k else region[up])
        alone = k and not own and count[k] == 1
        if not k or (count[k] and not alone and (own or not bits[region[up]])):
            node.append(len(scores))
            scores.append(own + (E_PER_BLOCK * count[k] if own > 0 else -E_PER_BLOCK * count[k]) if strong else own)
            if k and count[k]:
                ties.append((node[up], node[k], T_NAMED if own else T_PARENT))
        else:  # unnamed parts of a strong element are one with it
            node.append(node[up])
    for b, i in zip(blocks, range(n), strict=True):
        ties.append((i, node[b.element], T_STRONG if bits[region[b.element]] else T_BLOCK))
        if i:
            x, y = blocks[i - 1].element, b.element
            across = ACROSS if region[x] != region[y] else 1.0
            steps = 0
            while x != y and steps < FAR:
                if elements[x].depth >= elements[y].depth:
                    x = elements[x].up
                else:
                    y = elements[y].up
                steps += 1
            ties.append((i - 1, i, across * T_NEXT / max(1.0, steps / 2)))
    return scores, ties


def label_blocks(blocks: list[Block], elements: list[Element]) -> list[bool]:
    scores, ties = build_graph(blocks, elements)
    return minimum_cut(scores, ties)[: len(blocks)]


def main_text(html: str | None) -> str:
    blocks, elements = read_page(html)
    if not blocks:
        return ""
    keep = label_blocks(blocks, elements)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def _texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([main_text(h) for h in batch], dtype=object)


def extract(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """pages with a column of main texts."""
    return pages.withColumn(name, F.pandas_udf(_texts, "string").asNondeterministic()(column))
