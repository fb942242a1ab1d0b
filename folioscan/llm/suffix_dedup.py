"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a
document with a smaller doc_id are removed.

Distribution.  Every 50-byte window has an anchor, the smallest hash of its
16-byte grams, which depends on the window's bytes alone, so equal windows have
equal anchors wherever they stand.  Neighbouring windows with one anchor form a
run, a string of 50 to 84 bytes.  Runs go to buckets by anchor, as packed
arrays; equal runs of a chunk of texts count once.  Two runs that share a window
agree on 34 bytes around the anchor's gram, so on 17 before it or on 18 after it:
runs are shared if another document has a run of the same anchor and the same 17
bytes or the same 18.  The anchor alone would not do: with the corpus nearly every
16 bytes come to stand in a second document.

Decision.  Each bucket builds the suffix array and the Burrows-Wheeler transform
of its distinct shared runs.  Breadth-first backward extension derives the
common prefixes by increasing value: the rows that share a string w, extended
backward by a symbol c, are the rows of cw, so a boundary of value v between two
rows becomes a boundary of value v + 1 where their c-predecessors land.  It
stops at the minimum length; rows that no boundary divides then share at least
that prefix, and the smallest doc_id of such an interval decides its windows.

Equal texts are one text with its smallest doc_id beforehand, so groups of
copies of any size cost one row per partition.

Defined results: null and empty texts have no bytes; documents with a null
doc_id neither lose bytes nor take any; repeated rows (equal doc_id) do not take
bytes from each other; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, scratch_path

MIN_LENGTH = 50
GRAM = 16
#: Windows agree on so many bytes before the gram, or on one more after it.
SIDE = (MIN_LENGTH - GRAM) // 2
_24 = np.uint64((1 << 24) - 1)
#: Bytes of text per chunk and per bucket; sub-batches keep the arrays small.
CHUNK_BYTES = 8_000_000
BATCH_BYTES = 200_000
#: Spark's own limit on the buckets of a table.
MAX_BUCKETS = 100_000
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_48 = np.uint64((1 << 48) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _extremes(values: np.ndarray, per: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `per` neighbours."""
    n = 1
    while 2 * n <= per:
        values = pick(values[:-n], values[n:])
        n *= 2
    return pick(values[: len(values) - (per - n)], values[per - n :]) if per > n else values


def _sides(hashes: dict, grams: np.ndarray, least: np.ndarray, s: np.ndarray, count: np.ndarray, anchor: np.ndarray):
    """24 bits of the SIDE bytes before the anchor's gram of each run and of the
    SIDE + 1 after it, 0 where the run does not reach so far; both are 0 if the gram
    stands in the run more than once."""
    per = len(grams) - len(least) + 1
    # grams that are the least of some window: the most of the least around them is their own
    edge = np.zeros(per - 1, dtype=np.uint64)
    most = _extremes(np.concatenate([edge, least, edge]), per, np.maximum)
    places = np.flatnonzero(most == grams)
    k, last = np.searchsorted(places, s), s + count + per - 2
    at, times = np.full(len(s), -1, dtype=np.int64), np.zeros(len(s), dtype=np.int64)
    open_ = np.arange(len(s))
    while len(open_):
        open_ = open_[k[open_] < len(places)]
        open_ = open_[places[k[open_]] <= last[open_]]
        q = places[k[open_]]
        hit = grams[q] == anchor[open_]
        at[open_[hit]] = q[hit]
        times[open_[hit]] += 1
        k[open_] += 1
        open_ = open_[times[open_] < 2]
    one = times == 1
    end = s + count + MIN_LENGTH - 1
    left, right = np.zeros(len(s), dtype=np.uint64), np.zeros(len(s), dtype=np.uint64)
    i = np.flatnonzero(one & (at - s >= SIDE))
    p = at[i] - SIDE
    left[i] = np.maximum(_mixed(hashes[GRAM][p] * _power(1) + hashes[1][p + GRAM]) & _24, np.uint64(1))
    i = np.flatnonzero(one & (at + GRAM + SIDE + 1 <= end))
    p = at[i] + GRAM
    right[i] = np.maximum(_mixed(hashes[GRAM][p] * _power(2) + hashes[2][p + GRAM]) & _24, np.uint64(1))
    return left, right


def text_runs(data: np.ndarray, offsets: np.ndarray, length: int = MIN_LENGTH, gram: int = GRAM, sides: bool = False):
    """Runs of several texts that lie one after the other in data: text number,
    first byte in data, number of windows, anchor and string hash (48 bits each);
    with sides also what _sides tells.  Texts start at offsets[:-1]."""
    per = length - gram + 1
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    total = int(windows.sum())
    if not total:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, *[empty.astype(np.uint64)] * (4 if sides else 2)
    hashes = {1: data.astype(np.uint64) + np.uint64(1)}
    n = 1
    while n < 2 * gram:
        h = hashes[n]
        hashes[2 * n] = h[:-n] * _power(n) + h[n:]
        n *= 2
    grams = _mixed(hashes[gram])
    least = _extremes(grams, per, np.minimum)
    text = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    at = np.arange(total) + np.repeat(offsets[:-1] - first, windows)
    anchor = least[at]
    new = np.ones(total, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, total))
    if (count > per).any():  # a repeated anchor: cut into pieces
        pieces = -(-count // per)
        base = np.repeat(begin, pieces)
        k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        rest = np.repeat(count, pieces) - k * per
        begin, count = base + k * per, np.minimum(rest, per)
    s, size = at[begin], count + length - 1
    wide = hashes[2 * gram]
    span = 2 * gram
    digest = (
        wide[s] * _M1
        + wide[s + size - span] * _M2
        + wide[s + np.minimum(26, size - span)] * _M3
        + size.astype(np.uint64)
    )
    found = text[begin], s, count, _mixed(anchor[begin] * _M3) & _48, _mixed(digest) & _48
    return (*found, *_sides(hashes, grams, least, s, count, anchor[begin])) if sides else found


# --- packed columns: byte planes, so that small numbers compress ------------


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    n = len(columns[0][0])
    out = [np.int64(n).tobytes()]
    for values, width in columns:
        planes = np.ascontiguousarray(values).astype(np.int64, copy=False) if values.dtype != np.uint64 else values
        out.append(np.ascontiguousarray(planes.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return b"".join(out)


def _unpack(data: bytes, widths: tuple[int, ...]) -> tuple[list[np.ndarray], int]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8, []
    for width in widths:
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        full = np.zeros((n, 8), dtype=np.uint8)
        full[:, :width] = planes.T
        out.append(full.view(np.int64).ravel())
        at += n * width
    return out, at


def _all(table: pa.Table, name: str, widths: tuple[int, ...]) -> list[np.ndarray]:
    parts = [_unpack(x, widths)[0] for x in table.column(name).to_pylist()]
    if not parts:
        return [np.zeros(0, dtype=np.int64) for _ in widths]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _batches(table: pa.Table, length: int = MIN_LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, row of each text, its first byte in that row's text) of
    about BATCH_BYTES.  A longer text comes in segments that overlap by less than
    a window, so that each of its windows is in one segment."""
    texts = table.column("text").cast(pa.binary())
    waiting: list[tuple[int, int, bytes]] = []
    held = 0

    def out():
        sizes = [len(x) for _, _, x in waiting]
        where = np.array([w[:2] for w in waiting], dtype=np.int64).reshape(-1, 2)
        data = np.frombuffer(b"".join(x for _, _, x in waiting), np.uint8)
        return data, np.concatenate([[0], np.cumsum(sizes)]), where[:, 0], where[:, 1]

    for row, value in enumerate(texts):
        raw = value.as_py() or b""
        for at in range(0, max(1, len(raw) - length + 1), BATCH_BYTES):
            part = raw[at : at + BATCH_BYTES + length - 1]
            if waiting and held + len(part) > BATCH_BYTES:
                yield out()
                waiting, held = [], 0
            waiting.append((row, at, part))
            held += len(part)
    if waiting:
        yield out()


def _grouped(order_keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by the keys (the last is the main one), and the starts of
    the groups with equal values of all keys but the first."""
    order = np.lexsort(order_keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for k in order_keys[1:]:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


# --- step 1: runs of a chunk, by bucket -------------------------------------


def _entries(n_buckets: int):
    def of(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        least = table.column("least").to_numpy()
        found = []
        for data, offsets, row, _ in _batches(table):
            text, _, _, anchor, digest, left, right = text_runs(data, offsets, sides=True)
            found.append((anchor, digest, least[row[text]], left, right))
        anchor, digest, doc, left, right = (np.concatenate(c) for c in zip(*found, strict=True))
        order, start = _grouped((doc, digest, anchor))
        doc = doc[order]
        last = doc[np.append(start[1:], len(doc)) - 1] if len(start) else doc
        anchor, digest, left, right = (c[order][start] for c in (anchor, digest, left, right))
        doc = doc[start]
        several = (last != doc).astype(np.int64)
        bucket = (anchor % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            i = by[edges[b] : edges[b + 1]]
            rows.append((int(b), chunk, _pack((anchor[i], 6), (digest[i], 6), (doc[i], 8), (several[i], 1), (left[i], 3), (right[i], 3))))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table(
            {"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "data": pa.array(cols[2], pa.binary())}
        )

    return of


# --- step 2: which runs are shared ------------------------------------------


def _in_two(doc: np.ndarray, several: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which rows have keys that two documents or more have."""
    ok = np.zeros(len(doc), dtype=bool)
    order, start = _grouped((doc, *keys))
    if len(order):
        end = np.append(start[1:], len(order)) - 1
        two = (doc[order][start] != doc[order][end]) | (np.maximum.reduceat(several[order], start) > 0)
        ok[order[np.repeat(two, end - start + 1)]] = True
    return ok


def _shared(table: pa.Table) -> pa.Table:
    """Requests to chunks (each distinct shared run once, to a chunk of its
    smallest doc_id) and the list of chunks that hold each shared run."""
    bucket = table.column("bucket")[0].as_py()
    sizes = [int(np.frombuffer(x, np.int64, 1)[0]) for x in table.column("data").to_pylist()]
    chunk = np.repeat(table.column("chunk").to_numpy().astype(np.int64), sizes)
    anchor, digest, doc, several, left, right = _all(table, "data", (6, 6, 8, 1, 3, 3))
    # anchors that stand once can't be shared
    _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
    keep = np.flatnonzero((count[inverse] > 1) | (several > 0))
    anchor, digest, doc, several, chunk, left, right = (c[keep] for c in (anchor, digest, doc, several, chunk, left, right))
    # of an anchor whose gram stands in some run more than once all runs are compared
    wild = np.isin(anchor, anchor[(left == 0) & (right == 0)])
    ok = _in_two(doc, several, anchor) & wild
    for side in (left, right):
        i = np.flatnonzero((side > 0) & ~wild)
        ok[i] |= _in_two(doc[i], several[i], side[i], anchor[i])
    anchor, digest, doc, chunk = (c[ok] for c in (anchor, digest, doc, chunk))
    order, start = _grouped((doc, digest, anchor))
    lead = order[start]
    kinds, to, data = [], [], []
    asked = lead[np.argsort(chunk[lead], kind="stable")]
    homes, edges = np.unique(chunk[asked], return_index=True)
    for k, i in zip(homes, np.split(asked, edges[1:]), strict=True) if len(asked) else ():
        kinds.append(0)
        to.append(int(k))
        data.append(_pack((anchor[i], 6), (digest[i], 6), (doc[i], 8)))
    if len(anchor):
        kinds.append(1)
        to.append(bucket)
        data.append(_pack((anchor, 6), (digest, 6), (chunk, 4)))
    return pa.table(
        {"kind": pa.array(kinds, pa.int32()), "place": pa.array(to, pa.int32()), "bucket": pa.array([bucket] * len(to), pa.int32()), "data": pa.array(data, pa.binary())}
    )


# --- step 3: the strings of the shared runs ---------------------------------


def _mix_key(anchor: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return anchor.astype(np.uint64) * _M1 ^ digest.astype(np.uint64) * _M2


class _Runs:
    """Finds runs by anchor and digest.  The search goes by a mix of both, and
    both are compared; keys whose mixes are equal are told apart."""

    def __init__(self, anchor: np.ndarray, digest: np.ndarray):
        mixed = _mix_key(anchor, digest)
        self.order = np.argsort(mixed, kind="stable")
        self.key = mixed[self.order]
        self.anchor, self.digest = anchor.astype(np.uint64), digest.astype(np.uint64)
        # the most keys that share one mix
        turns = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1], True])
        self.most = int(np.diff(turns).max()) if len(self.key) else 0

    def find(self, anchor: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """Place of each run among those given, -1 where it is none of them."""
        found = np.full(len(anchor), -1, dtype=np.int64)
        if not len(self.key):
            return found
        first = np.searchsorted(self.key, _mix_key(anchor, digest))
        for step in range(self.most):
            at = self.order[np.minimum(first + step, len(self.key) - 1)]
            same = (self.anchor[at] == anchor.astype(np.uint64)) & (self.digest[at] == digest.astype(np.uint64))
            found[same & (found < 0)] = at[same & (found < 0)]
        return found


def _strings(texts: pa.Table, requests: pa.Table) -> pa.Table:
    out: dict[int, list[bytes]] = {}
    if texts.num_rows and requests.num_rows:
        buckets = np.repeat(
            requests.column("bucket").to_numpy(),
            [int(np.frombuffer(x, np.int64, 1)[0]) for x in requests.column("data").to_pylist()],
        )
        anchor, digest, doc = _all(requests, "data", (6, 6, 8))
        runs = _Runs(anchor, digest)
        open_ = np.ones(len(anchor), dtype=bool)
        for data, offsets, _, _ in _batches(texts):
            _, s, count, a, h = text_runs(data, offsets)
            at = runs.find(a, h)
            hit = np.flatnonzero(at >= 0)
            which, first = np.unique(at[hit], return_index=True)
            fresh = open_[which]
            which, run = which[fresh], hit[first[fresh]]
            open_[which] = False
            for b, i, r in _by(buckets, which, run):
                size = count[r] + MIN_LENGTH - 1
                flat = data[np.repeat(s[r], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
                packed = _pack((anchor[i], 6), (digest[i], 6), (doc[i], 8), (size, 1))
                out.setdefault(b, []).append(packed + flat.tobytes())
    rows = [(b, x) for b, parts in out.items() for x in parts]
    return pa.table(
        {"bucket": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())}
    )


def _by(buckets: np.ndarray, which: np.ndarray, run: np.ndarray):
    order = np.argsort(buckets[which], kind="stable")
    homes, edges = np.unique(buckets[which][order], return_index=True)
    for b, part in zip(homes, np.split(order, edges[1:]), strict=True) if len(order) else ():
        yield int(b), which[part], run[part]


# --- step 4: interval expansion on the Burrows-Wheeler transform -------------


def suffix_array(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of at least their first `length` symbols (below
    512), by prefix doubling from the first 7 on.  Suffixes that are equal so far
    stay in any order: nothing below divides them."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, dtype=np.int64)])
    key = padded[:n].copy()
    for j in range(1, 7):
        key <<= 9
        key |= padded[j : j + n]
    order = np.argsort(key)
    place = np.arange(n)
    new = np.ones(n, dtype=bool)
    sorted_key = key[order]
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    h = 7
    while h < length and not new.all():
        tied = ~new
        tied[:-1] |= tied[1:]
        slots = np.flatnonzero(tied)
        rows = order[slots]
        both = rank[rows] * n + rank[np.minimum(rows + h, n - 1)]
        o = np.argsort(both)
        rows, both = rows[o], both[o]
        order[slots] = rows
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = both[1:] != both[:-1]
        new[slots] = fresh
        rank[rows] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2
    return order


def interval_expansion(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and for each of its rows the number of the interval of rows
    that share a prefix of at least `length` symbols.

    Level v sets the boundaries of value v.  Rows alone in their interval that no
    open boundary comes from leave the arrays every few levels, so the work
    follows what is still shared."""
    rows = suffix_array(symbols, length)
    bwt = symbols[rows - 1]
    n = len(rows)
    # place t of the first column comes from row back[t]: the LF mapping
    back = np.argsort(bwt, kind="stable")
    divided = np.ones(n, dtype=bool)
    divided[1:] = bwt[back[1:]] != bwt[back[:-1]]  # value 0: the first symbols differ
    open_ = np.flatnonzero(~divided)
    left, right = back[open_ - 1], back[open_]
    edge, at = divided.copy(), np.arange(n)
    for level in range(length - 1):
        if not len(open_):
            break
        seen = np.cumsum(edge, dtype=np.int32)
        # extending backward: rows t-1 and t are divided one symbol later than
        # the rows they come from
        now = seen[right] > seen[left]
        if not now.any():
            break
        edge[open_[now]] = True
        rest = ~now
        open_, left, right = open_[rest], left[rest], right[rest]
        if level % 4 == 3:
            alone = edge.copy()
            alone[:-1] &= edge[1:]
            divided[at] = edge
            keep = ~alone
            keep[left] = keep[right] = True  # an open boundary still asks for them
            place = np.cumsum(keep, dtype=np.int64) - 1
            open_, left, right = place[open_], place[left], place[right]
            edge, at = edge[keep], at[keep]
    divided[at] = edge
    return rows, np.cumsum(divided) - 1


def window_minima(sizes: np.ndarray, flat: np.ndarray, doc: np.ndarray, length: int = MIN_LENGTH):
    """Of every window of the strings (in order) the smallest doc of all strings
    that hold an equal window."""
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    # each string is followed by the separator 1, the whole by 0
    symbols = np.ones(n + len(sizes) + 1, dtype=np.int16)
    symbols[-1] = 0
    starts = ends - sizes + np.arange(len(sizes))
    symbols[np.arange(n) + np.repeat(np.arange(len(sizes)), sizes)] = flat.astype(np.int16) + 2
    rows, interval = interval_expansion(symbols, length)
    windows = sizes - length + 1
    at = np.arange(int(windows.sum())) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    value = np.full(len(symbols), np.iinfo(np.int64).max)
    value[at] = np.repeat(doc, windows)
    edges = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    least = np.minimum.reduceat(value[rows], edges)
    value[rows] = least[interval]
    return value[at], windows


def _decide(strings: pa.Table, shared: pa.Table) -> pa.Table:
    """For every shared run the smallest doc of each window, as pieces (windows,
    doc) of equal values, sent to each chunk that holds the run."""
    empty = {"chunk": pa.array([], pa.int32()), "data": pa.array([], pa.binary())}
    parts = []
    for x in strings.column("data").to_pylist() if strings.num_rows else []:
        (a, h, d, size), at = _unpack(x, (6, 6, 8, 1))
        parts.append((a, h, d, size, np.frombuffer(x, np.uint8, int(size.sum()), at)))
    if not parts:
        return pa.table(empty)
    anchor, digest, doc, size, flat = (np.concatenate(c) for c in zip(*parts, strict=True))
    begin = np.cumsum(size) - size
    order = np.lexsort((digest, anchor))
    anchor, digest, doc, size, begin = (c[order] for c in (anchor, digest, doc, size, begin))
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    ends = np.append(new[1:], len(anchor))
    upto = np.cumsum(size)
    piece_n, piece_doc, piece_of = [], [], []
    i = 0
    while i < len(new):  # anchors are independent: batches of whole anchors
        base = upto[new[i]] - size[new[i]]
        j = max(i + 1, int(np.searchsorted(upto[ends - 1], base + BATCH_BYTES, "right")))
        a, b = new[i], ends[j - 1]
        s = size[a:b]
        text = flat[np.repeat(begin[a:b] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))]
        value, windows = window_minima(s, text, doc[a:b])
        run = np.repeat(np.arange(a, b), windows)
        cut = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (value[1:] != value[:-1])])
        piece_of.append(run[cut])
        piece_n.append(np.diff(np.append(cut, len(run))))
        piece_doc.append(value[cut])
        i = j
    of, number, least = (np.concatenate(c) for c in (piece_of, piece_n, piece_doc))
    pieces = np.bincount(of, minlength=len(anchor))
    first = np.cumsum(pieces) - pieces
    # fan out to the chunks
    a2, h2, chunk = _all(shared, "data", (6, 6, 4))
    at = _Runs(anchor, digest).find(a2, h2)
    at, chunk = at[at >= 0], chunk[at >= 0]
    o = np.argsort(chunk, kind="stable")
    at, chunk = at[o], chunk[o]
    homes, edges = np.unique(chunk, return_index=True)
    to, data = [], []
    for c, runs in zip(homes, np.split(at, edges[1:]), strict=True) if len(at) else ():
        n = pieces[runs]
        p = np.repeat(first[runs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        to.append(int(c))
        data.append(_pack((anchor[runs], 6), (digest[runs], 6), (n, 1)) + _pack((number[p], 1), (least[p], 8)))
    return pa.table({"chunk": pa.array(to, pa.int32()), "data": pa.array(data, pa.binary())})


# --- step 5: removing --------------------------------------------------------

RESULT = "sha string, least bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans binary"


def _merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of rows, overlapping and touching ones as one."""
    order = np.lexsort((end, begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    # ends so far, each row's above all of the rows before
    lift = row * (int(end.max()) + 1)
    upto = np.maximum.accumulate(end + lift)
    new = np.r_[True, begin[1:] + lift[1:] > upto[:-1]] | np.r_[True, row[1:] != row[:-1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], begin[first], upto[last] - lift[last]


def _remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
    n = texts.num_rows
    removed, spans, kept = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [None] * n
    where: list[bytes | None] = [None] * n
    parts = []
    for x in answers.column("data").to_pylist() if answers.num_rows else []:
        (a, h, k), at = _unpack(x, (6, 6, 1))
        (num, doc), _ = _unpack(x[at:], (1, 8))
        parts.append((a, h, k, num, doc))
    if parts and n:
        least = texts.column("least").to_numpy()
        anchor, digest, k, number, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
        first = np.cumsum(k) - k
        from_ = np.cumsum(number) - number
        from_ = from_ - np.repeat(from_[first], k)  # window of the run at which a piece begins
        runs = _Runs(anchor, digest)
        found = []
        for data, offsets, row, base in _batches(texts):
            text, s, _, a, h = text_runs(data, offsets)
            at = runs.find(a, h)
            hit = np.flatnonzero(at >= 0)
            n_p = k[at[hit]]
            p = np.repeat(first[at[hit]] - (np.cumsum(n_p) - n_p), n_p) + np.arange(int(n_p.sum()))
            of = np.repeat(hit, n_p)
            go = doc[p] < least[row[text[of]]]
            of, p = of[go], p[go]
            begin = s[of] + from_[p] - offsets[text[of]] + base[text[of]]
            found.append(_merged(row[text[of]], begin, begin + number[p] - 1 + MIN_LENGTH))
        rows, begin, end = _merged(*[np.concatenate(c) for c in zip(*found, strict=True)])
        edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True]) if len(rows) else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            r = int(rows[i])
            raw, digest_, at = texts.column("text")[r].as_py().encode(), hashlib.sha256(), 0
            for x, y in zip(begin[i:j].tolist(), end[i:j].tolist(), strict=True):
                digest_.update(raw[at:x])
                at = y
            digest_.update(raw[at:])
            removed[r], spans[r], kept[r] = (end[i:j] - begin[i:j]).sum(), j - i, digest_.hexdigest()
            where[r] = np.stack([begin[i:j], end[i:j]], axis=1).astype(np.int64).tobytes()
    return pa.table(
        {
            "sha": texts.column("sha"),
            "least": texts.column("least"),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(kept, pa.string()),
            "spans": pa.array(where, pa.binary()),
        }
    )


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a partition once."""
    seen: set[str] = set()
    for batch in batches:
        take = []
        for i, s in enumerate(batch.column("sha").to_pylist()):
            if s not in seen:
                seen.add(s)
                take.append(i)
        yield batch.take(pa.array(take, pa.int64()))


def _chunk_texts(texts: pa.Table, firsts: pa.Table) -> pa.Table:
    """Each text of a chunk once, with its smallest doc_id."""
    least = dict(zip(firsts.column("sha").to_pylist(), firsts.column("least").to_pylist(), strict=True))
    take, seen = [], set()
    shas = texts.column("sha").to_pylist()
    for i, s in enumerate(shas):
        if s not in seen and s in least:
            seen.add(s)
            take.append(i)
    kept = texts.take(pa.array(take, pa.int64()))
    return pa.table(
        {
            "chunk": kept.column("chunk"),
            "sha": kept.column("sha"),
            "least": pa.array([least[shas[i]] for i in take], pa.int64()),
            "text": kept.column("text"),
        }
    )


def _collected(spark) -> None:
    """Lets Spark delete the shuffle files of finished steps."""
    spark.sparkContext._jvm.System.gc()


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, facts): rows has doc_id, n_bytes, sha of every row of docs; facts
    has per distinct text of 50 bytes or more what the row with its smallest
    doc_id loses."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha")
        ),
        "dedup-rows",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    n_chunks = max(16, -(-total // CHUNK_BYTES))
    n_files = min(n_chunks, MAX_BUCKETS)
    chunk = F.pmod(F.xxhash64("sha"), F.lit(n_chunks)).cast("int").alias("chunk")
    firsts = (
        rows.filter((F.col("n_bytes") >= MIN_LENGTH) & F.col("doc_id").isNotNull())
        .groupBy("sha")
        .agg(F.min("doc_id").cast("long").alias("least"))
        .select(chunk, "sha", "least")
    )
    texts = (
        docs.filter((F.octet_length("text") >= MIN_LENGTH) & F.col("doc_id").isNotNull())
        .select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
        .select(chunk, "sha", "text")
        .mapInArrow(_first_copies, "chunk int, sha string, text string")
    )
    path, table = scratch_path(spark, "dedup-texts"), f"folioscan_{uuid.uuid4().hex}"
    (
        texts.repartition(n_files, "chunk")
        .groupBy("chunk")
        .cogroup(firsts.repartition(n_files, "chunk").groupBy("chunk"))
        .applyInArrow(_chunk_texts, "chunk int, sha string, least bigint, text string")
        .write.option("path", path)
        .option("compression", "zstd")
        .bucketBy(n_files, "chunk")
        .saveAsTable(table)
    )
    del texts, firsts
    _collected(spark)
    try:
        by_chunk = spark.table(table).groupBy("chunk")
        found = materialize(
            by_chunk.applyInArrow(_entries(n_chunks), "bucket int, chunk int, data binary")
            .groupBy("bucket")
            .applyInArrow(_shared, "kind int, place int, bucket int, data binary"),
            "dedup-shared",
        )
        _collected(spark)
        requests = found.filter("kind = 0").select(F.col("place").alias("chunk"), "bucket", "data")
        shared = found.filter("kind = 1").select("bucket", "data")
        strings = by_chunk.cogroup(requests.groupBy("chunk")).applyInArrow(
            _strings, "bucket int, data binary"
        )
        answers = materialize(
            strings.groupBy("bucket")
            .cogroup(shared.groupBy("bucket"))
            .applyInArrow(_decide, "chunk int, data binary"),
            "dedup-answers",
        )
        _collected(spark)
        facts = materialize(
            by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_remove, RESULT), "dedup-facts"
        )
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_scratch(spark, path)
    return rows, facts


def dedup_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, facts = removals(docs)
    both = rows.join(facts.withColumnRenamed("sha", "text_sha"), rows["sha"] == F.col("text_sha"), "left")
    copy = F.col("doc_id") > F.col("least")
    known = F.col("least").isNotNull() & F.col("doc_id").isNotNull()
    pick = lambda c, of_copy, none: F.when(known & copy, of_copy).when(known, F.coalesce(c, none)).otherwise(none)
    zero = F.lit(0).cast("long")
    return both.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_removed"), F.col("n_bytes"), zero).alias("n_removed"),
        pick(F.col("n_spans"), F.lit(1).cast("long"), zero).alias("n_spans"),
        pick(F.col("kept_sha256"), F.sha2(F.lit("").cast("binary"), 256), F.col("sha")).alias("kept_sha256"),
    )
