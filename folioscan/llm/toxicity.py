"""Toxicity by weak supervision.

Voters: one for each term (a word or word beginning that training rows mark), a
general list of insults for each language, and patterns: several kinds of terms,
the share of term words at four levels, no term at all, upper case, repeated
marks.  A voter votes toxic, clean or abstains.  A generative label model
estimates how the voters vote in each class and which of them depend on each
other: a latent class with a dependency tree over the voters (the maximum
spanning tree of their mutual information given the class), fitted by EM.  The
labels of the training rows enter as a prior of the voters' rates; a row's
posterior is made from its votes alone.  A linear classifier (logistic
regression on counts and shares of what the voters saw) learns the posteriors
and scores every document.

Terms have to be mined from labelled rows, since the languages of the corpus have
no public lexicon.  A term is one that toxic rows hold more often than chance
allows; how far it is to be trusted, alone and next to others, is the label
model's to say.

Training rows are a bounded sample of labelled rows (MAX_TRAIN), the same share
of all, whatever their order; terms, voters and dependencies follow from them
without further bounds.

Defined results: null and empty texts get the score of a text in which no voter
saw anything; without training rows, or with one class only, every score is the
rate of toxic rows (0.1 without any); repeated rows get equal scores, and the
mean of their labels in training; rows without doc_id are not held out; extra
columns stay as they are, but one with the name given for the score gives way
to it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training rows.
MAX_TRAIN = 12_000
#: A term is mined if MIN_ROWS toxic training rows have it, and at least MIN_SHARE
#: of them, if it is MIN_RATIO times as frequent in toxic as in clean rows, and if the likelihood ratio
#: statistic of that difference reaches MIN_G2 (one in a million by chance).
#: Near copies count once, so that what a copied text happens to hold does not
#: pass for a mark.
MIN_ROWS, MIN_SHARE, MIN_RATIO, MIN_G2 = 4, 0.01, 6.0, 24.0
STEMS = range(3, 8)
WORD = re.compile(r"[^\W\d_]+")
UPPER, MARKS = re.compile(r"\b[A-Z]{4,}\b"), re.compile(r"[!?]{2,}")
#: General insults by language (fixed word lists).
INSULTS = {
    "en": (
        "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb jerk garbage filthy vermin "
        "fool foolish ugly hate hateful disgrace coward liar crap damn bastard bitch whore slut asshole retard retarded "
        "freak creep pig rat parasite subhuman savage degenerate brainless useless lousy nasty vile rotten sick"
    ).split(),
    "es": (
        "idiota estupido estúpido imbécil basura payaso asqueroso inútil patético tonto cabrón puta mierda maldito cerdo "
        "escoria cobarde mentiroso bruto despreciable"
    ).split(),
    "fr": (
        "idiote stupide imbécile ordure clown dégoûtant pathétique minable crétin abruti connard salaud salope merde "
        "cochon lâche menteur débile vermine méprisable"
    ).split(),
    "de": (
        "idiotisch dumm trottel abschaum müll erbärmlich wertlos widerlich dummkopf versager depp arschloch scheiße "
        "schwein feigling lügner blöd ungeziefer hure verdammt"
    ).split(),
}
LISTS = tuple(INSULTS)
#: Shares of term words at which a voter changes sides.
SHARES = (0.002, 0.005, 0.01, 0.02)
#: What the label of a training row weighs against the row's posterior where the
#: voters' rates are counted, and how sure a label is.
LABEL_WEIGHT, LABEL_SURE = 0.9, 0.975
#: Mutual information (nats) from which two voters count as dependent.
MIN_INFORMATION = 0.002
#: Columns after the terms: insults by language, upper case, marks, words.
_TAIL = len(LISTS) + 3


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    bias: float
    #: Per voter how often it votes toxic on clean and on toxic rows.
    rates: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: Voters that depend on each other given the class, with their information.
    dependencies: list[tuple[str, str, float]] = field(default_factory=list)


def units(text: str | None) -> tuple[Counter, int]:
    """Counts of lower-cased words, and their sum."""
    words = WORD.findall(text.lower()) if text else []
    return Counter(words), len(words)


def _terms_of(word: str) -> Iterator[str]:
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


class Seer:
    """What the voters see of a text: counts per term, insults by language,
    upper-case words, repeated marks, and the number of words."""

    #: Words whose terms are remembered.
    KNOWN = 200_000

    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        for k, words in enumerate(INSULTS.values()):
            self.index |= {("list", k, w): len(terms) + k for w in words}
        self.n = len(terms)
        self.known: dict[str, tuple[int, ...]] = {}

    def places(self, word: str) -> tuple[int, ...]:
        get = self.index.get
        found = tuple(i for t in _terms_of(word) if (i := get(t)) is not None)
        found += tuple(i for k in range(len(LISTS)) if (i := get(("list", k, word))) is not None)
        if len(self.known) >= self.KNOWN:
            self.known.clear()
        self.known[word] = found
        return found

    def see(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.n + _TAIL)
        counts, n = units(text)
        known = self.known
        for w, c in counts.items():
            at = known.get(w)
            for i in self.places(w) if at is None else at:
                out[i] += c
        if text:
            out[-3], out[-2] = len(UPPER.findall(text)), len(MARKS.findall(text))
        out[-1] = n
        return out


def voters(terms: list[str]) -> list[str]:
    named = [*terms, *[f"insults-{x}" for x in LISTS], "kinds", "nothing", *[f"share-{s}" for s in SHARES]]
    return [*named, "upper", "marks"]


def votes(seen: np.ndarray) -> np.ndarray:
    """1 toxic, 0 clean, -1 abstains, in the order of voters()."""
    words = np.maximum(seen[:, -1], 1)
    terms, lists = seen[:, :-_TAIL], seen[:, -_TAIL:-3]
    kinds = (terms > 0).sum(axis=1)
    marked = np.maximum(terms.sum(axis=1), lists.sum(axis=1))
    share = marked / words
    more = [
        np.where(kinds >= 2, 1, -1),
        np.where(marked == 0, 0, -1),
        *[np.where(marked > 0, (share > s).astype(int), -1) for s in SHARES],
        np.where(seen[:, -3] > 0.05 * words, 1, -1),
        np.where(seen[:, -2] > 0.05 * words, 1, -1),
    ]
    return np.concatenate([np.where(terms > 0, 1, -1), np.where(lists > 0, 1, -1), np.stack(more, axis=1)], axis=1)


def _dependencies(counts: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each voter (-1: none) in the maximum spanning tree, and its
    mutual information with it; counts: per class the joint counts of votes,
    (voter, voter, vote, vote)."""
    m = len(counts[0])
    info = np.zeros((m, m))
    for share, joint in zip((1 - prior, prior), counts, strict=True):
        p = joint + 1 / 9
        p = p / p.sum(axis=(2, 3), keepdims=True)
        apart = p.sum(axis=3, keepdims=True) * p.sum(axis=2, keepdims=True)
        info += share * (p * np.log(p / apart)).sum(axis=(2, 3))
    parent, gain = np.full(m, -1), np.zeros(m)
    inside = np.zeros(m, dtype=bool)
    inside[0] = True
    best, source = info[0].copy(), np.zeros(m, dtype=int)
    for _ in range(m - 1):
        j = int(np.where(inside, -1.0, best).argmax())
        if best[j] > MIN_INFORMATION:
            parent[j], gain[j] = source[j], best[j]
        inside[j] = True
        closer = info[j] > best
        best, source = np.where(closer, info[j], best), np.where(closer, j, source)
    return parent, gain


def label_model(cast: np.ndarray, gold: np.ndarray, rounds: int = 30, weight: float = LABEL_WEIGHT):
    """Posterior of the toxic class per row from its votes, the rates (voter,
    class) of toxic votes, each voter's parent and information.  gold: the
    training labels (0 to 1)."""
    n, m = cast.shape
    hot = np.stack([cast == v for v in (-1, 0, 1)], axis=2).astype(float)
    flat = hot.reshape(n, 3 * m)
    sure = (1 - LABEL_SURE) + gold * (2 * LABEL_SURE - 1)
    post = sure
    pairs = lambda w: ((flat * w[:, None]).T @ flat).reshape(m, 3, m, 3).transpose(0, 2, 1, 3)
    every = pairs(np.ones(n))
    for r in range(rounds):
        mixed = (1 - weight) * post + weight * sure
        prior = float(np.clip(mixed.mean(), 1e-3, 1 - 1e-3))
        if r % 5 == 0:
            toxic = pairs(mixed)
            parent, gain = _dependencies([every - toxic, toxic], prior)
        logit = np.full(n, np.log(prior / (1 - prior)))
        for sign, w in ((-1, 1 - mixed), (1, mixed)):
            for i in range(m):
                alone = w @ hot[:, i] + 0.5
                alone /= alone.sum()
                if parent[i] < 0:
                    logit += sign * np.log(alone)[cast[:, i] + 1]
                    continue
                given = np.einsum("na,n,nb->ab", hot[:, parent[i]], w, hot[:, i]) + 2 * alone
                given /= given.sum(axis=1, keepdims=True)
                logit += sign * np.log(given)[cast[:, parent[i]] + 1, cast[:, i] + 1]
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    rates = np.stack([(w @ hot[:, :, 2] + 0.5) / (w.sum() + 1.5) for w in (1 - mixed, mixed)], axis=1)
    return post, rates, parent, gain


def _design(seen: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: log counts, kinds and shares of term words."""
    terms, lists = seen[:, :-_TAIL], seen[:, -_TAIL:-3]
    kinds = (terms > 0).sum(axis=1, keepdims=True)
    marked = np.maximum(terms.sum(axis=1, keepdims=True), lists.sum(axis=1, keepdims=True))
    share = marked / np.maximum(seen[:, -1:], 1)
    steps = [(share > s).astype(float) for s in (0.0, *SHARES)]
    some = np.minimum(share, 0.1) * 10
    return np.concatenate(
        [np.log1p(seen[:, :-1]), np.minimum(kinds, 3.0), *steps, some, np.sqrt(some), np.log1p(seen[:, -1:]) / 5], axis=1
    )


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
    """Newton steps on soft labels."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(
            (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(keep), x1.T @ (y - p) - keep * w
        )
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """text, toxic (0 to 1) of at most about `limit` labelled rows that are not
    held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    n = known.count()
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1e6 * limit / n))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic")
    # near copies share their longest sentence, as a rule
    parts = F.split(F.coalesce("text", F.lit("")), r"[.\n]")
    longest = F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), F.xxhash64(x).alias("h"))))
    return rows.groupBy(longest.alias("sentence")).agg(F.min("text").alias("text"), F.avg("toxic").alias("toxic")).select("text", "toxic")


def g2(bad: np.ndarray, clean: np.ndarray, n_bad: int, n_clean: int) -> np.ndarray:
    """Likelihood ratio statistic of terms that `bad` of n_bad toxic and `clean`
    of n_clean clean rows hold."""
    n, held = n_bad + n_clean, bad + clean
    out = np.zeros(len(bad))
    for seen, total in ((bad, n_bad), (clean, n_clean)):
        for x, e in ((seen, held * total / n), (total - seen, (n - held) * total / n)):
            out += 2 * np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    return out


def learned_terms(rows: DataFrame) -> list[str]:
    """Words and word beginnings (ending in *) that mark toxic rows.  Rows with
    each term are counted per class on the executors.  Of terms that begin alike
    the one that tells most is taken."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for t in {t for w in units(text)[0] for t in _terms_of(w)}:
                    found.setdefault(t, [0, 0])[1 if toxic >= 0.5 else 0] += 1
            yield pd.DataFrame(
                {"term": list(found), "clean": [v[0] for v in found.values()], "bad": [v[1] for v in found.values()]}
            )

    n, n_bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") >= 0.5).cast("long")), F.lit(0))).first()
    n_clean = n - n_bad
    if not n_bad or not n_clean:
        return []
    counts = rows.mapInPandas(count, "term string, clean bigint, bad bigint").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("bad").alias("bad")
    )
    ratio = (F.col("bad") / F.lit(n_bad)) / ((F.col("clean") + 0.5) / F.lit(n_clean))
    # of a bounded number of rows only what several toxic ones share comes back
    top = counts.filter((F.col("bad") >= max(MIN_ROWS, MIN_SHARE * n_bad)) & (ratio >= MIN_RATIO)).toPandas()
    if not len(top):
        return []
    bad, clean = top["bad"].to_numpy(float), top["clean"].to_numpy(float)
    told = bad * np.log((bad / n_bad) / ((clean + 0.5) / n_clean))
    top = top.assign(told=told, size=top["term"].str.len())[g2(bad, clean, n_bad, n_clean) >= MIN_G2]
    chosen: list[str] = []
    for term in top.sort_values(["told", "size", "term"], ascending=[False, True, True])["term"]:
        stem = term.rstrip("*")
        above = any(c[-1] == "*" and stem.startswith(c[:-1]) for c in chosen)
        below = term[-1] == "*" and any(c.rstrip("*").startswith(stem) for c in chosen)
        if not above and not below:
            chosen.append(term)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    rows = training_rows(docs, labels, limit).persist()
    try:
        terms = learned_terms(rows)

        def see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seer = Seer(terms)
            for batch in batches:
                yield pd.DataFrame({"seen": [seer.see(t).tolist() for t in batch["text"]], "toxic": batch["toxic"]})

        # in one order, so that reruns sum alike
        got = rows.mapInPandas(see, "seen array<double>, toxic double").toPandas().sort_values("seen", kind="stable")
    finally:
        rows.unpersist()
    gold = got["toxic"].to_numpy(float)
    if not len(got) or (gold >= 0.5).all() or (gold < 0.5).all():
        rate = float(np.clip(gold.mean(), 0.01, 0.99)) if len(got) else 0.1
        return Model([], np.zeros(_TAIL + 4 + len(SHARES)), float(np.log(rate / (1 - rate))))
    seen = np.array(got["seen"].tolist())
    post, rates, parent, gain = label_model(votes(seen), gold)
    weights, bias = _logistic(_design(seen), post)
    names = voters(terms)
    return Model(
        terms,
        weights,
        bias,
        {v: (float(a), float(b)) for v, (a, b) in zip(names, rates, strict=True)},
        [(names[i], names[p], float(gain[i])) for i, p in enumerate(parent) if p >= 0],
    )


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1."""
    terms, weights, bias = model.terms, model.weights, model.bias

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seer = Seer(terms)
        for batch in texts:
            if not len(batch):
                yield pd.Series([], dtype=float)
                continue
            z = _design(np.stack([seer.see(t) for t in batch])) @ weights + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(name, of.asNondeterministic()("text"))
