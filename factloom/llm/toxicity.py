"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, accents, digits and signs that stand for letters, i and l as one
letter, since 1, ! and | stand for both), matched against the lexicon by Aho-Corasick, and the weights of the hits that lie in no exception phrase are
summed and set against the text's length. A logistic curve over the sum and the density gives the
score. The lexicon is a seed list with fixed weights, joined by words and word beginnings that
labelled documents show to be signs of toxicity, strong ones and such as tell only where they gather;
the curve is fitted to the same documents. The fit
reads at most `max_train` labelled documents (a fixed choice by hash), near copies with one label
once (`nearcopies`); scoring covers whole texts.

Null and empty texts have no hit and get the curve's lowest score. Repeated rows each get a row. An
empty table, or one without labels, is scored by the seed list and a fixed curve. Other columns are
ignored by `scored` and all kept by `drop_toxic`.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import free_name, per_text, slices, written
from factloom.llm.nearcopies import one_of_copies

#: Plain English insults, as they stand after folding.
SEED = ["idiot", "idiots", "moron", "morons", "imbecile", "stupid", "scum", "scumbag", "loser", "losers", "pathetic", "worthless", "disgusting", "trash", "clown", "dumbass", "bastard", "bitch", "asshole", "retard", "vermin", "shithead"]
SEED_WEIGHT = 3.0
#: Words that a text counts as having at least when hits are set against its length.
SHORT = 50
#: Phrases in which a word of the lexicon is meant otherwise.
EXCEPTIONS = ["clown fish", "trash can", "trash cans", "trash bin", "white trash bag", "circus clown", "rodeo clown", "pond scum", "sore loser board", "stupid simple", "take out the trash"]

#: Letters of other scripts that look like a Latin one.
_LOOKALIKES = dict(zip("абсԁеһіјкӏмпорѕтухгвνοαρτυιβεκμηωγ", "abcdehijklmnopstyxrbvoaptyibekmnwy"))
#: Digits and signs that stand for a letter.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]{2,}")


class _Fold(dict):
    """A translation table that is filled as characters are met."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)[0].lower()
        base = base if len(base) == 1 else c
        to = ord(_LEET.get(base) or _LOOKALIKES.get(base) or base)
        self[code] = to
        return to


_FOLD = _Fold()


def visible(text: str) -> str:
    return _INVISIBLE.sub("", text)


def fold(text: str) -> str:
    """The folded text, character for character as long as `text`."""
    return text.translate(_FOLD)


def shape(text: str) -> str:
    """The folded text with l as i, since 1, ! and | stand for either; what is matched."""
    return fold(text).replace("l", "i")


@dataclass(frozen=True)
class Lexicon:
    """Weights of whole words and of word beginnings, the phrases excepted, and the curve."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float, float] = (-4.0, 1.0, 1.0, 0.5)

    def key(self) -> tuple:
        return tuple(sorted(self.words.items())), tuple(sorted(self.starts.items())), self.exceptions


@lru_cache(maxsize=8)
def _automaton(key: tuple):
    words, starts, exceptions = key
    a = ahocorasick.Automaton()
    made: dict[str, list] = {}
    for kind, entries in ((0, words), (1, starts), (2, [(x, 0.0) for x in exceptions])):
        for text, weight in entries:
            made.setdefault(shape(text), []).append((kind, weight))
    for text, entries in made.items():
        a.add_word(text, (len(text), entries))
    if made:
        a.make_automaton()
    return a


def hits(text: str, key: tuple) -> list[tuple[int, int, float]]:
    """(start, end, weight) of what counts: one hit for each word begun, the heaviest."""
    a = _automaton(key)
    if not len(a):
        return []
    best: dict[int, tuple[int, float]] = {}
    away: list[tuple[int, int]] = []
    n = len(text)
    for last, (size, entries) in a.iter(shape(text)):
        at, end = last - size + 1, last + 1
        if at and text[at - 1].isalnum():
            continue
        closed = end == n or not text[end].isalnum()
        for kind, weight in entries:
            if kind == 2:
                if closed:
                    away.append((at, end))
            elif (kind == 1 or closed) and (at not in best or weight > best[at][1]):
                best[at] = (end, weight)
    found = [(at, end, w) for at, (end, w) in sorted(best.items())]
    return [h for h in found if not any(p <= h[0] and h[1] <= q for p, q in away)] if away else found


def signs(text: str, key: tuple) -> tuple[float, float, float]:
    """The heaviest hit, the sum of the hits' weights, damped, and their density by length, damped."""
    text = visible(text)
    weights = [h[2] for h in hits(text, key)]
    if not weights:
        return 0.0, 0.0, 0.0
    total = sum(weights)
    return max(weights), math.log1p(total), math.log1p(100 * total / max(SHORT, len(text.split())))


def score(text: str, lexicon: Lexicon, key: tuple) -> float:
    c0, *slopes = lexicon.curve
    z = c0 + sum(c * x for c, x in zip(slopes, signs(text, key)))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(id_col.cast("string")) % 3 == 1


def _candidates(texts: Iterable[tuple[str, int]], starts: tuple[int, ...]) -> tuple[Counter, dict[tuple[int, str], Counter]]:
    """Documents by (kind, shape, label), and the spellings of each (kind, shape)."""
    df: Counter = Counter()
    spelt: dict[tuple[int, str], Counter] = {}
    for text, toxic in texts:
        seen = set(_WORD.findall(fold(visible(text))))
        begun = {(1, w[:k]) for w in seen for k in starts if len(w) > k}
        shapes = set()
        for kind, w in {(0, w) for w in seen} | begun:
            c = kind, w.replace("l", "i")
            shapes.add(c)
            spelt.setdefault(c, Counter())[w] += 1
        for c in shapes:
            df[(*c, toxic)] += 1
    return df, spelt


def _fit_curve(x: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> tuple[float, ...]:
    """Logistic regression by Newton's method; slopes are kept from going below zero. A step that would
    raise the loss is halved, and the penalty holds also where the two sides are told apart entirely."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.array([-2.0] + [0.5] * x.shape[1])
    penalty = l2 * len(y) * np.array([0.01] + [1.0] * x.shape[1])

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - y * m).sum() + (penalty * w * w).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        free = np.flatnonzero((np.arange(len(w)) == 0) | (w > 0) | (slope < 0))  # others would go below zero
        bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(bend[np.ix_(free, free)], slope[free])
        now, size = loss(w), 1.0
        while size > 1e-6:
            new = w - size * step
            new[1:] = np.maximum(new[1:], 0)
            if loss(new) <= now:
                break
            size /= 2
        else:
            break
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_train: int = 20_000, min_docs: int = 8, least_weight: float = 1.5, max_entries: int = 2_000, starts: tuple[int, ...] = (4, 5, 6, 7, 8),
    seed: Iterable[str] = tuple(SEED), exceptions: Iterable[str] = tuple(EXCEPTIONS),
) -> Lexicon:
    """A lexicon from labelled rows that are not held out.

    An entry's weight is the lower bound, at 1.64 standard errors, of the log ratio of its document
    rates among toxic and clean rows; entries need `min_docs` toxic documents and `least_weight`. What is
    learnt from, and so all that a driver holds, is bounded by two parameters of the fit: at most `max_train`
    labelled rows, and of the words and beginnings that qualify the `max_entries` of the greatest weight. Scores
    are given to all rows.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__toxic"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    )
    # max_train rows of two numbers: 20,000 are some 240 KB
    rows = docs.select(F.col(id_col).alias("__d"), F.coalesce(text_col, F.lit("")).alias("__text")).join(F.broadcast(chosen), F.col("__d") == F.col("__id"))
    # near copies would make any of their words look like a sign
    train = written(one_of_copies(rows, "__d", "__text", "__toxic").select("__text", "__toxic"), "toxic_train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            df, spelt = _candidates(((t or "", y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), starts)
            k = list(df)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int32()), pa.array([x[1] for x in k], pa.string()), pa.array([x[2] for x in k], pa.int32()), pa.array([df[x] for x in k], pa.int64()), pa.array([max(spelt[x[:2]].items(), key=lambda s: (s[1], s[0]))[0] for x in k], pa.string())], names=["kind", "entry", "toxic", "n", "spelt"])

    size = {r[0]: r[1] for r in train.groupBy("__toxic").count().collect()}
    nt, nc = size.get(1, 0), size.get(0, 0)
    words: dict[str, float] = {fold(w): SEED_WEIGHT for w in seed}
    begins: dict[str, float] = {}
    plain = Lexicon(words, {}, tuple(exceptions))
    if not nt or not nc:
        return plain
    t, c = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    ratio = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
    weight = ratio - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    top = (
        train.mapInArrow(count, "kind int, entry string, toxic int, n long, spelt string").groupBy("kind", "entry").agg(t.alias("t"), c.alias("c"), F.max(F.struct("n", "spelt")).alias("most"))
        .where(F.col("t") >= min_docs).withColumn("w", weight).where(F.col("w") >= least_weight)
        .orderBy(F.desc("w"), "kind", "entry").limit(max_entries).collect()
    )
    most: Counter = Counter()
    for r in top:
        if r.kind == 0:
            for k in starts:
                most[r.entry[:k]] = max(most[r.entry[:k]], r.t)
    # entries are shapes; the lexicon has them as they are spelt
    plainly = {shape(w): w for w in words}
    seen_by: dict[str, int] = {}
    for r in sorted((r for r in top if r.kind == 1), key=lambda r: (-len(r.entry), r.entry)):
        # a beginning counts if it says more than any one of its words and than a longer beginning in it
        longer = max((t for b, t in seen_by.items() if b.startswith(r.entry)), default=0)
        if r.t >= 1.3 * most[r.entry] and longer < 0.9 * r.t:
            begins[r.most.spelt], seen_by[r.entry] = float(r.w), r.t
    for r in top:
        if r.kind == 0 and not any(r.entry.startswith(b) for b in seen_by):
            words[plainly.get(r.entry, r.most.spelt)] = float(r.w)
    lexicon = Lexicon(words, begins, tuple(exceptions))
    key = lexicon.key()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [signs(t or "", key) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in s], pa.float64()), pa.array([x[1] for x in s], pa.float64()), pa.array([x[2] for x in s], pa.float64()), b.column(1)], names=["top", "sum", "density", "y"])

    got = np.array(train.mapInArrow(seen, "top double, sum double, density double, y int").collect(), float)  # at most max_train rows
    return Lexicon(words, begins, tuple(exceptions), _fit_curve(got[:, :3], got[:, 3]))


def scored(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score double) for every row of `df`."""
    key = lexicon.key()
    return per_text(df, text_col, [id_col], pa.schema([("score", pa.float64())]), "score double", lambda t: (score(t, lexicon, key),))


def drop_toxic(df: DataFrame, lexicon: Lexicon, text_col: str = "text", at: float = 0.7) -> DataFrame:
    """The rows of `df` that score below `at`, with their columns."""
    key, name = lexicon.key(), free_name(df, "__toxicity")

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([score(t or "", lexicon, key) for t in texts.to_pylist()], pa.float64())

    return df.withColumn(name, of(F.col(text_col))).where(F.col(name) < at).drop(name)
