"""Quality rules by weak supervision.

Each rule votes good, bad, or abstains. Expectation-maximisation over the counts of vote patterns,
which are at most 3 ** rules rows whatever the corpus, estimates how often each rule votes each way
on good and on bad documents; a document is kept if its posterior probability of being good reaches
`keep_at`. A bad vote alone rejects nothing: that of a rule that is often wrong is outvoted. A base
test comes first and overrides the verdict; the estimate is made over the documents that pass it.

Words are runs of anything but the six ASCII white-space bytes. Null and empty texts have no words,
fail the base test and get all-abstaining votes. Repeated rows each get a row. An empty table gives
an empty result. Other columns are ignored by `judge` and all kept by `keep_good`.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import free_name, per_text, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_closed"]
_ARROW = pa.schema([(n, pa.int64()) for n in FEATURES])
_DDL = ", ".join(f"{n} long" for n in FEATURES)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, its first place included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def features(text: str) -> tuple[int, ...]:
    """The counts that FEATURES names, for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    codes = np.frombuffer(raw, np.uint8)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(((codes >= 65) & (codes <= 90)).sum()),
        int(((codes >= 97) & (codes <= 122)).sum()),
        text.count("!") + text.count("?"),
        sum(x.rstrip(SPACES)[-1] in ".!?:;\"'" for x in lines),
    )


def _vote(bad: Column, good: Column | None = None) -> Column:
    """1 bad, 2 good, 0 abstains."""
    vote = F.when(bad, 1)
    return (vote if good is None else vote.when(good, 2)).otherwise(0)


def rules(f) -> dict[str, Column]:
    """Name -> vote; `f` gives a feature's column by name.

    Each rule looks at one measure and votes at the ends of its range, abstaining between. They are
    loose on purpose: short texts, a few repeated lines or an odd word length say little alone, and how
    much each vote is worth is left to the estimate.
    """
    n, lines, letters = f("n_words"), f("n_lines"), f("n_upper") + f("n_lower")
    some = n > 0
    return {
        "symbols": _vote(some & (f("n_symbols") > 0.1 * n), some & (f("n_symbols") <= 0.02 * n)),
        "word_length": _vote(some & ((f("word_chars") < 4.3 * n) | (f("word_chars") > 6.5 * n)), some & (f("word_chars") >= 4.6 * n) & (f("word_chars") <= 6 * n)),
        "open_lines": _vote((lines > 0) & (f("n_closed") < 0.8 * lines), (lines > 0) & (f("n_closed") >= 0.95 * lines)),
        "repeats": _vote(some & (f("n_repeat_words") > 0.15 * n), some & (f("n_repeat_words") <= 0.01 * n)),
        "dup_lines": _vote((lines > 0) & (f("n_dup_lines") > 0.15 * lines), (lines >= 5) & (f("n_dup_lines") == 0)),
        "capitals": _vote((letters >= 20) & (f("n_upper") > 0.25 * letters), (letters > 0) & (f("n_upper") >= 0.01 * letters) & (f("n_upper") <= 0.06 * letters)),
        "exclaims": _vote(some & (f("n_marks") > 0.1 * n)),
        "length": _vote(n < 75, n >= 150),
    }


def base_failed(f) -> Column:
    return (f("n_words") < 50) | (100 * f("n_repeat_words") > 50 * f("n_words"))


def pattern(votes: dict[str, Column]) -> Column:
    """The votes as the digits of one number in base 3."""
    code = F.lit(0)
    for v in votes.values():
        code = code * 3 + v
    return code


#: How rules vote on good and on bad documents before any is seen: (abstain, bad, good).
BELIEF = {"good": (0.45, 0.10, 0.45), "bad": (0.40, 0.35, 0.25)}
#: Documents that this belief counts for, in each class.
BELIEF_DOCS = 10.0


class Model:
    """What the estimate knows: the share of good documents, and for each rule how often it abstains,
    votes bad and votes good on good and on bad documents."""

    def __init__(self, share: float, good: np.ndarray, bad: np.ndarray) -> None:
        self.share, self.good, self.bad = share, good, bad

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        hot = _hot(votes)
        odds = math.log(self.share / (1 - self.share)) + np.einsum("prv,rv->p", hot, np.log(self.good) - np.log(self.bad))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _hot(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes == v for v in range(3)], axis=2).astype(float)


def votes_of(codes: list[int], n_rules: int) -> np.ndarray:
    """The votes that patterns stand for, a row for each."""
    return np.array([[c // 3 ** (n_rules - 1 - k) % 3 for k in range(n_rules)] for c in codes], int).reshape(-1, n_rules)


def fit(counts: dict[int, int], n_rules: int, rounds: int = 500, tolerance: float = 1e-9) -> Model:
    """The model by expectation-maximisation over the numbers of documents with each vote pattern.

    It starts from the votes' majority. A few documents' worth of belief in rules that are more often
    right than wrong keeps good and bad in their places and rates off 0 and 1; it doesn't grow with the
    corpus.
    """
    codes = sorted(counts)
    votes, n = votes_of(codes, n_rules), np.array([counts[c] for c in codes], float)
    hot = _hot(votes)
    bad, fine = (votes == 1).sum(axis=1), (votes == 2).sum(axis=1)
    good = np.where(bad == 0, 0.95, (fine + 1) / (bad + fine + 2))
    for _ in range(rounds):
        rates = {}
        for side, weight in (("good", good * n), ("bad", (1 - good) * n)):
            t = np.einsum("p,prv->rv", weight, hot) + BELIEF_DOCS * np.array(BELIEF[side])
            rates[side] = t / t.sum(axis=1, keepdims=True)
        model = Model((good @ n + 0.9 * BELIEF_DOCS) / (n.sum() + BELIEF_DOCS), rates["good"], rates["bad"])
        now = model.posterior(votes)
        moved, good = np.abs(now - good).max(initial=0.0), now
        if moved < tolerance:
            break
    return model


def _posteriors(rows: DataFrame, code: str, failed: str) -> dict[int, float]:
    """Vote pattern -> posterior. The model is fitted to the documents that the base test leaves open;
    every pattern that a document has gets its posterior."""
    n_rules = len(rules(F.col))
    counts = rows.groupBy(code).agg(F.count_if(~F.col(failed)).alias("n")).collect()  # at most 3 ** rules rows
    codes = [r[0] for r in counts]
    model = fit({r[0]: r[1] for r in counts if r[1]}, n_rules)
    return dict(zip(codes, model.posterior(votes_of(codes, n_rules)).tolist()))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """Rows (id_col, the five counts, base_failed, kept, posterior double) for every row of `df`."""
    rows = per_text(df, text_col, [id_col], _ARROW, _DDL, features)
    rows = written(rows.select(id_col, *FEATURES[:5], base_failed(F.col).alias("base_failed"), pattern(rules(F.col)).alias("__code")), "quality")
    found = _posteriors(rows, "__code", "base_failed")
    table = rows.sparkSession.createDataFrame(sorted(found.items()), "__pattern int, __good double")
    told = rows.join(F.broadcast(table), F.col("__code") == F.col("__pattern"), "left")  # at most 3 ** rules rows
    good = F.coalesce("__good", F.lit(0.0))
    return told.select(id_col, *FEATURES[:5], "base_failed", (~F.col("base_failed") & (good >= keep_at)).alias("kept"), good.alias("posterior"))


def keep_good(df: DataFrame, text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows of `df` that `judge` keeps, with their columns."""
    code, failed = free_name(df, "__code"), free_name(df, "__failed")

    @F.arrow_udf(f"struct<{_DDL.replace(' long', ':bigint')}>")
    def counts(texts: pa.Array) -> pa.Array:
        made = list(zip(*[features(t or "") for t in texts.to_pylist()])) or [()] * len(FEATURES)
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in made], names=FEATURES)

    got = free_name(df, "__features")
    rows = df.withColumn(got, counts(F.col(text_col)))
    of = lambda name: F.col(f"{got}.{name}")
    # one pass counts the patterns, another, when the rows are read, counts again what it keeps: no copy of the texts is written
    rows = rows.withColumn(code, pattern(rules(of))).withColumn(failed, base_failed(of))
    good = sorted(c for c, p in _posteriors(rows, code, failed).items() if p >= keep_at)
    return rows.where(~F.col(failed) & F.col(code).isin(*good) if good else F.lit(False)).drop(got, code, failed)
