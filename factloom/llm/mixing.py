"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target; target / size is how often each of its documents is taken on average: the
whole part for certain, the rest as an inclusion probability. The flight phase moves the
probabilities of three documents at a time along the null space of the constraints (number of
documents, number of words) until one of them is 0 or 1, so both totals stand still. It runs in
chunks of a source's documents; each chunk leaves two undecided documents at most, which meet in
fewer chunks until one is left for each source, and the landing decides its last few, by all their outcomes. Chunks and
random numbers follow from ids and sizes, so reruns agree whatever the partitions.

Targets: sources in code point order, null last, take the weights in turn; a target stops at
`most` times its source's size and the excess goes to the others by weight. Null and empty texts
have size 0 and take nothing; a source without a word has target 0. Repeated rows are documents of
their own. An empty table gives an empty result. Other columns are ignored by `plan` and kept by
`mixed`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WORD, free_name, written

WEIGHTS = (5.0, 2.0, 1.0)

#: Documents of a source that one flight decides together.
CHUNK = 512
#: Documents of a source that are kept from its last flight for the landing.
LANDING = 14


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves `prob` to 0 and 1 with sum(prob) and sum(prob * size) unchanged; at most two stay between."""
    p, eps = prob.astype(float).copy(), 1e-9
    p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    queue = np.flatnonzero((p > 0) & (p < 1)).tolist()
    queue.reverse()
    live: list[int] = []
    draws = iter(rng.random(2 * len(queue) + 8).tolist())
    while True:
        while len(live) < 3 and queue:
            live.append(queue.pop())
        if len(live) == 3:
            a, b, c = (float(size[i]) for i in live)
            u = [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
        elif len(live) == 2 and size[live[0]] == size[live[1]]:
            u = [1.0, -1.0]
        else:
            return p
        scale = max(map(abs, u))
        up = down = math.inf
        for i, x in zip(live, u):
            x /= scale
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(live, u):
            p[i] += step * x / scale
            if p[i] < eps:
                p[i] = 0.0
            elif p[i] > 1 - eps:
                p[i] = 1.0
        live = [i for i in live if 0 < p[i] < 1]


def land(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides at most LANDING + 2 documents: of all outcomes the one whose words, then whose documents,
    are nearest to what the probabilities promise; of equally near ones a random one."""
    p = prob.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        words = np.abs(ways @ size[left].astype(float) - p[left] @ size[left])
        documents = np.abs(ways.sum(axis=1) - p[left].sum())
        p[left] = ways[np.lexsort((rng.random(len(ways)), documents, words))[0]]
    return p


def fly_and_land(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flies all but LANDING documents of spread sizes, then lands these with what the flight left."""
    p = prob.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    order = open_[np.argsort(size[open_], kind="stable")]
    held = order[np.unique(np.linspace(0, len(order) - 1, min(LANDING, len(order))).astype(int))] if len(order) else order
    flown = np.setdiff1d(np.arange(len(p)), held)
    p[flown] = flight(p[flown], size[flown], rng)
    return land(p, size, rng)


def _rng(*what) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(what).encode()).digest()[:8], "little"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, share: float = 1.0) -> DataFrame:
    """Adds `target` to rows (source, source_size, n): share * total, by weight, none above most * size.

    A target is min(cap, level * weight) with one level for all. Sorted by cap / weight, a source is
    at its cap if what all before it leave over is still enough; the first that isn't sets the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    rows = sources.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    line = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    rows = rows.withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.col("level"))).over(every)
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)
    rows = rows.withColumn("level", F.coalesce(first.getField("level"), level))
    return rows.select("source", "source_size", "n", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _decide(rows: DataFrame) -> DataFrame:
    """One level of flights over rows (row, id, source, size, prob, chunks, chunk); a source's
    only chunk lands too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "size", "row"], na_position="first")
        rng = _rng(pdf["source"].iloc[0], int(pdf["chunks"].iloc[0]), int(pdf["chunk"].iloc[0]))
        last = pdf["chunks"].iloc[0] == 1
        return pdf.assign(prob=(fly_and_land if last else flight)(pdf["prob"].to_numpy(), pdf["size"].to_numpy(), rng))

    return rows.groupBy("source", "chunks", "chunk").applyInPandas(run, rows.schema)


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, share: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """Rows (row, id, source, size, source_size, target, copies long) for every row of `df`."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = written(
        df.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "sizes",
    )
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most, share)
    sources = written(sources.withColumn("pi", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("long")), "sources")
    told = sources.select(F.col("source").alias("__s"), "source_size", "target", F.floor("pi").alias("whole"), (F.col("pi") - F.floor("pi")).alias("prob"), "chunks")
    # rows that share id and size fall in one chunk, but for those of a crowd, which are dealt by their own places
    crowd = written(rows.groupBy("id", "size").count().where(F.col("count") > chunk).select(F.col("id").alias("__i"), F.col("size").alias("__z")), "crowds")
    many = rows.join(crowd, F.col("id").eqNullSafe(F.col("__i")) & (F.col("size") == F.col("__z")), "left").withColumn("__own", F.when(F.col("__z").isNotNull(), F.col("row"))).drop("__i", "__z")
    full = many.join(told, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("chunk", F.pmod(F.xxhash64("id", "size", "__own"), F.col("chunks"))).drop("__own")
    levels = sources.agg(F.max("chunks")).first()[0] or 1
    done = None
    left = full
    while True:
        last = levels == 1
        made = written(_decide(left), "flight")
        part = made if last else made.where((F.col("prob") == 0) | (F.col("prob") == 1))
        done = part if done is None else done.unionByName(part)
        if last:
            break
        # two of each chunk at most go on, so chunks of the next level hold no more than `chunk` rows
        fewer = F.ceil(F.col("chunks") * 2 / chunk).cast("long")
        left = made.where((F.col("prob") > 0) & (F.col("prob") < 1)).withColumn("chunks", fewer).withColumn("chunk", F.pmod(F.col("chunk"), F.col("chunks")))
        levels = math.ceil(levels * 2 / chunk)
    return done.select("row", "id", "source", "size", "source_size", "target", (F.col("whole") + F.col("prob")).cast("long").alias("copies"))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with a column that tells its rows apart in every scan: the place in its file where rows come
    straight from files, else numbers in a written copy."""
    place = F.concat(F.lpad(F.hex("_metadata.row_index"), 12, "0"), F.lit(":"), "_metadata.file_path")
    try:
        return df.withColumn(name, place)
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "mix_docs")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of `df` that the mix takes, each as often as it is taken, with their columns."""
    name = free_name(df, "__row")
    rows = _numbered(df, name)
    key, times = free_name(rows, "__taken"), free_name(rows, "__times")
    taken = plan(rows, id_col, text_col, source_col, row_col=name, **how).where(F.col("copies") > 0).select(F.col("row").alias(key), F.col("copies").cast("int").alias(times))
    out = rows.join(taken, F.col(name) == F.col(key)).drop(name, key)
    return out.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).drop(times)
