"""One row of each group of near copies, by min-hash bands and a verified similarity.

Rows whose word shingles share a min-hash band are candidates, and what candidates connect is a
family. Within a family every two rows are compared: near copies share at least `similar` of their
words, counted with their number (the multisets' Jaccard index). What near copies connect is one
group; its row with the least id, of those the least text, stays. Groups never cross a class, so
that equal texts of two classes both stay.

Two near copies are missed only if none of their bands agrees: with 64 bands of 3, shingles of 5
words and a Jaccard index of the shingles of 0.5 that is one pair in some 5,000, at 0.4 one in 70.
Words end at blanks and are taken without case and marks around them. Null texts count as empty;
texts without a word are one group for each class. Large families are dealt in pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Forest, chunked, components, slices, written

_MARKS = ".,;:!?\"'()[]{}"
#: Shingle hashes that meet all hash functions at once.
_SLAB = 4096


def words(text: str) -> list[bytes]:
    return [(w.strip(_MARKS) or w).encode("utf-8", "surrogatepass") for w in text.lower().split()]


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(found: list[bytes], cls: int, shingle: int, n_bands: int, band_rows: int) -> np.ndarray:
    """A key for each band, distinct between bands and classes, as signed integers."""
    h, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([h(join(found[i : i + shingle])) for i in range(max(1, len(found) - shingle + 1))], np.uint64)
    seeds = _mixed(np.arange(1, n_bands * band_rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _SLAB):
        np.minimum(least, _mixed(hashes[i : i + _SLAB, None] ^ seeds).min(axis=0), out=least)
    return np.array([h(b.tobytes(), (cls & 0xFFFF) << 16 | k) for k, b in enumerate(least.reshape(n_bands, band_rows))], np.uint64).view(np.int64)


def bag(found: list[bytes]) -> np.ndarray:
    """A number for each word and each of its repetitions, as signed integers."""
    seen: dict[bytes, int] = {}
    out = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        k = seen[w] = seen.get(w, -1) + 1
        out[i] = xxhash.xxh64_intdigest(w, k)
    return out.view(np.int64)


def _forest_of(pdf: pd.DataFrame, similar: float) -> pd.DataFrame:
    """Spanning edges of the near copies in one family, or in one pair of its chunks."""
    pdf = pdf.sort_values("node")
    node, c = pdf["node"].to_numpy(), pdf["__c"].to_numpy()
    sets = [set(b.tolist()) for b in pdf["bag"]]
    n = np.array([len(s) for s in sets])
    same = pdf["__p"].iloc[0] == pdf["__q"].iloc[0] if len(pdf) else True
    trees, us, vs = Forest(len(pdf)), [], []
    for i in range(len(pdf) - 1):
        # sets of too different a size can't share enough
        fit = np.minimum(n[i + 1 :], n[i]) >= similar * np.maximum(n[i + 1 :], n[i])
        if not same:
            fit &= c[i + 1 :] != c[i]
        for j in (np.flatnonzero(fit) + i + 1).tolist():
            if trees.find(i) == trees.find(j):
                continue
            both = len(sets[i] & sets[j])
            if both >= similar * (n[i] + n[j] - both):
                trees.join(i, j)
                us.append(node[j])
                vs.append(node[i])
    return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})


def one_of_copies(
    df: DataFrame, id_col: str, text_col: str, class_col: str,
    similar: float = 0.8, shingle: int = 5, n_bands: int = 64, band_rows: int = 3, chunk_rows: int = 256,
) -> DataFrame:
    """Rows (id_col, text_col, class_col) of `df`, one for each group of near copies; class_col is an integer."""
    text = F.coalesce(text_col, F.lit(""))
    distinct = df.groupBy(F.col(class_col), text.alias(text_col)).agg(F.min(id_col).alias(id_col)).select(id_col, text_col, class_col)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, classes = b.column(1).to_pylist(), b.column(2).to_pylist()
            found = [words(t) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), c & 0xFFFFFFFF) for t, c in zip(texts, classes)], np.uint64).view(np.int64)
            keys = [bands(f, c, shingle, n_bands, band_rows) for f, c in zip(found, classes)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(nodes), pa.array(keys, pa.list_(pa.int64())), pa.array([bag(f) for f in found], pa.list_(pa.int64()))],
                names=[*b.schema.names, "node", "keys", "bag"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema)
    rows = written(distinct.mapInArrow(sketch, f"{ddl}, node long, keys array<long>, bag array<long>"), "sketches")

    keyed = rows.select("node", F.explode("keys").alias("key"))
    # written, so that its size is known when the join is planned
    shared = written(keyed.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("__key"), "v"), "shared_bands")
    family = components(keyed.join(shared, F.col("key") == F.col("__key")).select(F.col("node").alias("u"), "v"))
    members = rows.select("node", "bag").join(family.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).select("node", "component", "bag")
    cold, hot = chunked(members, ["component"], F.abs(F.xxhash64("node")), chunk_rows)
    zero = F.lit(0)
    dealt = cold.select("node", "component", "bag", zero.alias("__c"), zero.alias("__p"), zero.alias("__q")).unionByName(hot.select("node", "component", "bag", *[F.col(k).cast("int").alias(k) for k in ("__c", "__p", "__q")]))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        return _forest_of(pdf, similar)

    group = components(dealt.groupBy("component", "__p", "__q").applyInPandas(near, "u long, v long")).withColumnRenamed("node", "__node")
    named = rows.select("node", F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(group, F.col("node") == F.col("__node"))
    stays = named.groupBy("component").agg(F.min_by("node", F.struct("__id", "__text")).alias("__stays")).select("__stays")
    gone = group.join(stays, F.col("__node") == F.col("__stays"), "left_anti").select("__node")
    return rows.join(gone, F.col("node") == F.col("__node"), "left_anti").select(id_col, text_col, class_col)
