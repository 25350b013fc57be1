"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints within `distance` bits differ in at most that many of `blocks` bit blocks, so at least
`blocks - distance` blocks agree. Fingerprints are joined on every choice of that many blocks and
the Hamming distance is then verified. Equal fingerprints are one class before any join, and a hot
block value is dealt in chunks, so that a large group of copies costs neither a pair for each two
of its members nor a task of its own.

Null and empty texts, and texts without a word, have fingerprint zero and link like any other. Rows
that repeat a doc_id each get a row. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunked, components, free_name, per_text, written

#: Shingle hashes that are unpacked to bits at once.
_SLAB = 65536


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        h, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [h(join(s), seed) for s in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLAB):
        part = np.array(hashes[i : i + _SLAB], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id_col, fp long)."""
    return per_text(df, text_col, [id_col], pa.schema([("fp", pa.int64())]), "fp long", lambda t: (fingerprint(t, shingle, seed),))


def block_keys(fp: Column, distance: int, blocks: int) -> list[Column]:
    """For each choice of blocks - distance blocks, fp with all other bits cleared, and the choice's
    number in front of it as a field."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    out = []
    for k, chosen in enumerate(itertools.combinations(masks, blocks - distance)):
        mask = sum(chosen)
        out.append(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return out


def _forest_of(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Spanning edges of the links in one pair of chunks: a row takes in, at once, all rows that it links
    with and that no tree of its own holds yet."""
    pdf = pdf.sort_values("rep")
    rep, fp, c = pdf["rep"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["__c"].to_numpy()
    same = pdf["__p"].iloc[0] == pdf["__q"].iloc[0] if len(pdf) else True
    tree, us, vs = np.arange(len(pdf)), [], []
    for i in range(len(pdf) - 1):
        near = (np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance) & (tree[i + 1 :] != tree[i])
        if not same:
            near &= c[i + 1 :] != c[i]
        found = np.flatnonzero(near) + i + 1
        if len(found):
            trees, first = np.unique(tree[found], return_index=True)
            us.append(rep[found[first]])
            vs.append(np.full(len(trees), rep[i]))
            tree[np.isin(tree, trees)] = tree[i]
    return pd.DataFrame({"u": np.concatenate([*us, np.zeros(0, np.int64)]), "v": np.concatenate([*vs, np.zeros(0, np.int64)])})


def links(classes: DataFrame, distance: int = 3, blocks: int = 5, chunk_rows: int = 256) -> DataFrame:
    """Edges (u, v) that connect what is linked, over `classes` of distinct (fp, rep).

    Groups of up to `chunk_rows` fingerprints that share a block choice are joined by Spark, larger
    ones in pairs of chunks that give spanning edges only.
    """
    rows = classes.select("rep", "fp", F.explode(F.array(*block_keys(F.col("fp"), distance, blocks))).alias("b")).select("rep", "fp", "b.k", "b.key")
    cold, hot = chunked(rows, ["k", "key"], F.abs(F.xxhash64("rep")), chunk_rows)
    other = cold.select(F.col("rep").alias("rep2"), F.col("fp").alias("fp2"), F.col("k").alias("k2"), F.col("key").alias("key2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance
    small = cold.join(other, (F.col("k") == F.col("k2")) & (F.col("key") == F.col("key2")) & (F.col("rep") < F.col("rep2")) & near)

    def large(pdf: pd.DataFrame) -> pd.DataFrame:
        return _forest_of(pdf, distance)

    big = hot.groupBy("k", "key", "__p", "__q").applyInPandas(large, "u long, v long")
    return small.select(F.col("rep2").alias("u"), F.col("rep").alias("v")).unionByName(big)


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, distance: int, blocks: int) -> DataFrame:
    """Rows (id_col, fp long, root long) for every row of `df`; root is the least fingerprint of the group.

    Nodes are fingerprints, not ids: an id that repeats with different texts links nothing.
    """
    prints = written(fingerprints(df, id_col, text_col, shingle, seed), "simhash")
    classes = written(prints.select(F.col("fp").alias("rep"), "fp").distinct(), "classes")
    found = components(links(classes, distance, blocks))
    return prints.join(found, F.col("fp") == F.col("node"), "left").select(id_col, "fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 3, blocks: int = 5
) -> DataFrame:
    """Rows (id_col, fp long, component_id long) for every row of `df`; component_id is the least id of the group."""
    rows = written(_grouped(df, id_col, text_col, shingle, seed, distance, blocks), "groups")
    named = rows.groupBy(F.col("root").alias("__root")).agg(F.min(id_col).cast("long").alias("component_id"))
    return rows.join(named, F.col("root") == F.col("__root"), "left").select(id_col, "fp", "component_id")


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 3, blocks: int = 5
) -> DataFrame:
    """One row of `df` for each near-duplicate group: that with the least id, of those the least fingerprint, then the least text.

    Rows without an id can't be named by a group and all stay.
    """
    found = written(_grouped(df.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, seed, distance, blocks), "groups")
    stays = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).alias("id"), "fp")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.fp").alias("__fp"))
    # only ids with more rows than one need a look at their texts' fingerprints again
    many = found.groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id")
    name = free_name(df, "__kept")
    one = df.join(stays.join(many, "__id", "left_anti").select(F.col("__id").alias(name)), F.col(id_col) == F.col(name), "left_semi")
    repeated = df.join(many.withColumnRenamed("__id", name), F.col(id_col) == F.col(name), "left_semi")
    fp = free_name(df, "__print")

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or "", shingle, seed) for t in texts.to_pylist()], pa.int64())

    kept = stays.join(many, "__id", "left_semi").select(F.col("__id").alias(name), F.col("__fp").alias("__fp_kept"))
    several = repeated.withColumn(fp, of(F.col(text_col))).join(kept, (F.col(id_col) == F.col(name)) & (F.col(fp) == F.col("__fp_kept")), "left_semi")
    whole = F.struct(F.col(f"`{text_col}`"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    first = several.groupBy(id_col, fp).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), whole).alias("__row")).select("__row.*")
    return one.unionByName(first).unionByName(df.where(F.col(id_col).isNull()))
