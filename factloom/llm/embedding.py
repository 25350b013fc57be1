"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors a, b with cosine >= t have |a - b|^2 <= 2 - 2t. After a seeded random rotation the
coordinates are split into blocks; if every block's squared distance were above its share of that
budget, proportional to the block's width, the whole would be too, so a linked pair is within the
share in at least one block. Each block is range-joined on a grid over its first coordinates: a
vector is at home in one cell and visits the neighbouring cells that its radius reaches. A crowded cell is
divided again by a finer grid over the block's other coordinates, in the same way. Inside a cell
a sort on one more coordinate narrows the range, and the block's own distance decides who is a
candidate. Only the block's coordinates travel to the cells. The union of all blocks' candidates is
verified by the cosine in double precision, from the original components.

A vector with few candidates in a cell sends them on as pairs, one row for each pair whatever the
number of its blocks, to which the two vectors are joined. Vectors that have many candidates in one
cell are sent there whole, and the cell compares them among themselves: it sends on a count for each and
a spanning forest of their links, so that a dense group costs no row for each pair. A pair is counted
in the first block in which it is within the share, on the way that this block's cell sent it, so no
pair counts twice. Equal vectors with one label are one row with a weight before the join, and crowded
cells are dealt in pairs of chunks.

Vectors that are null, empty, of zero length, of another dimension than the comparison needs, or
with a null or non-finite component link with nothing, as do those whose label or id is null: n_links
0 and their own id as component. Labels may be of any type that Spark can compare. Repeated rows each
count. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Forest, chunked, components, remove, stored, written
from factloom.sources.tables import Rounds

#: Room for rounding in rotated coordinates in double precision, relative to a share.
_SLACK = 1e-9
#: Room for rounding to single precision, in which coordinates travel: an error of 1.2e-7 in each of a
#: block's, of which there are some ten.
_SINGLE = 2e-6


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _spans(dim: int, width: int) -> list[tuple[int, int]]:
    n = max(1, round(dim / width))
    cuts = [round(dim * i / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _coordinates(x: np.ndarray, seed: int) -> np.ndarray:
    """Rotated unit vectors, each computed alike whatever rows stand beside it."""
    u, q = _unit(x), rotation(x.shape[1], seed)
    out = np.zeros_like(u)
    for d in range(u.shape[1]):
        out += u[:, d : d + 1] * q[d]
    return out


def _radius(lo: int, hi: int, dim: int, threshold: float) -> float:
    return math.sqrt((2 - 2 * threshold) * (hi - lo) / dim) * (1 + _SLACK) + _SINGLE


def _cells(batches: Iterator[pa.RecordBatch], threshold: float, width: int, grid: int, stretch: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (label, dim, block, cell, role, rep, xy) of (label, rep, vec): role 0 at home, 1 on a visit;
    xy: the block's coordinates."""
    for b in batches:
        label, rep, vec = b.column(0).to_numpy(False), b.column(1).to_numpy(False), b.column(2)
        dims = np.diff(vec.offsets.to_numpy())
        flat = vec.flatten().to_numpy(False)
        at = np.concatenate([[0], np.cumsum(dims)])
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            all_xy = _coordinates(np.stack([flat[at[i] : at[i] + dim] for i in own]).astype(np.float64), seed).astype(np.float32)
            for k, (lo, hi) in enumerate(_spans(int(dim), width)):
                g = min(grid, hi - lo)
                radius = _radius(lo, hi, int(dim), threshold)
                side = radius * stretch
                x = all_xy[:, lo : lo + g].astype(np.float64)
                home = np.floor(x / side).astype(np.int64)
                rows, cells, roles = [np.arange(len(own))], [home], [np.zeros(len(own), np.int8)]
                for step in np.ndindex(*[3] * g):
                    s = np.array(step) - 1
                    first = next((v for v in s if v), 0)
                    if first >= 0:
                        continue  # of two cells, one side visits the other, the smaller
                    gap = np.where(s < 0, x - home * side, np.where(s > 0, (home + 1) * side - x, 0.0))
                    near = (gap * gap).sum(axis=1) <= radius * radius
                    i = np.flatnonzero(near)
                    rows.append(i), cells.append(home[i] + s), roles.append(np.ones(len(i), np.int8))
                r, c = np.concatenate(rows), np.concatenate(cells)
                take = own[r]
                key = c[:, 0].copy()
                for d in range(1, g):
                    key = key * 65537 + c[:, d]
                xy = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * (hi - lo)), pa.array(np.ascontiguousarray(all_xy[r, lo:hi]).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[take], pa.int64()), pa.array(np.full(len(r), dim, np.int32)), pa.array(np.full(len(r), k, np.int32)), pa.array(key), pa.array(np.concatenate(roles)), pa.array(rep[take]), xy],
                    names=["label", "dim", "block", "cell", "role", "rep", "xy"],
                )


def _divided(batches: Iterator[pa.RecordBatch], threshold: float, width: int, grid: int, finer: float) -> Iterator[pa.RecordBatch]:
    """Rows of crowded cells, divided again by a grid over the block's other coordinates: as they come, with
    sub, the finer cell, and part, 0 where they are at home in it and 1 on a visit."""
    for b in batches:
        dims, blocks, xy = b.column("dim").to_numpy(False), b.column("block").to_numpy(False), b.column("xy")
        offsets, flat = xy.offsets.to_numpy(), xy.flatten().to_numpy(False)
        for dim, block in {(int(d), int(k)) for d, k in zip(dims, blocks)}:
            own = np.flatnonzero((dims == dim) & (blocks == block))
            lo, hi = _spans(dim, width)[block]
            g = min(grid, hi - lo)
            radius = _radius(lo, hi, dim, threshold)
            side, rest = radius * finer, hi - lo - g
            x = np.stack([flat[offsets[i] - offsets[0] : offsets[i] - offsets[0] + hi - lo] for i in own])[:, g:].astype(np.float64)
            home = np.floor(x / side).astype(np.int64)
            # squared distances to the cell's two walls on each coordinate
            walls = [(x - home * side) ** 2, ((home + 1) * side - x) ** 2]
            rows, cells, parts = [np.arange(len(own))], [home], [np.zeros(len(own), np.int8)]
            for step in np.ndindex(*[3] * rest):
                s = np.array(step, int) - 1
                if next((v for v in s if v), 0) >= 0:
                    continue  # as above, one side visits the other
                gap = sum(walls[int(v > 0)][:, d] for d, v in enumerate(s) if v)
                i = np.flatnonzero(gap <= radius * radius)
                rows.append(i), cells.append(home[i] + s), parts.append(np.ones(len(i), np.int8))
            r, c = own[np.concatenate(rows)], np.concatenate(cells)
            key = np.zeros(len(c), np.int64)
            for d in range(rest):
                key = key * 4099 + c[:, d]
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(r)).columns, pa.array(key), pa.array(np.concatenate(parts))], names=[*b.schema.names, "sub", "part"])


def _candidates(t: pa.Table, threshold: float, width: int, grid: int, few: int, slab: int = 256) -> pa.RecordBatch:
    """The candidates of one cell (or of a pair of its chunks): pairs (a, b) in which one side has at most
    `few`; rows (a, null) for those that have more, whose pairs among themselves are left to the cell.

    Rows are sorted by the block's first coordinate that no cell divides, and each slab of them meets
    only the rows within the radius on it.
    """
    rep, block, dim = t.column("rep").to_numpy(), int(t.column("block")[0].as_py()), int(t.column("dim")[0].as_py())
    lo, hi = _spans(dim, width)[block]
    xy = t.column("xy").combine_chunks().flatten().to_numpy(False).reshape(len(rep), -1).astype(np.float64)
    line = xy[:, min(grid, hi - lo - 1)]
    order = np.argsort(line, kind="stable")
    xy, rep, line, home, inner = xy[order], rep[order], line[order], t.column("role").to_numpy()[order] == 0, t.column("part").to_numpy()[order] == 0
    split = "__p" in t.column_names and t.column("__p")[0] != t.column("__q")[0]
    c = t.column("__c").to_numpy()[order] if split else None
    radius, norms = _radius(lo, hi, dim, threshold), (xy * xy).sum(axis=1)
    found = []
    for at in range(0, len(xy), slab):
        to = min(len(xy), at + slab)
        end = int(np.searchsorted(line, line[to - 1] + radius, side="right"))
        # rounding in squared distances of coordinates below 1 is below 1e-14
        d2 = norms[at:to, None] + norms[None, at:end] - 2 * (xy[at:to] @ xy[at:end].T)
        i, j = np.nonzero(d2 <= radius * radius + 1e-14)
        i, j = i + at, j + at
        ok = (i < j) & (home[i] | home[j]) & (inner[i] | inner[j])
        if split:
            ok &= c[i] != c[j]
        found.append((i[ok].astype(np.int32), j[ok].astype(np.int32)))
    i, j = (np.concatenate(x) for x in zip(*found))
    many = np.bincount(i, minlength=len(xy)) + np.bincount(j, minlength=len(xy)) > few
    sent = ~(many[i] & many[j])
    i, j = i[sent], j[sent]
    crowd = rep[many]
    a = np.concatenate([np.minimum(rep[i], rep[j]), crowd])
    b = pa.array(np.concatenate([np.maximum(rep[i], rep[j]), crowd]), mask=np.arange(len(a)) >= len(i))
    keys = {n: t.column(n)[0].as_py() for n in ("label", "dim", "block", "cell", "sub")} | {n: t.column(n)[0].as_py() if n in t.column_names else 0 for n in ("__p", "__q")}
    fixed = [pa.array(np.full(len(a), keys[n]), k) for n, k in (("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int32()), ("cell", pa.int64()), ("sub", pa.int64()), ("__p", pa.int32()), ("__q", pa.int32()))]
    roles, parts, chunks = t.column("role").to_numpy()[order][many], t.column("part").to_numpy()[order][many], (t.column("__c").to_numpy()[order] if "__c" in t.column_names else np.zeros(len(xy), np.int32))[many]
    none = np.zeros(len(i), np.int64)
    return pa.RecordBatch.from_arrays(
        [*fixed, pa.array(np.concatenate([none, roles]), pa.int8()), pa.array(np.concatenate([none, parts]), pa.int8()), pa.array(np.concatenate([none, chunks]), pa.int32()), pa.array(a), b],
        names=["label", "dim", "block", "cell", "sub", "__p", "__q", "role", "part", "__c", "a", "b"],
    )


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine from correctly rounded sums."""
    dot = math.fsum(p * q for p, q in zip(a.tolist(), b.tolist()))
    return dot / math.sqrt(math.fsum(p * p for p in a.tolist()) * math.fsum(q * q for q in b.tolist()))


def _cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of rows; those within rounding of the threshold from correctly rounded sums."""
    a, b = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    value = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    for k in np.flatnonzero(np.abs(value - threshold) < 1e-12):
        value[k] = _exact(x[k], y[k])
    return value


def _first_block(x: np.ndarray, y: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """The first block in which rows of coordinates are within its share; -1 if none."""
    first = np.full(len(x), -1)
    for k, (lo, hi) in enumerate(_spans(x.shape[1], width)):
        d2 = np.zeros(len(x))
        for d in range(lo, hi):
            d2 += (x[:, d] - y[:, d]) ** 2
        first[(first < 0) & (d2 <= (2 - 2 * threshold) * (hi - lo) / x.shape[1] * (1 + _SLACK))] = k
    return first


_LINKS = ["a", "n", "b", "edge"]


def _verified(batches: Iterator[pa.RecordBatch], threshold: float, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Links among pairs (a, b, blocks, w_a, w_b, vec_a, vec_b) that their first block sent: for each
    (a, w_b, b, true) and (b, w_a, a, false)."""
    for batch in batches:
        a, b, w_a, w_b = (batch.column(n).to_numpy(False) for n in ("a", "b", "w_a", "w_b"))
        x, y = batch.column("vec_a"), batch.column("vec_b")
        dims = np.diff(x.offsets.to_numpy())
        flat_x, flat_y = (v.flatten().to_numpy(False).astype(np.float64) for v in (x, y))
        at, sets, keep = np.concatenate([[0], np.cumsum(dims)]), batch.column("blocks").to_pylist(), np.zeros(len(a), bool)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            p, q = (np.stack([flat[at[i] : at[i] + dim] for i in own]) for flat in (flat_x, flat_y))
            near = _cosines(p, q, threshold) >= threshold
            own, p, q = own[near], p[near], q[near]
            if len(own):
                first = _first_block(_coordinates(p, seed), _coordinates(q, seed), threshold, width)
                keep[own] = [f in sets[i] for i, f in zip(own, first)]
        a, b, w_a, w_b = a[keep], b[keep], w_a[keep], w_b[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([w_b, w_a])), pa.array(np.concatenate([b, a])), pa.array(np.arange(2 * len(a)) < len(a))], names=_LINKS)


def _linked(t: pa.Table, threshold: float, width: int, seed: int, slab: int = 256) -> pa.RecordBatch:
    """What the crowded rows of one cell (or of a pair of its chunks) find among themselves: counts (a, n)
    and forest edges (a, b)."""
    block, rep, w, home = int(t.column("block")[0].as_py()), t.column("rep").to_numpy(), t.column("w").to_numpy(), t.column("role").to_numpy() == 0
    inner = t.column("part").to_numpy() == 0
    raw = t.column("vec").combine_chunks().flatten().to_numpy(False).reshape(len(rep), -1).astype(np.float64)
    xy, scaled = _coordinates(raw, seed), raw / np.abs(raw).max(axis=1, keepdims=True)
    norms = np.sqrt((scaled * scaled).sum(axis=1))
    split = t.column("__p")[0] != t.column("__q")[0]
    c = t.column("__c").to_numpy()
    count, trees, us, vs = np.zeros(len(raw), np.int64), Forest(len(raw)), [], []
    for at in range(0, len(raw), slab):
        to = min(len(raw), at + slab)
        i, j = np.nonzero(scaled[at:to] @ scaled[at:].T / (norms[at:to, None] * norms[None, at:]) >= threshold - 1e-12)
        i, j = i + at, j + at
        ok = (i < j) & (home[i] | home[j]) & (inner[i] | inner[j])
        if split:
            ok &= c[i] != c[j]
        i, j = i[ok], j[ok]
        for part in range(0, len(i), 1 << 16):  # pairs of a slab that are held with their vectors
            p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            near = _cosines(raw[p], raw[q], threshold) >= threshold
            p, q = p[near], q[near]
            own = _first_block(xy[p], xy[q], threshold, width) == block
            p, q = p[own], q[own]
            count += np.bincount(p, w[q], len(raw)).astype(np.int64) + np.bincount(q, w[p], len(raw)).astype(np.int64)
            for x, y in zip(p.tolist(), q.tolist()):
                if trees.up[x] != trees.up[y] and trees.join(x, y):
                    us.append(rep[x]), vs.append(rep[y])
    some = np.flatnonzero(count)
    edge = np.arange(len(some) + len(us)) >= len(some)
    a, b = np.concatenate([rep[some], np.array(us, np.int64)]), np.concatenate([rep[some], np.array(vs, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate([count[some], np.zeros(len(us), np.int64)])), pa.array(b), pa.array(edge)], names=_LINKS)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, of batches that are sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(False).astype(np.int64) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), b.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            key = tuple(k[:, at])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


def _by_groups(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Deals `rows` by their keys, sorts each task's, and works group by group of two rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, len(keys)):
            if t.num_rows > 1:
                yield work(t)

    first = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *first).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _label_key(df: DataFrame, name: str) -> Column:
    """A label as a long: whole numbers themselves, others a 64-bit hash."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return c.cast("long")
    # 0.0 and -0.0 are equal labels
    return F.when(c.isNotNull(), F.xxhash64(c + F.lit(0.0).cast(kind) if kind in ("float", "double") else c))


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, width: int = 8, grid: int = 3, stretch: float = 3.0, finer: float = 3.0, few: int = 32, chunk_rows: int = 8_192, dealt_rows: int = 512, seed: int = 7,
) -> DataFrame:
    """Rows (id_col, n_links long, component_id long, kept boolean) for every row of `df`.

    `width`: coordinates of a block; `grid`: how many of them the cells divide; `stretch`: a cell's
    side in radii, `finer` that of a cell which a crowded one is divided into; `few`: candidates of a vector in one cell up to which they travel as pairs;
    `chunk_rows`: rows of a cell above which it is divided; `dealt_rows`: rows of a cell that can't be divided
    again above which it is dealt in chunks.
    """
    kind = "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vec_col).cast(kind)
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(sound, F.lit(False))
    rows = written(
        df.select(F.col(id_col).cast("long").alias("__id"), F.when(ok, _label_key(df, label_col)).alias("__label"), F.when(ok, F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(kind)).alias("__vec"))
        .withColumn("__h", F.when(F.col("__vec").isNotNull(), F.sha2(F.to_json(F.struct("__label", "__vec")), 256))),
        "vectors",
    )
    classes = rows.where(F.col("__h").isNotNull()).groupBy("__h").agg(
        F.min("__id").alias("rep"), F.first("__label").alias("label"), F.first("__vec").alias("vec"), F.count("*").alias("w")
    )
    classes = written(classes.select("__h", "label", "rep", "w", "vec"), "vector_classes")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cells(batches, threshold, width, grid, stretch, seed)

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _divided(batches, threshold, width, grid, finer)

    def candidates(t: pa.Table) -> pa.RecordBatch:
        return _candidates(t, threshold, width, grid, few)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verified(batches, threshold, width, seed)

    def linked(t: pa.Table) -> pa.RecordBatch:
        return _linked(t, threshold, width, seed)

    spark = df.sparkSession
    placed, placed_at = stored(classes.select("label", "rep", "vec").mapInArrow(cells, "label long, dim int, block int, cell long, role byte, rep long, xy array<float>"), "vector_cells")
    cell = ["label", "dim", "block", "cell"]
    crowds = placed.groupBy(*cell).count().where(F.col("count") > chunk_rows).select(*[F.col(k).alias(f"__{k}") for k in cell])
    crowds, n_crowds = Rounds(spark, "crowded_cells").counted(crowds)
    keys, whole = [*cell, "sub"], placed.withColumns({"sub": F.lit(0).cast("long"), "part": F.lit(0).cast("byte")})
    if n_crowds:
        on = [F.col(k) == F.col(f"__{k}") for k in cell]
        finely = placed.join(crowds, on, "left_semi").mapInArrow(divided, "label long, dim int, block int, cell long, role byte, rep long, xy array<float>, sub long, part byte")
        whole, fine_at = stored(whole.join(crowds, on, "left_anti").unionByName(finely), "vector_fine_cells")
        remove(spark, placed_at)
        placed_at = fine_at
    cold, hot = chunked(whole, keys, F.abs(F.xxhash64("rep")), dealt_rows)
    found = "label long, dim int, block int, cell long, sub long, __p int, __q int, role byte, part byte, __c int, a long, b long"
    near, near_at = stored(_by_groups(cold, keys, candidates, found).unionByName(_by_groups(hot, [*keys, "__p", "__q"], candidates, found)), "vector_candidates")
    remove(spark, placed_at)
    one = classes.select(F.col("rep").alias("__a"), F.col("w").alias("w_a"), F.col("vec").alias("vec_a"))
    two = classes.select(F.col("rep").alias("__b"), F.col("w").alias("w_b"), F.col("vec").alias("vec_b"))
    pairs = near.where("b IS NOT NULL").groupBy("a", "b").agg(F.collect_set("block").alias("blocks"))
    pairs = pairs.join(one, F.col("a") == F.col("__a")).join(two, F.col("b") == F.col("__b")).select("a", "b", "blocks", "w_a", "w_b", "vec_a", "vec_b")
    crowd = near.where("b IS NULL").join(one, F.col("a") == F.col("__a")).select(*keys, "__p", "__q", "role", "part", "__c", F.col("a").alias("rep"), F.col("w_a").alias("w"), F.col("vec_a").alias("vec"))
    links = "a long, n long, b long, edge boolean"
    # whole cells have chunk pair (0, 0), which no cell dealt in chunks shares with them, as its keys are others
    crowded = _by_groups(crowd, [*keys, "__p", "__q"], linked, links)
    out = written(pairs.mapInArrow(verified, links).unionByName(crowded), "vector_links")
    remove(spark, near_at)
    counts = out.groupBy(F.col("a").alias("__rep")).agg(F.sum("n").alias("n"))
    groups = components(out.where(F.col("edge")).select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("__node"), "component")
    told = (
        classes.select("__h", "rep", "w")
        .join(counts, F.col("rep") == F.col("__rep"), "left")
        .join(groups, F.col("rep") == F.col("__node"), "left")
        .select(F.col("__h").alias("__h2"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    full = rows.select("__id", "__h").join(told, F.col("__h") == F.col("__h2"), "left")
    comp = F.when(F.col("__id").isNotNull(), F.coalesce("c", "__id"))
    return full.select(
        F.col("__id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("__id") == comp, F.lit(False)).alias("kept")
    )


SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.node
), low AS (SELECT node, min(root) AS component FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component AS component_id, vec_id = component AS kept FROM embeddings JOIN low ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""
