"""Structural equality of types by hashing their trees from the leaves up, so that comparing is one join.

A type is a tree of rows (NODES). Names of type parameters don't matter: a reference to one becomes the
number of binders between it and its own (its de Bruijn index), counted from the innermost binder of that
name, so captured names tell the same both ways round; a name that nothing binds stays a name. Members of
unions and intersections are sets, also through nested ones of the same kind; members of objects are a
bag; all other children have places. A node's hash is that of its kind, its value and its children's
hashes in that order, and two types are the same if their roots' hashes are.

A tree's nodes lie together, dealt and sorted by tree; where they are dealt by it already nothing is
shuffled. Tasks take batches of whole trees, find parents, levels and binders by columns, and hash from the
deepest level up, each different node of a batch once; only roots are written. Trees of more than `max_nodes`
nodes, which a task shouldn't hold, go level by level instead, with one join a level on the way down and one
grouping on the way up, where a node's children are one row while it is hashed. Both ways give the same hashes.
A tree with more than `max_levels` levels, or with an unsupported node, has no verdict. Nodes that no root
leads to aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from factloom.sources.tables import Rounds

#: tree: the type a node belongs to; node: an id of its own in its tree; parent: null at the root; value: what
#: the node says itself (a name, a literal, "optional", ...); binder: the scope that it opens, if any;
#: scope: of a reference to a type parameter, the scope it means, with the parameter's index as value.
NODES = "tree string, node long, parent long, place int, kind string, value string, binder string, scope string"

#: Kinds whose members are a set, kinds whose members are a bag, and two that give no verdict.
SETS = ("union", "intersection")
BAGS = ("object",)
UNSUPPORTED, UNKNOWN, UNDEFINED = "unsupported", "unknown", "undefined"

#: The most nodes of a tree that a task holds whole, and the fewest of a batch of trees.
MAX_LEVELS, MAX_NODES, BATCH = 48, 200_000, 50_000
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
_HASHED = "tree string, kind string, hash string, bare string, state string"


def _hash(kind: Column, value: Column, members: Column) -> Column:
    sized = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(sized(kind), sized(value), F.array_join(members, "")), 256)


def _hash_of(kind: str | None, value: str | None, members: tuple[str, ...]) -> str:
    """The same as `_hash`."""
    sized = ["-" if x is None else f"{len(x)}:{x}" for x in (kind, value)]
    return sha256("".join([*sized, *members]).encode()).hexdigest()


class _Known(dict[tuple[str | None, str | None, tuple[str, ...]], str]):
    """Hashes by what they are of, each taken once."""

    def __missing__(self, key: tuple[str | None, str | None, tuple[str, ...]]) -> str:
        h = self[key] = _hash_of(*key)
        return h


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, in tables of whole trees."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BATCH:
            t = pa.Table.from_batches(held)
            cut = pc.index(t["tree"], t["tree"][-1]).as_py()
            if cut:
                yield t.slice(0, cut)
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _texts(column: pa.Array) -> np.ndarray:
    d = column.dictionary_encode()
    return np.array([*d.dictionary.to_pylist(), None], object)[d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)]


def _depths(up: np.ndarray, root: np.ndarray, max_levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's distance from its root, -1 where no root leads or beyond the levels; the first nodes beyond."""
    depth = np.where(root, 0, -1)
    rest, level = np.flatnonzero(up >= 0), 0
    while True:
        now = rest[depth[up[rest]] == level]
        level += 1
        if not len(now) or level >= max_levels:
            return depth, now
        depth[now] = level
        rest = rest[depth[rest] < 0]


def _says(value: np.ndarray, binder: pa.Array, scope: pa.Array, up: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Values, with references to type parameters by the nearest binder of the name: its place from the inside."""
    n = len(up)
    names = pa.concat_arrays([binder, scope]).dictionary_encode()
    at = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    opens, means = at[:n], at[n:]
    asks = np.flatnonzero((means >= 0) & (depth >= 0))
    here, passed, found = up[asks], np.zeros(len(asks), int), np.zeros(len(asks), int)
    live = np.flatnonzero(here >= 0)
    while len(live):
        now = here[live]
        passed[live] += opens[now] >= 0
        met = opens[now] == means[asks[live]]
        found[live[met]] = passed[live[met]]
        here[live] = up[now]
        live = live[~met & (here[live] >= 0)]
    name, says = names.dictionary.to_pylist(), value.copy()
    for i, at_, m in zip(asks.tolist(), found.tolist(), means[asks].tolist()):
        says[i] = f"bound:{at_}:{value[i] or ''}" if at_ else f"free:{name[m]}:{value[i] or ''}"
    return says


def _folded(t: pa.Table, max_levels: int) -> Iterator[tuple[str, str | None, str, str, str]]:
    """The rows of `hashed` of whole trees."""
    col = {c: a.combine_chunks() for c, a in zip(t.column_names, t.columns)}
    long = lambda c: col[c].cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    n, root = t.num_rows, col["parent"].is_null().to_numpy(zero_copy_only=False)
    tree = col["tree"].dictionary_encode()
    trees = tree.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # a node's place among all ids, and its tree, are one number, by which parents are found
    ids, rank = np.unique(np.concatenate([long("node"), long("parent")]), return_inverse=True)
    own, asked = trees * len(ids) + rank[:n], trees * len(ids) + rank[n:]
    order = np.argsort(own, kind="stable")
    at = order[np.minimum(np.searchsorted(own, asked, sorter=order), n - 1)]
    up = np.where(~root & (own[at] == asked), at, -1)
    depth, beyond = _depths(up, root, max_levels)
    kind = _texts(col["kind"])
    says = _says(_texts(col["value"]), col["binder"], col["scope"], up, depth)
    # children lie side by side, in their parents' order
    order = np.lexsort((rank[:n], long("place"), up))
    order = order[(up[order] >= 0) & (depth[order] >= 0)]
    place = np.full(n, -1)
    place[order] = np.arange(len(order))
    begin, end = (np.searchsorted(up[order], np.arange(n), side) for side in ("left", "right"))
    # a union within a union gives its members in its own place
    gives = np.isin(kind, SETS) & (up >= 0) & (kind == kind[up])
    takes = np.zeros(n, bool)
    takes[up[gives]] = True
    bad = kind == UNSUPPORTED
    for level in range(depth.max(initial=0), 0, -1):
        now = np.flatnonzero((depth == level) & bad)
        bad[up[now]] = True
    known = _Known()
    leaf = np.flatnonzero((place >= 0) & (begin == end) & ~gives)
    told: list[str | None] = [None] * len(order)  # hashes of children
    for p, k, v in zip(place[leaf].tolist(), kind[leaf].tolist(), says[leaf].tolist()):
        told[p] = known[k, v, ()]
    given: dict[int, tuple[str, ...]] = {}
    rest = np.flatnonzero((depth >= 0) & ((begin < end) | gives | root))
    rest = rest[np.argsort(-depth[rest], kind="stable")]
    deep, names = np.isin(trees, trees[beyond]), tree.dictionary.to_pylist()
    undefined = known[UNDEFINED, None, ()]
    for i, p, k, v, b, e, g, t in zip(*(x[rest].tolist() for x in (np.arange(n), place, kind, says, begin, end, gives, takes))):
        kids = [x for j in range(b, e) for x in (given.pop(j) if j in given else (told[j],))] if t else told[b:e]
        members = tuple(sorted(set(kids)) if k in SETS else sorted(kids) if k in BAGS else kids)
        h = known[k, v, members]
        if p >= 0:
            told[p] = h
            if g:
                given[p] = members
            continue
        bare = h
        if k == "union":
            left = tuple(m for m in members if m != undefined)
            bare = left[0] if len(left) == 1 else known[k, v, left]
        yield names[trees[i]], k, h, bare, "deep" if deep[i] else "unsupported" if bad[i] else "known"


def _levels(nodes: DataFrame, rounds: Rounds, max_levels: int) -> list[DataFrame]:
    """The nodes by their distance from the root, each with the binders above it, outermost first, and its
    parent's kind; one level more than allowed if there is one."""
    opened = lambda above: F.when(F.col("binder").isNotNull(), F.concat(above, F.array("binder"))).otherwise(above)
    none = F.array().cast("array<string>")
    level, n = rounds.counted(nodes.where("parent IS NULL").withColumn("outer", F.lit(None).cast("string")).withColumn("above", none).withColumn("binders", opened(none)))
    out = []
    hop = nodes.where("parent IS NOT NULL")
    while n and len(out) <= max_levels:
        out.append(level)
        up = level.select(F.col("tree").alias("__t"), F.col("node").alias("__p"), F.col("kind").alias("outer"), F.col("binders").alias("above"))
        level, n = rounds.counted(hop.join(up, (F.col("tree") == F.col("__t")) & (F.col("parent") == F.col("__p"))).drop("__t", "__p").withColumn("binders", opened(F.col("above"))))
    return out


def _by_levels(nodes: DataFrame, rounds: Rounds, max_levels: int) -> DataFrame:
    """`hashed`, level by level over all trees at once; nodes have been put."""
    levels = _levels(nodes, rounds, max_levels)
    if not levels:
        return nodes.sparkSession.createDataFrame([], _HASHED)
    deep = levels.pop().select(F.col("tree").alias("__deep")).distinct() if len(levels) > max_levels else None
    # nearest binder of the name: its place from the inside, and the index; else the name itself
    at = F.array_position(F.reverse("above"), F.col("scope"))
    value = F.when(F.col("scope").isNull(), F.col("value")).when(at > 0, F.concat(F.lit("bound:"), at.cast("string"), F.lit(":"), F.coalesce("value", F.lit("")))).otherwise(F.concat(F.lit("free:"), "scope", F.lit(":"), F.coalesce("value", F.lit(""))))
    none = F.array().cast("array<string>")
    kids = None
    for k, level in reversed(list(enumerate(levels))):
        rows = level.select("tree", "node", "parent", "place", "kind", "outer", value.alias("says"))
        if kids is None:
            met = rows.withColumn("given", none).withColumn("bad", F.lit(False))
        else:
            met = rows.join(kids, (F.col("tree") == F.col("__t")) & (F.col("node") == F.col("__p")), "left").withColumn("given", F.coalesce("given", none)).withColumn("bad", F.coalesce("bad", F.lit(False)))
        kind = F.col("kind")
        members = F.when(kind.isin(*SETS), F.array_sort(F.array_distinct("given"))).when(kind.isin(*BAGS), F.array_sort("given")).otherwise(F.col("given"))
        met = met.withColumn("members", members).withColumn("hash", _hash(kind, F.col("says"), F.col("members"))).withColumn("bad", F.col("bad") | F.coalesce(kind == UNSUPPORTED, F.lit(False)))
        if not k:
            break
        # a union within a union gives its members in its own place
        gives = F.when(kind.isin(*SETS) & (kind == F.col("outer")), F.col("members")).otherwise(F.array("hash"))
        told = F.struct("place", "node", gives.alias("gives"))
        kids = met.groupBy(F.col("tree").alias("__t"), F.col("parent").alias("__p")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["gives"])).alias("given"), F.max("bad").alias("bad"))
        kids = rounds.put(kids)
    undefined = _hash(F.lit(UNDEFINED), F.lit(None).cast("string"), none)
    rest = F.array_remove("members", undefined)
    bare = F.when((F.col("kind") == "union") & (F.size(rest) == 1), rest[0]).when(F.col("kind") == "union", _hash(F.col("kind"), F.col("says"), rest)).otherwise(F.col("hash"))
    out = met.select("tree", "kind", "hash", bare.alias("bare"), F.when(F.col("bad"), "unsupported").otherwise("known").alias("state"))
    if deep is not None:
        out = out.join(deep, F.col("tree") == F.col("__deep"), "left").withColumn("state", F.when(F.col("__deep").isNotNull(), "deep").otherwise(F.col("state"))).drop("__deep")
    return out


def hashed(nodes: DataFrame, max_levels: int = MAX_LEVELS, max_nodes: int = MAX_NODES) -> DataFrame:
    """(tree, kind, hash, bare, state) of each tree of NODES: its root's kind and hash; `bare`, the hash without
    an `undefined` among a union's members; state known, unsupported or deep."""
    done, rounds, large = Rounds(nodes.sparkSession, "hashes"), Rounds(nodes.sparkSession, "types"), Observation()
    sized = nodes.select(*_COLUMNS).where("tree IS NOT NULL").withColumn("__n", F.count("*").over(Window.partitionBy("tree")))
    held = sized.observe(large, F.count_if(F.col("__n") > max_nodes).alias("n")).where(F.col("__n") <= max_nodes).drop("__n")
    kinds = pa.schema([(c.split()[0], pa.string()) for c in _HASHED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            columns = list(zip(*_folded(t, max_levels))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=kinds)

    out = done.put(held.mapInArrow(run, _HASHED))
    if large.get["n"]:
        rest = rounds.put(sized.where(F.col("__n") > max_nodes).drop("__n"))
        out = out.unionByName(done.put(_by_levels(rest, rounds, max_levels)))
        rounds.clean()
    return out


def verdicts(pairs: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(expected, observed, status) of pairs of trees, each side `hashed`: pass or fail; indeterminate where one
    is missing, unsupported or too deep, or the observed one is unknown and the expected isn't."""
    e = expected.select(F.col("tree").alias("__e"), F.col("kind").alias("__ek"), F.col("hash").alias("__eh"), F.col("state").alias("__es"))
    o = observed.select(F.col("tree").alias("__o"), F.col("kind").alias("__ok"), F.col("hash").alias("__oh"), F.col("state").alias("__os"))
    met = pairs.select("expected", "observed").join(e, F.col("expected") == F.col("__e"), "left").join(o, F.col("observed") == F.col("__o"), "left")
    known = F.coalesce((F.col("__es") == "known") & (F.col("__os") == "known"), F.lit(False)) & ~((F.col("__ok") == UNKNOWN) & (F.col("__ek") != UNKNOWN))
    return met.select("expected", "observed", F.when(~known, "indeterminate").when(F.col("__eh") == F.col("__oh"), "pass").otherwise("fail").alias("status"))
