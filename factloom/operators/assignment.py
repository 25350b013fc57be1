"""Pairing off the members of two unordered sets, group by group, over the pairs that fit.

Without bindings a group is a bipartite graph, paired by augmenting paths. With bindings, a pair also says
which names of the left side stand for which of the right; a pairing holds if these agree one to one in
both directions. That is looked for by names, not by members: as long as the pairs of a largest pairing don't
agree, a name that they take in two ways is bound to each of its others in turn, or to none, and what is left
is paired again. So the work grows with the ways to bind the names of a group, and not with the ways to pair
its members.

Every group has a verdict, however many pairs it has, unless a caller sets bounds: then groups with more than
`max_edges` pairs, or whose search takes more than `max_steps` bindings, have none. A group's pairs are one row
in a task; members that fit the same others under the same bindings may be one id with a count, so that a large
group needn't have many pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the left side with those of the right that they stand for.
Names = tuple[tuple[str, str], ...]
#: Columns of how many members an id stands for.
COUNTS = ("left_members", "right_members")
#: The verdicts that a task remembers before it starts anew.
KNOWN = 100_000
#: A pair that fits: left, right, bindings; and the members that either id stands for, if they are counted.
Pair = tuple[str, str, list[tuple[str, str]]] | tuple[str, str, list[tuple[str, str]], int, int]


class _Spent(Exception):
    """The search took all its steps."""


def filled[L, R](choices: Mapping[L, list[R]], supply: Mapping[L, int], demand: Mapping[R, int]) -> dict[tuple[L, R], int]:
    """How many members of each left go with those of each right, the most in all that there can be: first what
    comes first, then by augmenting paths. Paths are kept in dictionaries, not on the stack."""
    spare, room = dict(supply), dict(demand)
    of: dict[R, dict[L, int]] = {j: {} for j in demand}  # right -> left -> members
    for i, js in choices.items():
        for j in js:
            n = min(spare[i], room[j])
            if n:
                of[j][i] = n
                spare[i] -= n
                room[j] -= n
    for start in choices:
        while spare[start]:
            came: dict[R, L] = {}  # right -> the left that it was reached from
            through: dict[L, R | None] = {start: None}  # left -> the right that it would leave
            queue, end = [start], None
            for i in queue:
                for j in choices[i]:
                    if j not in came:
                        came[j] = i
                        if room[j]:
                            end = j
                            break
                        for k in of[j]:
                            if k not in through:
                                through[k] = j
                                queue.append(k)
                if end is not None:
                    break
            if end is None:
                break
            path: list[tuple[L, R, R | None]] = []  # (left, the right that it takes, the one that it leaves)
            j: R | None = end
            while j is not None:
                path.append((came[j], j, through[came[j]]))
                j = through[came[j]]
            n = min(spare[start], room[end], *(of[b][i] for i, _, b in path if b is not None))
            spare[start] -= n
            room[end] -= n
            for i, a, b in path:
                of[a][i] = of[a].get(i, 0) + n
                if b is not None:
                    of[b][i] -= n
                    if not of[b][i]:
                        del of[b][i]
    return {(i, j): n for j, at in of.items() for i, n in at.items()}


def paired(choices: dict[int, list[int]]) -> dict[int, int]:
    """A largest pairing of lefts with rights, one of each."""
    return dict(filled(choices, dict.fromkeys(choices, 1), dict.fromkeys((j for js in choices.values() for j in js), 1)).keys())


def agreed[L, R](edges: Mapping[L, Mapping[R, Names]], supply: Mapping[L, int], demand: Mapping[R, int], max_steps: int | None = None) -> dict[tuple[L, R], int] | None:
    """A pairing, as `filled`, of all members of lefts whose bindings agree, or None. Each binding of a name that
    is tried is a step."""
    whole, steps = sum(supply.values()), 0
    number: dict[Names, int] = {}
    numbered = {i: [(j, number.setdefault(names, len(number))) for j, names in e.items()] for i, e in edges.items()}
    kinds = [names if len({a for a, _ in names}) == len({b for _, b in names}) == len(set(names)) else None for names in number]
    todo: list[dict[str, str | None]] = [{}]  # what left names are bound to; None: to nothing, so unused
    while todo:
        there = todo.pop()
        back = {b: a for a, b in there.items() if b is not None}
        fit = [names is not None and all(there.get(a, b) == b and back.get(b, a) == a for a, b in names) for names in kinds]
        choices = {i: [j for j, k in e if fit[k]] for i, e in numbered.items()}
        if not all(choices.values()):
            continue
        found = filled(choices, supply, demand)
        if sum(found.values()) < whole:
            continue
        taken = {x for i, j in found for x in edges[i][j]}
        lefts, rights = [a for a, _ in taken], [b for _, b in taken]
        torn = {a for a, b in taken if lefts.count(a) > 1 or rights.count(b) > 1}
        if not torn:
            return found
        ways = {a: {b for names, yes in zip(kinds, fit) if yes for x, b in names if x == a} for a in torn}
        name = min(torn, key=lambda a: (len(ways[a]), a))
        steps += 1
        if max_steps is not None and steps > max_steps:
            raise _Spent
        todo.append({**there, name: None})
        todo += [{**there, name: b} for b in sorted(ways[name], key=lambda b: ((name, b) in taken, b))]
    return None


def bound(edges: dict[int, dict[int, list[tuple[str, str]]]], max_steps: int | None = None) -> dict[int, int] | None:
    """A pairing of all lefts, one right for each, whose bindings agree, or None."""
    told = {i: {j: tuple(names) for j, names in e.items()} for i, e in edges.items()}
    found = agreed(told, dict.fromkeys(edges, 1), dict.fromkeys((j for e in edges.values() for j in e), 1), max_steps)
    return None if found is None else dict(found.keys())


def _rows_of(lists: pa.ListArray) -> Iterator[list[Pair]]:
    """The pairs of each group; the columns are unpacked once for a batch, not row by row."""
    rows, at = lists.values, lists.offsets.to_numpy().tolist()
    bindings = rows.field("bindings")
    names, ends = list(zip(_texts(bindings.values.field("left")), _texts(bindings.values.field("right")))), bindings.offsets.to_numpy().tolist()
    each = list(zip(_texts(rows.field("left")), _texts(rows.field("right")), (names[i:j] for i, j in zip(ends, ends[1:])), *(rows.field(c).to_numpy().tolist() for c in COUNTS if rows.type.get_field_index(c) >= 0)))
    return (each[i:j] for i, j in zip(at, at[1:]))


def _texts(column: pa.StringArray) -> list[str | None]:
    """A column's texts, each different one made once."""
    found = column.dictionary_encode()
    texts = [*found.dictionary.to_pylist(), None]
    return [texts[k] for k in found.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False).tolist()]


def _verdict(rows: list[Pair], max_steps: int | None) -> tuple[str, list[tuple[str, str, int]]]:
    """Of a group of which each member fits some other, with as many members on either side."""
    edges: dict[str, dict[str, Names]] = {}
    supply: dict[str, int] = {}
    demand: dict[str, int] = {}
    for left, right, names, *counts in rows:
        edges.setdefault(left, {})[right] = tuple(names)
        supply[left], demand[right] = counts or (1, 1)
    try:
        found = agreed(edges, supply, demand, max_steps)
    except _Spent:
        return "indeterminate", []
    return ("fail", []) if found is None else ("pass", [(i, j, n) for (i, j), n in sorted(found.items())])


def assigned(groups: DataFrame, edges: DataFrame, max_edges: int | None = None, max_steps: int | None = None) -> DataFrame:
    """(group, status, pairs) of groups (group, lefts, rights): pass with the pairs, fail, or, only where the
    caller's bounds end the search, indeterminate.

    edges: (group, left, right, bindings array<struct<left, right>>), ids as strings, one row a pair; with COUNTS
    too, ids stand for so many members each, and pairs say of how many `members`. lefts and rights are numbers
    of members. A group without members on either side passes.
    """
    counts = [c for c in COUNTS if c in edges.columns]
    crowd = F.lit(False)
    if max_edges is not None:
        size = edges.groupBy(F.col("group").alias("__s")).agg((F.count("*") > max_edges).alias("__crowd")).where("__crowd")
        edges = edges.join(size, F.col("group") == F.col("__s"), "left_anti")
        groups, crowd = groups.join(size, F.col("group") == F.col("__s"), "left").drop("__s"), F.coalesce("__crowd", F.lit(False))
    pair = F.struct("left", "right", "bindings", *(F.coalesce(F.col(c).cast("long"), F.lit(1)).alias(c) for c in counts))
    gathered = edges.groupBy(F.col("group").alias("__e")).agg(F.collect_list(pair).alias("__rows"))
    # a member that fits nowhere, or a side with more members, decides a group without a search
    lefts, rights = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("lefts", "rights"))

    def seen(side: str, count: str) -> Column:
        rows = F.coalesce("__rows", F.array().cast(gathered.schema["__rows"].dataType))
        if not counts:
            return F.size(F.array_distinct(rows[side]))
        return F.aggregate(F.array_distinct(F.transform(rows, lambda r: F.struct(r[side], r[count].alias("n")))), F.lit(0).cast("long"), lambda n, x: n + x["n"])

    whole = (lefts == rights) & (seen("left", COUNTS[0]) == lefts) & (seen("right", COUNTS[1]) == rights)
    told = F.when(crowd, "indeterminate").when(~whole, "fail")
    rows = groups.join(gathered, F.col("group") == F.col("__e"), "left").select("group", told.alias("__told"), "__rows")
    # groups with the same pairs have the same verdict, so a task looks for it once
    rows = rows.select("group", "__told", F.when(F.col("__told").isNull(), F.array_sort("__rows")).alias("__rows"))
    rows = rows.select("group", "__told", "__rows", F.when(F.col("__told").isNull(), F.sha2(F.coalesce(F.to_json("__rows"), F.lit("")), 256)).alias("__same"))
    kind = groups.schema["group"].dataType.simpleString()
    fields = [("left", pa.string()), ("right", pa.string()), *([("members", pa.int64())] if counts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, list[dict[str, str | int]]]] = {}
        for b in batches:
            if len(known) > KNOWN:
                known = {}
            same = b.column(3).to_pylist()
            new = {x: k for k, x in enumerate(same) if x is not None and x not in known}
            for x, pairs in zip(new, _rows_of(b.column(2).take(pa.array(new.values(), pa.int64())))):
                status, found = _verdict(pairs, max_steps)
                known[x] = status, [dict(zip(("left", "right", "members"), p[: len(fields)])) for p in found]
            told = [(status, []) if status else known[x] for status, x in zip(b.column(1).to_pylist(), same)]
            out = pa.array([p for _, p in told], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in told], pa.string()), out], names=["group", "status", "pairs"])

    return rows.mapInArrow(run, f"`group` {kind}, status string, pairs array<struct<left: string, right: string{', members: long' if counts else ''}>>")
