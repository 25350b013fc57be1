"""Control flow against a builder by recursion."""

import itertools
import random

from pyspark.sql import functions as F

from factloom.operators import flow
from factloom.sources.tables import Buckets


class Builder:
    """Edges, blocks and limits of one function: each statement gives its entry, its open ends and its breaks."""

    def __init__(self, function, rows):
        self.kids, self.kind, self.slot = {}, {}, {}
        for _, node, parent, slot, place, kind in sorted(rows, key=lambda r: (r[4], r[1])):
            self.kids.setdefault(parent, []).append(node)
            self.kind[node], self.slot[node] = kind, slot
        self.f, self.edges, self.blocks, self.codes = function, set(), {"entry", "exit"}, set()
        start, ends, breaks = self.visit(self.kids[None][0], None)
        self.put("entry", start or "exit", "fallthrough", None)
        for b, k, e in ends:
            self.put(b, "exit", k, e)
        for b, e in breaks:
            self.put(b, "exit", "fallthrough", e)
            self.codes.add("unresolvedBreak")

    def put(self, a, b, kind, evidence):
        self.edges.add((self.f, str(a), str(b), kind, evidence))

    def branch(self, node, slot, loop):
        for k in self.kids.get(node, []):
            if self.slot[k] == slot:
                return self.visit(k, loop)
        return None, [], []

    def visit(self, n, loop):
        kind = self.kind[n]
        if kind == "block":
            start, ends, breaks, open_ = None, [], [], True
            for k in self.kids.get(n, []):
                s, e, b = self.visit(k, loop)
                breaks += b
                if s is None:
                    continue
                if start is None:
                    start, ends, open_ = s, e, bool(e)
                elif open_:
                    for x, how, why in ends:
                        self.put(x, s, how, why)
                    ends, open_ = e, bool(e)
            return start, ends, breaks
        if kind in flow.PARTIAL:
            self.codes.add(flow.PARTIAL[kind])
        if kind == "labeled":
            return self.branch(n, "body", loop)
        self.blocks.add(str(n))
        if kind in ("return", "throw"):
            self.put(n, "exit", {"return": "return", "throw": "exception"}[kind], n)
            return n, [], []
        if kind == "break":
            return n, [], [(n, n)]
        if kind == "continue":
            if loop is None:
                self.codes.add("CFG_UNRESOLVED_CONTINUE")
                return n, [(n, "fallthrough", None)], []
            self.put(n, loop, "loop", n)
            return n, [], []
        if kind == "if":
            ends, breaks = [], []
            for slot, how in (("then", "true"), ("else", "false")):
                s, e, b = self.branch(n, slot, loop)
                breaks += b
                if s is None:
                    ends.append((n, how, n))
                else:
                    self.put(n, s, how, n)
                    ends += e
            return n, ends, breaks
        if kind in flow.LOOPS:
            s, e, b = self.branch(n, "body", n)
            do = kind == "do"
            if s is None:
                self.put(n, n, "loop", n)
            else:
                self.put(n, s, "loop" if do else "true", n)
                for x, _, why in e:
                    self.put(x, n, "fallthrough" if do else "loop", why)
            return (s or n) if do else n, [(n, "false", n)] + [(x, "fallthrough", why) for x, why in b], []
        return n, [(n, "fallthrough", n)], []


KINDS = ["plain"] * 5 + ["if", "if", "while", "for-of", "do", "labeled", "break", "continue", "return", "throw", "switch", "try", "block", "block"]


def random_rows(rng, f, ids, kind="block", parent=None, slot="body", place=0, depth=0):
    me = next(ids)
    out = [(f, me, parent, slot, place, kind)]
    sub = lambda k, s, p=0: random_rows(rng, f, ids, k, me, s, p, depth + 1)
    pick = lambda: rng.choice(KINDS if depth < 5 else KINDS[:5])
    if kind == "block":
        for k in range(rng.choice([0, 1, 2, 3, 4]) if depth else rng.randint(0, 6)):
            out += sub(pick(), "statement", k)
    elif kind == "if":
        out += sub(rng.choice(["block", pick()]), "then") + (sub(rng.choice(["block", pick()]), "else", 1) if rng.random() < 0.5 else [])
    elif kind in (*flow.LOOPS, "labeled"):
        out += sub(rng.choice(["block", pick()]), "body")
    elif kind in ("switch", "try"):
        out += sub("plain", "statement")  # inside, nothing is taken apart
    return out


def test_control_flow_by_recursion(spark):
    rng, ids = random.Random(11), itertools.count(1)
    made = {f"f{k}": random_rows(rng, f"f{k}", ids) for k in range(300)}
    want = [Builder(f, rows) for f, rows in made.items()]
    statements = spark.createDataFrame([r for rows in made.values() for r in rows], flow.STATEMENTS)
    edges, blocks, limits = flow.control_flow(statements)
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == set().union(*(b.edges for b in want)) and len(got) > 1500
    # statements that aren't entered from their own block's sequence are blocks all the same
    assert sorted(tuple(r) for r in blocks.collect()) == sorted((b.f, x) for b in want for x in b.blocks)
    assert sorted(tuple(r) for r in limits.collect()) == sorted((b.f, c) for b in want for c in b.codes)


def test_control_flow_bounds_and_places(spark):
    deep = [("d", k, k - 1 if k > 1 else None, "statement" if k > 1 else "body", 0, "block") for k in range(1, 6)]
    e, b, l = flow.control_flow(spark.createDataFrame(deep, flow.STATEMENTS), max_levels=4)  # noqa: E741
    assert [tuple(r) for r in l.collect()] == [("d", flow.TOO_DEEP)] and [tuple(r)[1:4] for r in e.collect()] == [("entry", "exit", "fallthrough")]
    none = flow.control_flow(spark.createDataFrame([], flow.STATEMENTS))
    assert [x.count() for x in none] == [0, 0, 0]
    nodes = spark.createDataFrame([("f", 1, None), ("f", 2, 1), ("f", 3, 2), ("f", 4, 3), ("f", 5, 4), ("f", 6, 1)], "function string, node long, parent long")
    placed = flow.blocks_of(nodes, spark.createDataFrame([("f", "2"), ("f", "entry")], "function string, block string"))
    assert {r.node: r.block for r in placed.collect()} == {1: "entry", 2: "2", 3: "2", 4: "2", 5: "2", 6: "entry"}


def test_control_flow_deals_statements_once(spark):
    rng, ids = random.Random(5), itertools.count(1)
    rows = [r for k in range(20) for r in random_rows(rng, f"f{k}", ids)]
    edges, blocks, limits = flow.control_flow(spark.createDataFrame(rows, flow.STATEMENTS))
    # sweeps shuffle nothing, and what they leave is read without a shuffle
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (edges, blocks))
    rounds = Buckets(spark, "test", "f", 3)
    t = rounds.put(spark.range(100).selectExpr("id div 7 AS f", "id", "id - 1 AS up").repartition(3, "f"))
    met = t.hint("merge").join(t.selectExpr("f AS __f", "id AS __id"), (F.col("f") == F.col("__f")) & (F.col("up") == F.col("__id")))
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 85
    none = rounds.put(t.where("id < 0"))
    assert rounds.free(none).count() == 0 and rounds.free(none, t).count() == 100
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert not [x for x in spark.catalog.listTables("default") if x.name.startswith("factloom_")]
