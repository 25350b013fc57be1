import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import parse_query
from factloom.operators import body, completeness, conformance, diffs, facts, graph, ownership, search, states, statistics
from factloom.operators.facts import FactFilter

FACT = "fact_id string, namespace string, kind string, subject string, completeness struct<kind:string>, evidence array<struct<source:string>>, payload string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def joined(df):
    """The numbers of rows that the joins of a query gave."""
    out = []

    def visit(plan):
        kind = plan.getClass().getSimpleName()
        inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
        if "Join" in kind:
            out.append(plan.metrics().apply("numOutputRows").value())
        for p in [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]:
            visit(p)

    df.collect()
    visit(df._jdf.queryExecution().executedPlan())
    return out


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(f"f{i:03}", "ab"[i % 2], "k", f"s{i % 5}", (("complete", "partial")[i % 3 == 0],), [(f"src{i % 4}",)] if i % 4 else [], "p") for i in range(50)], FACT).cache()


def test_filter_none_is_all_and_empty_is_nothing(some):
    assert facts.select(some, FactFilter()).count() == 50
    for name in ("namespaces", "kinds", "subjects", "sources", "symbols", "completeness"):
        assert facts.select(some, FactFilter(**{name: ()})).count() == 0
    assert facts.select(some, FactFilter(namespaces=("a",), sources=("src1", "src2"))).count() == 12
    assert facts.select(some, FactFilter(subjects=("s1", "s2"), symbols=("s2", "s3"))).count() == 10
    assert "payload" not in facts.headers(some).columns


def test_pages_make_the_export(some):
    f, got, cursor = FactFilter(namespaces=("a",)), [], None
    while True:
        p = facts.page(some, f, "g1", 7, cursor, total=True)
        got += [r.fact_id for r in p.rows]
        assert p.total == 25
        cursor = p.cursor
        if cursor is None:
            break
    assert got == [r.fact_id for r in facts.export(some, f).collect()]


@pytest.mark.parametrize("limit", [0, -1, 10_001, 1.5, True])
def test_page_limits(some, limit):
    with pytest.raises(ValueError):
        facts.page(some, FactFilter(), "g", limit)


def test_cursor_is_bound(some):
    c = facts.page(some, FactFilter(), "g1", 1).cursor
    assert facts.page(some, FactFilter(), "g1", 10_000, c).cursor is None
    for f, g in ((FactFilter(kinds=("k",)), "g1"), (FactFilter(), "g2")):
        with pytest.raises(ValueError):
            facts.page(some, f, g, 1, c)


def test_lookup_and_merge(some, spark):
    assert [r.fact_id for r in facts.by_id(some, ["f003", "f001", "f001", "nope"]).collect()] == ["f001", "f003"]
    assert facts.by_id(some, []).count() == 0
    new = some.limit(1).withColumn("fact_id", F.lit("g1"))
    assert facts.merged(some, new).count() == 51
    with pytest.raises(Exception, match="id of a base fact"):
        facts.merged(some, some.limit(1)).collect()


def test_duplicates_and_nested_evidence(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None), (5, None)], "id int, t string")
    assert rows(facts.duplicates(d, ["t"], "id")) == [(3, 1), (5, 4)]
    n = facts.nested_evidence(d.select("id"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, o int, v string"), "id", "o", ["v"])
    got = {r.id: [e.v for e in r.evidence] for r in n.collect()}
    assert got[1] == ["a", "b"] and got[2] == []


def test_diff(spark):
    a = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", 1)], "k string, v int")
    b = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("e", 1)], "k string, v int")
    assert rows(diffs.diff(a, b, "k", "v")) == [("b", "changed"), ("d", "removed"), ("e", "added")]
    assert diffs.equal_sets(a, a) and not diffs.equal_sets(a, b)


def test_completeness_is_free_of_order(spark):
    given = [("g", "complete", ["z"]), ("g", "partial", ["b", "a"]), ("g", "partial", ["a"]), ("h", "complete", []), ("i", "unavailable", ["x"]), ("i", "partial", ["y"])]
    want = [("g", "partial", ["a", "b"]), ("h", "complete", []), ("i", "unavailable", ["x"])]
    for p in itertools.islice(itertools.permutations(given), 0, 720, 240):
        assert rows(completeness.fold(spark.createDataFrame(list(p), "k string, level string, reasons array<string>"), ["k"])) == want


def test_capability_rollup(spark):
    seeds = spark.createDataFrame([("c1",), ("c2",)], "capability string")
    shards = spark.createDataFrame([("n1", ["c1"], "partial", ["s"]), ("n2", None, "complete", [])], "namespace string, capabilities array<string>, level string, reasons array<string>")
    fs = spark.createDataFrame([("n1", "unavailable", ["f"]), ("n2", "complete", [])], "namespace string, level string, reasons array<string>")
    assert rows(completeness.capability_rollup(seeds, shards, fs)) == [("c1", "unavailable", ["f"]), ("c2", "complete", []), ("n1", "unavailable", ["f"]), ("n2", "complete", [])]


def test_status_rankings_differ(spark):
    d = spark.createDataFrame([("fail",), ("indeterminate",), ("pass",)], "s string")
    s = F.col("s")
    assert d.agg(completeness.status(s, completeness.POLICY), completeness.status(s, completeness.CONFORMANCE)).first()[:] == ("indeterminate", "fail")
    assert spark.createDataFrame([("idle",), ("pass",)], "s string").agg(completeness.obligation(s)).first()[0] == "indeterminate"


def test_statistics_vectors(spark):
    d = spark.createDataFrame([(v, 1, str(v)) for v in (4, 3, 2, 1)], "code long, bytes long, path string")
    r = d.agg(*statistics.summary()).first()
    assert (r.files, r.average, r.median, r.p95, r.largest) == (4, 2.5, 2, 4, "4")
    assert d.where("false").agg(statistics.percentile("code", 0.5).alias("p")).first().p == 0
    ties = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "0")], "code long, bytes long, path string")
    assert ties.agg(statistics.largest("code", "bytes", "path"), statistics.largest("code", None, "path")).first()[:] == ("a", "0")
    g = statistics.grouped(spark.createDataFrame([("x", None), ("y", "p")], "l string, p string"), {"l": F.col("l"), "package": F.col("p")}, [F.count("*").alias("n")])
    assert rows(g) == [("l", "x", 1), ("l", "y", 1), ("package", "p", 1), ("package", "unassigned", 1)]
    m = statistics.grouped_many(spark.createDataFrame([(["a", "a", "b"],)], "k array<string>"), "d", F.col("k"), [F.count("*").alias("n")])
    assert rows(m) == [("d", "a", 1), ("d", "b", 1)]


def test_incremental_equals_cold(spark):
    def analyze(df):
        return df.withColumn("n", F.length("text"))

    inv = spark.createDataFrame([("a", "1", "xx"), ("b", "2", "yyy"), ("c", "1", "z")], "source string, revision string, text string")
    none = spark.createDataFrame([], "source string, revision string, n int, analyzer string, level string")
    old = spark.createDataFrame([("a", "1", 99, "v1", "complete"), ("b", "1", 98, "v1", "complete"), ("c", "1", 97, "v0", "complete"), ("d", "1", 1, "v1", "complete")], none.schema)
    got = {r.source: r.n for r in statistics.refresh(old, inv, analyze, "v1", ["n"]).collect()}
    assert got == {"a": 99, "b": 3, "c": 1}
    cold = statistics.refresh(none, inv, analyze, "v1", ["n"])
    assert rows(statistics.refresh(cold, inv, analyze, "v1", ["n"])) == rows(cold)


def test_owners(spark):
    paths = spark.createDataFrame([("a/b/c",), ("ab",), ("a",), ("z",)], "path string")
    owners = spark.createDataFrame([("o1", "a"), ("o2", "a/b"), ("o3", "a/b"), ("o4", "ab/x")], "owner string, root string")
    assert rows(ownership.deepest(paths, owners).select("path", "owner")) == [("a", "o1"), ("a/b/c", "o2"), ("a/b/c", "o3")]
    assert rows(ownership.tree_parent(spark.createDataFrame([("a",), ("a/b/c",), ("a/b/c/d",)], "path string"))) == [("a", None), ("a/b/c", "a"), ("a/b/c/d", "a/b/c")]
    t = spark.createDataFrame([(".",), ("o4",), ("a",), ("a/b/q/r",), ("none",)], "target string")
    got = {}
    for r in ownership.resolve_targets(t, owners).collect():
        got.setdefault(r.target, set()).add(r.owner)
    assert got == {".": {"o1", "o2", "o3", "o4"}, "o4": {"o4"}, "a": {"o1", "o2", "o3"}, "a/b/q/r": {"o2", "o3"}}


def reach(edges, seeds):
    dist, todo = {s: 0 for s in seeds}, list(seeds)
    while todo:
        x = todo.pop(0)
        for a, b in edges:
            if a == x and b not in dist:
                dist[b] = dist[x] + 1
                todo.append(b)
    return dist


def test_closures_by_hand(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(45)] + [(5, 5), (1, 2), (2, 1)]
    e, s = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(1,), (7,), (99,)], "node int")
    want = reach(edges, [1, 7, 99])
    assert dict(rows(graph.closure(e, s))) == want
    back = reach([(b, a) for a, b in edges], [1, 7, 99])
    assert rows(graph.impact(e, s)) == sorted(((n, "direct" if d == 0 else "dependent") for n, d in back.items()), key=repr)
    whole = reach(edges, list(back))
    assert rows(graph.selection(e, s)) == sorted(((n, "selected" if n in back else "support") for n in whole), key=repr)
    assert {r.node: len(r.path) - 1 for r in graph.paths(e, s).collect()} == want
    assert graph.closure(e, s.where("false")).count() == 0


def test_cycles_aliases_and_degrees(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (0, 1)], "src int, dst int")
    assert rows(graph.cycles(e)) == [(1, 1), (2, 1), (3, 1), (6, 6)]
    a = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 11), (5, 5)], "node int, target int")
    assert dict(rows(graph.follow(a))) == {1: 4, 2: 4, 3: 4, 10: 11, 11: 11, 12: 11}
    assert dict((r.node, (r.inbound, r.outbound)) for r in graph.degrees(e).collect())[3] == (1, 2)


def test_bodies(spark):
    o = spark.createDataFrame([(1, "f", "x", "definition"), (2, "f", "x", "use"), (3, "f", "y", "use"), (4, "g", "x", "use"), (5, "f", None, "use")], "id int, function string, symbol string, kind string")
    assert rows(body.def_use(o)) == [("f", "x", 1, 2)] and rows(body.captures(o)) == [("f", "y"), ("g", "x")]
    c = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["p", "q"], True), (2, ["a", "b"], ["p"], False), (3, [], ["p"], True)], "call int, arguments array<string>, parameters array<string>, has_rest boolean")
    assert rows(body.bind_arguments(c)) == [(1, "a", "p", 0, False), (1, "b", "q", 1, True), (1, "c", "q", 2, True), (1, "d", "q", 3, True), (2, "a", "p", 0, False)]
    span = "id int, source string, revision string, start int, end int"
    inner = spark.createDataFrame([(1, "s", "r", 5, 6), (2, "s", "r", 1, 20), (3, "s", "q", 5, 6), (4, "s", "r", 12, 13)], span)
    outer = spark.createDataFrame([(10, "s", "r", 0, 20), (11, "s", "r", 4, 8)], span)
    assert rows(body.contained(inner, outer)) == [(2, 10), (4, 10)] and body.contained(inner, outer, False).count() == 4
    calls = spark.createDataFrame([("c1", "build", "main"), ("c2", "wrap", "main"), ("c3", "param", "wrap"), ("c4", "other", "main")], "call string, target string, function string")
    binds = spark.createDataFrame([("c2", "build", "param")], "call string, argument_symbol string, parameter string")
    assert rows(body.builder_calls(calls, binds, "build")) == [("c1", None), ("c2", "wrap")]
    # a wrapper that calls its parameter from many places is met once for each call of it
    calls = spark.range(600).selectExpr("concat('w', id) AS call", "'wrap' AS target", "'main' AS function").unionByName(spark.range(500).selectExpr("concat('p', id) AS call", "'param' AS target", "'wrap' AS function"))
    binds = spark.range(600).selectExpr("concat('w', id) AS call", "'build' AS argument_symbol", "'param' AS parameter")
    found = body.builder_calls(calls, binds, "build")
    assert found.count() == 600 and max(joined(found)) <= 600
    occ = spark.createDataFrame([("o1",), ("o2",), ("o3",)], "id string")
    blocks = spark.createDataFrame([("b1", "o1"), ("b2", "o1"), ("b1", "o2"), ("b1", "o9")], "block string, occurrence string")
    edges = spark.createDataFrame([("b1", "b2"), ("b2", "b7")], "src string, dst string")
    assert rows(body.topology_errors(occ, blocks, edges)) == [("BLOCK_UNKNOWN", "b7"), ("OCCURRENCE_REPEATED", "o1"), ("OCCURRENCE_UNKNOWN", "o9"), ("OCCURRENCE_UNPLACED", "o3")]


def test_values(spark):
    o = spark.createDataFrame([("l1", "1"), ("l2", "2"), ("a", None), ("b", None), ("c", None), ("d", None), ("x", None), ("y", None)], "id string, value string")
    s = spark.createDataFrame([("a", "l1"), ("b", "a"), ("b", "l2"), ("c", "d"), ("x", "y"), ("y", "x"), ("l1", "l2")], "`id` string, `from` string")
    got = {r.id: (r.kind, r["values"], r.reason) for r in body.propagate(o, s).collect()}
    assert got["l1"] == ("known", ["1"], None) and got["a"] == ("known", ["1"], None) and got["b"] == ("ambiguous", ["1", "2"], "VALUE_ALTERNATIVES")
    assert got["c"][0] == got["d"][0] == "unknown" and got["c"][2] == "VALUE_NO_SEMANTIC_PATH" and got["x"][2] == "VALUE_DEPTH_LIMIT"
    assert {r.id: r.reason for r in body.propagate(o, s, max_alternatives=1).collect()}["b"] == "VALUE_ALTERNATIVE_LIMIT"


def test_conformance(spark):
    p = "path string, kind string"
    e = spark.createDataFrame([("src", "dir"), ("src/a", "file"), ("doc", "dir"), ("doc/b", "file"), ("x", "file")], p)
    o = spark.createDataFrame([("src", "dir"), ("src/a", "dir"), ("x", "file"), ("tmp", "dir"), ("tmp/log", "file"), ("new", "file")], p)
    got = {r.path: r.code for r in conformance.layout(e, o, ["tmp/**", "tmp", "x"]).collect()}
    assert got == {"src": "matched", "src/a": "mismatch", "doc": "missing", "doc/b": "suppressed", "x": "matched", "new": "additional"}
    obs = spark.createDataFrame([("a", "f.ts", ), ("b", "f.test.ts"), ("b", "f.ts"), ("c/x", "f.ts"), ("zz", "f.ts")], "package string, file string")
    dec = spark.createDataFrame([("a", False), ("b", True), ("c*", False)], "package string, dev boolean")
    assert rows(conformance.packages(obs, dec)) == [("a", "f.ts", "declared"), ("b", "f.test.ts", "declared"), ("b", "f.ts", "development-only"), ("c/x", "f.ts", "declared"), ("zz", "f.ts", "undeclared")]
    cand = spark.createDataFrame([("e", "d", False), ("e", "a1", True), ("f", "a1", True), ("f", "a2", True)], "expected string, observed string, alias boolean")
    assert rows(conformance.bind_seeds(cand)) == [("e", "d")]
    ob = spark.createDataFrame([("o1",), ("o2",)], "obligation string")
    res = spark.createDataFrame([("o1", "pass"), ("o1", "idle")], "obligation string, status string")
    assert rows(conformance.resolve_obligations(ob, res)) == [("o1", "indeterminate", None), ("o2", "error", "OBLIGATION_UNEVALUATED")]
    refs = spark.createDataFrame([("r1", "f", "a"), ("r2", "f", "b"), ("r3", "f", "c")], "reference string, file string, id string")
    tests = spark.createDataFrame([("f", "a", "active", "p"), ("f", "a", "active", "p"), ("f", "b", "skip", "p")], "file string, id string, state string, package string")
    assert rows(conformance.evidence_of_tests(refs, tests)) == [("r1", "pass"), ("r2", "indeterminate"), ("r3", "fail")]
    assert rows(conformance.test_plan(tests)) == [("p", ["f"], 1)]
    own = spark.createDataFrame([("d", False, 1, "a/b", "o1"), ("d", True, 3, "a", "o2"), ("d", True, 2, "a", "o3")], "d string, exact boolean, depth int, directory string, owner string")
    assert rows(conformance.declaration_owner(own, ["d"])) == [("d", "o3")]


def test_search(spark):
    i = spark.createDataFrame([("s1", "core", "core api", "lib core", "kernel base", "fam", "active"), ("s2", "score", "score", "lib score", "", "fam", "active"), ("s3", "zzz", "zzz", "core zzz", "", "other", "draft")], "source string, name string, title string, path string, alias string, family string, status string")
    top = lambda q, **k: [(r.source, r.tier) for r in search.top(search.ranked(i, parse_query(q), **k)).collect()]
    assert top("core") == [("s1", 5), ("s3", 4), ("s2", 1)]
    assert top("kernel") == [("s1", 3)] and top("core family:other") == [("s3", 4)] and top("status:draft") == [("s3", 0)]
    assert top("", recent=["s3", "s1"])[0][0] == "s3"
    assert spark.range(1).select(search.push_recent(F.array(F.lit("b"), F.lit("a")), F.lit("a"), 2), search.toggle_pin(F.array(F.lit("a"), F.lit("b")), F.lit("c"), 2), search.toggle_pin(F.array(F.lit("a")), F.lit("a"))).first()[:] == (["a", "b"], ["b", "c"], [])


def test_references(spark):
    t = spark.createDataFrame([(1, r"use run() and name or run, \name both")], "id int, text string")
    s = spark.createDataFrame([("run", "r1", True), ("run", "r2", False), ("name", "n", False), ("both", "b1", True), ("both", "b2", True)], "name string, symbol string, callable boolean")
    assert rows(search.references(t, s, "id", "text")) == [(1, "name", "n"), (1, "run()", "r1")]


def test_states(spark):
    r = states.transitions(spark, {"a": {"go": "b"}, "b": {"back": "a", "end": "c"}})
    assert states.states(r).count() == 3 and states.illegal(r).count() == 3 * 3 - 3
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, "b")], "k int, t int, s string")
    assert rows(states.judged(states.observed(log, "k", "s", ["t"]), r)) == [("a", "b", 1, True), ("b", "b", 1, False)]
