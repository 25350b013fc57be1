"""Contracts, impact, observations, syntax, typed readers: hand-made cases beside the registered queries' SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import identity, syntax
from factloom.operators import body, conformance, contracts, facts, graph, impact
from factloom.operators import ledger as L
from factloom.plans import policy
from factloom.sources import documents, observations, repository

SPEC = "{}/.spec/api.d.ts"


def corpus(spark, names, resources=(), uses=(), authority=None):
    specs = spark.createDataFrame([(SPEC.format(n), n, (authority or {}).get(n, SPEC.format(n))) for n in names], "owner string, root string, authority string")
    res = spark.createDataFrame([(SPEC.format(n), f, p) for n, f, p in resources], "owner string, family string, path string")
    return specs, res, spark.createDataFrame([(SPEC.format(n), p) for n, p in uses], "owner string, path string")


def impacted(spark, tables, *changes):
    """What each changed (path, kind, ambiguous) makes stale: direct, dependent and other owners, completeness, reasons."""
    made = impact.impacts(spark.createDataFrame([(*c, *("change", False)[len(c) - 1 :]) for c in changes], "path string, kind string, ambiguous boolean"), *tables).collect()
    out = []
    for path, *_ in changes:
        mine = [x for x in made if x.path == path]
        by = lambda r: sorted(x.owner.split("/.spec")[0] for x in mine if x.relation == r)  # noqa: B023, E731
        out.append((by("direct"), by("dependent"), by("other"), mine[0].completeness, mine[0].reasons))
    return out


def test_impact_of_paths(spark):
    one = corpus(spark, ["provider", "consumer", "leaf"], [("provider", "source", "shared/decl.d.ts"), ("provider", "test", "../shared/t.ts"), ("provider", "test", "../../out.ts")], [("consumer", "shared/decl.d.ts"), ("leaf", SPEC.format("consumer")), ("leaf", "ext/a.d.ts")])
    got = impacted(spark, one, ("shared/decl.d.ts",), ("consumer/src/x.ts",), ("shared/t.ts",), ("ext/a.d.ts",), ("leaf/src/new.ts", "add"))
    assert got[0] == (["provider"], ["consumer", "leaf"], [], "exact", []) == got[2] and got[1] == (["consumer"], ["leaf"], [], "exact", [])
    # a file that no one owns, but one uses; sources that come or go change the graph itself
    assert got[3] == (["leaf"], [], [], "exact", []) and got[4] == (["leaf"], [], ["consumer", "provider"], "conservative-full", ["topology-ambiguity"])
    two = corpus(spark, ["left", "right"])
    got = impacted(spark, two, ("external/unknown.d.ts",), ("package.json",), ("tsconfig.base.json",), ("docs/notes.md",), ("docs/new.md", "add"), ("docs/odd.md", "add", True))
    assert got[0] == ([], [], ["left", "right"], "conservative-full", ["unknown-declaration"])
    assert got[1][4] == ["package-configuration"] and got[2][4] == ["typescript-configuration"]
    assert got[3] == ([], [], [], "exact", []) == got[4] and got[5][3:] == ("conservative-full", ["topology-ambiguity"])
    nested = corpus(spark, ["parent", "parent/child"], [("parent", "schema", "parent/.spec/a.schema.json")], authority={"parent": SPEC.format("shared")})
    got = impacted(spark, nested, ("parent/child/x.md",), ("parent/src/private.ts",), ("else/.spec/b.schema.json",), (SPEC.format("shared"),))
    assert got[0][0] == ["parent", "parent/child"] and got[1] == (["parent"], [], [], "exact", [])
    # what may be a schema concerns all owners of one; an authority's file those that it speaks for
    assert got[2][0] == ["parent"] == got[3][0]


def test_normal_paths(spark):
    cases = {"a/../b": "b", "./a//b": "a/b", "../a": None, "a/../../b": None, "a/b/..": "a", "a/..": None, "": None}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", impact.normal(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == cases


def test_opaque_exports_cover_what_is_below(spark):
    want = spark.createDataFrame([("m", "ns", "value", "ns", False, "ext", True, False, False, False, False), ("m", "gone", "value", "gone", False, None, False, False, False, False, False)], "module string, path string, kind string, name string, type_only boolean, source string, opaque boolean, facets boolean, factory boolean, typed boolean, external boolean")
    seen = spark.createDataFrame([("m", "ns", "value", "d1", False, "ext"), ("m", "ns.inner.deep", "class", "d2", False, None), ("m", "nsx", "class", "d3", False, None)], "module string, path string, kind string, declaration string, type_only boolean, source string")
    read = spark.createDataFrame([("d1", "ns", "value"), ("d2", "deep", "class"), ("d3", "nsx", "class")], "declaration string, name string, kind string")
    got = sorted((r.id, r.status, r.code) for r in contracts.exports(want, seen, read).collect())
    assert got == [
        ("module.export.gone.value", "fail", "MODULE_EXPORT_MISSING"), ("module.export.ns.value", "pass", None),
        ("observed.export.ns.value", "pass", None), ("observed.export.nsx.class", "fail", "MODULE_EXPORT_UNDECLARED"),
    ]


def test_typed_facts_fail_on_a_broken_one(spark):
    rows = spark.createDataFrame([("f1", "n", 1, '{"a": 1}'), ("f2", "m", 9, "nonsense"), ("f3", "n", 1, '{"a": "x"}')], "fact_id string, namespace string, schema_version int, payload string")
    rows = rows.selectExpr("*", "'k' AS kind", "'s' AS subject", "named_struct('kind', 'complete') AS completeness")
    c = facts.Contract("n", "struct<a: int>", 1, ("a",))
    assert facts.typed(rows.where("fact_id != 'f3'"), c).select("payload.a").collect()[0].a == 1
    with pytest.raises(Exception, match="breaks its contract: field:a"):
        facts.typed(rows, c).collect()
    with pytest.raises(Exception, match="expected one fact of n s, found 2"):
        facts.one_each(rows).collect()


def test_observations_keep_what_did_not_change(spark):
    store = L.MemoryLedger(spark)
    specs = spark.createDataFrame([("s1", "a/.spec", "a"), ("s2", ".spec", ".")], "spec string, folder string, root string")
    files = spark.createDataFrame([("x", "r1", "a/.spec/icon.svg", 5), ("y", "r2", "a/.history/old.md", 7), ("z", "r3", ".history/top.pdf", 9), ("w", "r4", "a/.spec/architecture.md", 1)], "source string, revision string, path string, bytes long")
    seen = {r.spec: json.loads(r.payload) for r in observations.context(specs, files).collect()}
    assert seen["s1"]["icon"]["media_type"] == "image/svg+xml" and seen["s1"]["architecture"]["presentation"] == "markdown" and [h["path"] for h in seen["s1"]["history"]] == ["a/.history/old.md"]
    assert [h["path"] for h in seen["s2"]["history"]] == [".history/top.pdf"] and "icon" not in seen["s2"]
    see = lambda text: {k: specs.select("spec", F.lit(text).alias("payload")) for k in observations.KINDS}
    first = observations.materialize(store, "u", specs, see("{}"), "m")
    assert store.facts(first).count() == 8 and observations.materialize(store, "u", specs, see("{}"), "m") == first
    # only s1 is looked at again; s2 keeps its shards
    again = observations.materialize(store, "u", specs, see('{"x":1}'), "m2", specs.where("spec = 's1'").select("spec"))
    assert sorted({(r.subject, r.payload) for r in store.facts(again).collect()}) == [("s1", '{"x":1}'), ("s2", "{}")]
    left = observations.materialize(store, "u", specs.where("spec = 's2'"), see("{}"), "m3")
    assert {r.subject for r in store.facts(left).collect()} == {"s2"}


def test_cycles_and_closures_by_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = sorted({(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(38)})
        reach = {(a, b) for a, b in edges}
        while (more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach):
            reach |= more
        df = spark.createDataFrame(edges, "src long, dst long")
        want = {a: min(b for x, b in reach if x == a and (b, a) in reach) for a in range(26) if (a, a) in reach}
        assert {r.node: r.cycle for r in graph.cycles(df, steps=2).collect()} == want
        hop = {}
        for a, b in edges:
            hop.setdefault(a, set()).add(b)
        far, level, d = {edges[0][0]: 0}, {edges[0][0]}, 0
        while level:
            d += 1
            level = {b for a in level for b in hop.get(a, ())} - set(far)
            far |= dict.fromkeys(level, d)
        for steps in (1, 3):
            assert {r.node: r.distance for r in graph.closure(df, spark.createDataFrame([(edges[0][0],)], "node long"), steps=steps).collect()} == far


def test_spans_by_brute_force(spark):
    rng = random.Random(4)
    span = lambda i, most: (i, rng.choice("ab"), "r", s := rng.randint(-40, 300), s + rng.choice([0, 1, 2, 7, 8, 9, 64, most]))
    outer, inner = [span(i, 250) for i in range(60)], [span(i, 16) for i in range(80)]
    schema = "id long, source string, revision string, start long, end long"
    got = body.contained(spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema), unique=False)
    want = sorted((i[0], o[0]) for i in inner for o in outer if i[1] == o[1] and o[3] <= i[3] and i[4] <= o[4])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_values_stop_at_their_bounds(spark):
    chain = [(i, None if i else "v") for i in range(16)]
    got = body.propagate(spark.createDataFrame(chain, "id long, value string"), spark.createDataFrame([(i, i - 1) for i in range(1, 16)], "id long, from long"))
    assert {r.id: r.reason for r in got.collect() if r.reason} == {13: "VALUE_DEPTH_LIMIT", 14: "VALUE_DEPTH_LIMIT", 15: "VALUE_DEPTH_LIMIT"}
    wide = body.propagate(spark.createDataFrame([(0, None)] + [(i, str(i)) for i in range(1, 41)], "id long, value string"), spark.createDataFrame([(0, i) for i in range(1, 41)], "id long, from long"))
    row = wide.where("id = 0").first()
    assert row.kind == "ambiguous" and row.reason == "VALUE_ALTERNATIVE_LIMIT" and len(row["values"]) == 32
    few = body.propagate(spark.createDataFrame([(0, None)] + [(i, "x") for i in range(1, 6)], "id long, value string"), spark.createDataFrame([(0, i) for i in range(1, 6)], "id long, from long"), max_steps=5)
    assert few.where("id = 0").first().reason == "VALUE_STEP_LIMIT"
    lost = body.propagate(spark.createDataFrame([(1, None)], "id long, value string"), spark.createDataFrame([(1, 99)], "id long, from long"))
    assert [(r.id, r.reason) for r in lost.collect()] == [(1, "VALUE_NO_SEMANTIC_PATH")]


def test_code_graph_is_free_of_ids(spark):
    def tables(shift):
        node = spark.createDataFrame([(shift + 1, "f", None, "function", "a.ts", 1, None), (shift + 2, "g", "m.g", "function", "a.ts", 5, shift + 1)], "id long, name string, qualified_name string, kind string, file string, line int, parent_id long")
        return {
            "node": node, "edge": spark.createDataFrame([(shift + 1, shift + 2, "call"), (shift + 1, 99999, "call")], "source_id long, target_id long, how string"),
            "block": spark.createDataFrame([(shift + 10, shift + 1, 0), (shift + 11, shift + 1, 1)], "id long, function_id long, block_index int"), "block_edge": spark.createDataFrame([(shift + 1, shift + 10, shift + 11)], "function_id long, source_block_id long, target_block_id long"),
            "vertex": spark.createDataFrame([(shift + 20, shift + 1, None, "parameter", "x", 0)], "id long, function_id long, node_id long, kind string, name string, param_index int"),
            "flow": spark.createDataFrame([(shift + 1, None, shift + 20, None)], "source_id long, target_id long, source_vertex_id long, target_vertex_id long"),
        }

    a, b = documents.code_graph(tables(0)), documents.code_graph(tables(500))
    lines = sorted(tuple(r) for r in a.collect())
    assert lines == sorted(tuple(r) for r in b.collect()) and len(lines) == 2 + 1 + 2 + 1 + 1 + 1
    assert documents.graph_digest(a).first()[0] == documents.graph_digest(b.repartition(3)).first()[0]


def test_literals_and_ids(spark):
    rows = [("StringLiteral", 'a"b'), ("NumericLiteral", "0x"), ("NumericLiteral", "1.5"), ("TrueKeyword", "true"), ("NewExpression", "x"), (None, None), ("Identifier", "x")]
    got = [tuple(r.v) for r in spark.createDataFrame(rows, "k string, t string").select(syntax.literal(F.col("k"), F.col("t")).alias("v")).collect()]
    assert got == [("known", '{"v":"a\\"b"}', None), ("unknown", None, "DYNAMIC_EXPRESSION"), ("known", '{"v":1.5}', None), ("known", '{"v":true}', None), ("unsupported", None, None), ("unknown", None, "VALUE_ABSENT"), ("unknown", None, "DYNAMIC_EXPRESSION")]
    df = spark.createDataFrame([(1, None, " ")], "b int, a string, c string")
    assert df.select(identity.canonical_column("c", "b", "a")).first()[0] == identity.canonical_json({"a": None, "b": 1, "c": " "})
    value = {"x": [1, "é"]}
    text = spark.createDataFrame([(identity.canonical_json(value),)], "v string")
    assert text.select(identity.derive_id("fact", "n", F.col("v"))).first()[0] == identity.derive_value_id("fact", "n", value)
    assert identity.snapshot_set_id("i", {"u": "1", "v": "2"}) == identity.snapshot_set_id("i", {"v": "2", "u": "1"}) != identity.snapshot_set_id("j", {"u": "1", "v": "2"})
    assert identity.qualification_id("s", "a", "x", [("r", "pass"), ("q", "fail")]) == identity.qualification_id("s", "a", "x", [("q", "fail"), ("r", "pass")])
    assert spark.createDataFrame([(["a/b", "~", "0"],), ([],)], "p array<string>").select(identity.json_pointer(F.col("p"))).collect() == [("/a~1b/~0/0",), ("",)]


def test_rules_over_tests_schemas_and_families(spark):
    tests = spark.createDataFrame([("f", "1", "active"), ("f", "1", "active"), ("f", "2", "todo")], "file string, id string, state string")
    assert sorted(tuple(r) for r in conformance.test_counts(tests).collect()) == [("active", 1), ("todo", 1)]
    rule = conformance.schema_rule(spark.createDataFrame([("a", None), ("b", "SCHEMA_ID_MISSING")], "path string, code string"), spark.createDataFrame([("m", "a"), ("n", "a"), ("n", "b"), ("o", "zz")], "owner string, path string"))
    assert sorted((r.owner, r.status, r.codes) for r in rule.collect()) == [("m", "pass", []), ("n", "fail", ["SCHEMA_ID_MISSING"]), ("o", "fail", ["SCHEMA_MISSING"])]
    edges = spark.createDataFrame([("a", "npm:x", "import", 1), ("a", "npm:y", "import", 2), ("a", "b", "import", 4)], "src string, dst string, kind string, declarations long")
    rolled = graph.rolled_up(edges, spark.createDataFrame([("npm:x", "npm"), ("npm:y", "npm")], "node string, family string"), "declarations")
    assert sorted(tuple(r) for r in rolled.collect()) == [("a", "b", "import", False, 4), ("a", "npm", "import", True, 3)]


def test_inventory_asks_classifiers_first(spark):
    files = spark.createDataFrame([("src/a.ts", 1, "d", "text", None), ("gen/b.ts", 1, "d", "text", None)], "path string, bytes long, digest string, content string, body binary")
    mine = lambda p: ({"provenance": F.when(p.startswith("gen/"), "generated").otherwise("unknown")}, F.array(F.lit("mine")))
    got = {r.path: (r.provenance, r.purpose, r.evidence) for r in repository.inventory(files, classifiers=[(5, "mine", mine)], wanted={"purpose": ["implementation"]}).collect()}
    assert got == {"src/a.ts": ("authored", "implementation", ["mine"]), "gen/b.ts": ("generated", "implementation", ["mine"])}


def test_profiles_of_rules(spark):
    rules = {"module.core": "structure", "module.package.x": "dependencies", "observed.dependency.e": "dependencies", "module.import.type.k": "dependencies", "module.class.k.field.f": "surface", "observed.export.a.value": "surface", "layout.file": "layout", "schema.catalog": "schema"}
    got = {r.r: r.p for r in spark.createDataFrame([(k,) for k in rules], "r string").select("r", policy.profile_of(F.col("r")).alias("p")).collect()}
    assert got == rules


def test_plans_of_fixpoints_grow_with_their_steps(spark, monkeypatch):
    """A step reads the one before once; a plan that reads it twice or three times doubles or triples with each step."""
    leaves, counted = [], graph.Rounds.counted

    def told(self, df, which=None):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return counted(self, df, which)

    monkeypatch.setattr(graph.Rounds, "counted", told)
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (0, 6)], "src long, dst long")
    assert {r.node: r.cycle for r in graph.cycles(ring, steps=4).collect()} == {1: 1, 2: 1, 3: 1, 6: 6}
    assert {r.node: r.distance for r in graph.closure(ring, spark.createDataFrame([(1,)], "node long"), steps=4).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert max(leaves) <= 4 + 3
