import pytest
from pyspark.sql import functions as F

from factloom.operators import ledger as L
from factloom.operators.facts import SCHEMA
from factloom.plans import passes as P
from factloom.plans import policy as Q
from factloom.sources import documents, repository
from factloom.streaming import changes


def shard(spark, key, *facts):
    made = [(key, None, i, "n", 1, "k", "s", ("complete", []), "p", "1", [("src", "r", 0, 1)], list(inputs), payload) for i, inputs, payload in facts]
    return spark.createDataFrame(made, "shard_key string, " + SCHEMA)


def code(f):
    with pytest.raises(L.LedgerError) as e:
        f()
    return e.value.code


def test_commits_share_shards_and_readers_stay_pinned(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "l"))
    g1 = led.commit("u", None, shard(spark, "a", ("f1", [], "1"), ("f2", ["f1"], "2")).unionByName(shard(spark, "b", ("f3", [], "3"))), capabilities=["c"])
    g2 = led.commit("u", g1, shard(spark, "a", ("f1", [], "new")), [])
    assert led.current("u") == g2 and g2.sequence == 2 and g1.id != g2.id
    ids = lambda g: sorted(r.fact_id + r.payload for r in led.facts(g).collect())
    assert ids(g1) == ["f11", "f22", "f33"] and ids(g2) == ["f1new", "f33"]
    assert [tuple(r) for r in led.changes(g1, g2).collect()] == [("a", "upsert")]
    g3 = led.commit("u", g2, shard(spark, "a"), ["b"])
    assert ids(g3) == ["f1new"] and [tuple(r) for r in led.changes(g2, g3).collect()] == [("b", "delete")]
    assert led.verify(g1).isEmpty() and led.orphans("u").isEmpty()
    # equal content has one id, whatever the way to it
    other = L.MemoryLedger(spark)
    assert other.commit("u", None, shard(spark, "a", ("f1", [], "new"))).id == g3.id
    hold = led.lease(g1)
    assert led.retain("u", 1) == [2] and ids(g1) and led.current("u") == g3
    led.release("u", hold)
    assert led.retain("u", 1) == [1] and led.orphans("u").count() == 2


def test_refused_transactions_change_nothing(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "l"))
    g = led.commit("u", None, shard(spark, "a", ("f1", [], "1")))
    assert code(lambda: led.commit("u", None, shard(spark, "b", ("f2", [], "")))) == "BASE_STALE"
    assert code(lambda: led.commit("u", g, shard(spark, "b"), ["zz"])) == "DELETE_UNKNOWN"
    assert code(lambda: led.commit("u", g, shard(spark, "b", ("f2", [], ""), ("f2", [], "")))) == "FACT_ID_DUPLICATE"
    assert code(lambda: led.commit("u", g, shard(spark, "b", ("f2", ["gone"], "")))) == "INPUT_DANGLING"
    assert code(lambda: led.generation("u", 9)) == "GENERATION_MISSING"
    assert led.current("u") == g and led.commit("u", g, shard(spark, "b", ("f2", ["f1"], ""))).sequence == 2


def test_quarantine_goes_back_to_the_newest_good_generation(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "l"))
    g1 = led.commit("u", None, shard(spark, "a", ("f1", [], "1")))
    g2 = led.commit("u", g1, shard(spark, "a", ("f1", [], "2")))
    led.manifest(g2).withColumn("shard_digest", F.lit("fact-shard-digest:bad")).write.parquet(str(tmp_path / "bad"))
    import shutil

    shutil.rmtree(tmp_path / f"l/u/manifests/{g2.attempt}")
    shutil.move(tmp_path / "bad", tmp_path / f"l/u/manifests/{g2.attempt}")
    assert led.quarantine("u") == [2] and led.current("u") == g1
    assert led.commit("u", g1, shard(spark, "a", ("f1", [], "3"))).sequence == 2


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = L.Ledger(spark, str(tmp_path / "l")), L.Ledger(spark, str(tmp_path / "l"))
    g = one.commit("u", None, shard(spark, "a", ("f1", [], "1")))
    # both pass the first check of their base; what is staged no one sees
    a, b = one.stage("u", g, shard(spark, "b", ("f2", [], "2"))), two.stage("u", g, shard(spark, "c", ("f3", [], "3")))
    assert one.current("u") == g and a.sequence == b.sequence == 2
    assert two.publish(b) == b
    assert code(lambda: one.publish(a)) == "BASE_STALE" and one.current("u") == b
    assert sorted(r.fact_id for r in one.facts(b).collect()) == ["f1", "f3"]
    assert [r.fact_id for r in one.facts(b, ["c"]).collect()] == ["f3"]
    # the loser's shard belongs to no generation; its facts go with the sweep, others stay
    assert one.orphans("u").count() == 1 and one.sweep("u") == 1 and one.orphans("u").isEmpty()
    assert sorted(r.fact_id for r in one.facts(b).collect()) == ["f1", "f3"] and one.verify(b).isEmpty()


def test_two_writers_of_one_shard_leave_each_fact_once(spark, tmp_path):
    one, two = L.Ledger(spark, str(tmp_path / "l")), L.Ledger(spark, str(tmp_path / "l"))
    g = one.commit("u", None, shard(spark, "a", ("f1", [], "1")))
    same = shard(spark, "b", ("f2", ["f1"], "2"), ("f3", [], "3")).unionByName(shard(spark, "a", ("f1", [], "1")))
    a, b = one.stage("u", g, same), two.stage("u", g, same)
    # a sweep between staging and publishing takes nothing that is staged
    assert one.sweep("u") == 0 and two.publish(b) == b
    assert code(lambda: one.publish(a)) == "BASE_STALE"
    assert sorted(r.fact_id for r in one.facts(b).collect()) == ["f1", "f2", "f3"] and one.verify(b).isEmpty()
    assert {r.shard_key: r.attempt for r in one.manifest(b).collect()} == {"a": g.attempt, "b": b.attempt}
    assert [tuple(r)[0] for r in one.orphans("u").collect()] == [a.attempt] and one.sweep("u") == 1
    assert one.facts(b).count() == 3 and one.verify(b).isEmpty() and one.orphans("u").isEmpty()
    # a writer that never comes back is swept when its time is over
    one.stage("u", b, shard(spark, "c", ("f4", [], "4")))
    assert one.sweep("u") == 0 and one.sweep("u", 0) == 1 and one.facts(b).count() == 3


def test_upserts_are_evaluated_once(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "l"))
    moody = shard(spark, "a", ("f1", [], "1"), ("f2", ["f1"], "2")).withColumn("payload", F.uuid())
    g = led.commit("u", None, moody)
    assert led.verify(g).isEmpty() and led.facts(g).count() == 2


def test_a_fact_that_others_need_cant_go(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "l"))
    g = led.commit("u", None, shard(spark, "a", ("f1", [], "1")).unionByName(shard(spark, "b", ("f2", ["f1"], "2"))).unionByName(shard(spark, "c", ("f3", [], "3"))))
    assert code(lambda: led.commit("u", g, shard(spark, "x"), ["a"])) == "INPUT_DANGLING"
    assert code(lambda: led.commit("u", g, shard(spark, "a", ("f9", [], "1")))) == "INPUT_DANGLING"
    # with its consumer, or while it moves to another shard, it can
    moved = led.commit("u", g, shard(spark, "d", ("f1", [], "1")), ["a"])
    assert led.commit("u", moved, shard(spark, "x"), ["d", "b"]).sequence == 3


def test_leases_renew_and_end(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "l"))
    g1 = led.commit("u", None, shard(spark, "a", ("f1", [], "1")))
    led.commit("u", g1, shard(spark, "a", ("f1", [], "2")))
    short = led.lease(g1, -1)
    assert code(lambda: led.renew(g1, short)) == "LEASE_ENDED"
    name = led.lease(g1, 30)
    assert led.renew(g1, name, 60) == name and len(led._lease_files("u", name)) == 1
    assert led.retain("u", 1) == []
    led.release("u", name)
    assert led.retain("u", 1) == [1]


def test_rollover_is_whole_and_without_the_old_lineage(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "l"))
    old = led.commit("u", None, shard(spark, "a", ("f1", [], "1")))
    new = led.rollover("u", "v", shard(spark, "a", ("f1", [], "1")).unionByName(shard(spark, "b", ("f2", [], "2"))))
    assert new.sequence == 1 and new.universe == "v" and led.current("u") == old
    again = led.rollover("u", "v", shard(spark, "b", ("f2", [], "3")))
    assert again.sequence == 2 and [(r.fact_id, r.payload) for r in led.facts(again).collect()] == [("f2", "3")]
    assert code(lambda: led.rollover("u", "u", shard(spark, "b"))) == "UNIVERSE_SAME"


def test_store_selection(spark, tmp_path):
    assert L.select_store(spark, str(tmp_path / "x"))[1] is None
    led, why = L.select_store(spark, None, "advisory")
    assert isinstance(led, L.MemoryLedger) and "STORE_UNCONFIGURED" in why
    assert code(lambda: L.select_store(spark, None)) == "STORE_UNCONFIGURED"


def p(id, requires=(), provides=(), inputs=(), outputs=(), **more):
    return P.Pass(id, requires=requires, provides=provides, inputs=inputs, outputs=outputs, **more)


def test_plans(spark):
    a = p("a", provides=("ca",), outputs=(("na", 2),))
    b = p("b", requires=("ca",), provides=("cb",), inputs=(P.Need("na", 1, 2),))
    assert [x.id for x in P.plan([b, a], ["cb"])] == ["a", "b"]
    assert [x.id for x in P.plan([b, a], ["cb"], ["ca"], {"na": 1})] == ["b"]
    for passes, wanted, schemas, want in (
        ([b], ["cb"], {}, "INPUT_MISSING"),
        ([a, p("a2", provides=("ca",))], ["ca"], {}, "PROVIDER_REPEATED"),
        ([p("x", ("cy",), ("cx",)), p("y", ("cx",), ("cy",))], ["cx"], {}, "PASS_CYCLE"),
        ([a, p("c", provides=("cc",), inputs=(P.Need("na", 3, 3),))], ["cc"], {}, "SCHEMA_INCOMPATIBLE"),
        ([a], ["ca"], {"na": 1}, "OUTPUT_REPLACES_BASE"),
    ):
        with pytest.raises(P.PlanError) as e:
            P.plan(passes, wanted, (), schemas)
        assert e.value.code == want
    order = P.plan([b, a], ["cb"])
    assert P.invalidated(order, {("na", 2)}, set()) == [] and [x.id for x in P.invalidated(order, {("na", 2)}, {"na"})] == ["b"]
    assert [x.id for x in P.invalidated(order, set(), set())] == ["a", "b"]
    assert P.selects("*", "x") and P.selects("a.*", "a.b") and not P.selects("a.*", "ab") and P.selects("a", "a")


def test_passes_run_in_scope(spark):
    base = spark.createDataFrame([("n0", "f0"), ("secret", "f1")], "namespace string, fact_id string")
    make = lambda ns, needs: lambda s: s.read(*needs).select(F.lit(ns).alias("namespace"), F.concat("fact_id", F.lit(ns)).alias("fact_id"))
    a = P.Pass("a", make("n1", ["n0"]), (P.Need("n0"),), (("n1", 1),), provides=("c",))
    peek = P.Pass("b", make("n2", ["secret"]), (P.Need("n1"),), (("n2", 1),), optional=True)
    out = P.run([a, peek], base)
    assert sorted(r.fact_id for r in out.facts.collect()) == ["f0", "f0n1", "f1"] and out.completion == {"n1": "complete", "n2": "unavailable"} and "NAMESPACE_UNDECLARED" in out.reasons["b"]
    with pytest.raises(Exception, match="made a fact of"):
        P.run([P.Pass("x", make("n9", ["n0"]), (P.Need("n0"),), (("n1", 1),))], base).facts.collect()
    # a fault that shows only while Spark runs is the pass's own
    fails = P.Pass("f", lambda s: s.read("n0").select(F.lit("n3").alias("namespace"), F.raise_error("boom").cast("string").alias("fact_id")), (P.Need("n0"),), (("n3", 1),), optional=True)
    out = P.run([fails, a], base)
    assert out.completion == {"n3": "unavailable", "n1": "complete"} and "boom" in out.reasons["f"] and out.facts.count() == 3


def test_policies(spark):
    f = spark.range(1)
    rules = lambda *r: lambda _: spark.createDataFrame(list(r), "rule string, status string")
    pol = Q.Policy("p", ("r1", "r2"), rules(("r1", "pass"), ("r1", "fail"), ("r2", "pass")), ("c",), {"r2": ("d",)})
    assert Q.run(pol, f, {"c": "complete", "d": "complete"}) == [("r1", "fail"), ("r2", "pass")]
    assert Q.run(pol, f, {"c": "complete"}) == [("r1", "fail"), ("r2", "indeterminate")]
    assert Q.run(pol, f, {"c": "partial"}) == [("r1", "indeterminate"), ("r2", "indeterminate")]
    for bad in (Q.Policy("p", ("r1",), rules(("r2", "pass"))), Q.Policy("p", ("r1",), rules(("r1", "pass")), ("c",), {"r1": ("c",)})):
        with pytest.raises(P.PlanError):
            Q.run(bad, f, {"c": "complete"})
    assert Q.order({"b": ("a",), "a": (), "c": ("a", "b")}) == ["a", "b", "c"]
    with pytest.raises(P.PlanError):
        Q.order({"a": ("b",), "b": ("a",)})


def test_repository(spark, tmp_path):
    root = tmp_path / "repo"
    for name, data in {"src/a b.ts": b"x\n", "src/b.png": b"\xff\xfe", ".git/config": b"z", "docs/r.md": b"r", "gen/x+y%.ts": b"y"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    files = repository.scan(spark, str(root), exclude=["gen/n*"])
    got = {r.path: (r.bytes, r.content) for r in files.collect()}
    assert got == {"src/a b.ts": (2, "text"), "src/b.png": (2, "binary"), "docs/r.md": (1, "text"), "gen/x+y%.ts": (1, "text")}
    inv = repository.inventory(files)
    assert {r.path: r.language for r in inv.collect()}["src/b.png"] == "image"
    assert repository.inventory(files, wanted={"delivery": ["documentation"]}).count() == 1
    m = repository.manifest_id(inv).first()[0]
    assert m == repository.manifest_id(inv.repartition(3)).first()[0] != repository.manifest_id(inv.limit(2)).first()[0]
    rev = {r.path: r.revision for r in inv.collect()}
    asked = spark.createDataFrame([("src/a b.ts", rev["src/a b.ts"]), ("src/a b.ts", "old"), ("src/b.png", None), ("none", None), ("docs/r.md", None)], "path string, revision string")
    pinned = sorted((r.path, r.status, r.reason or "", r.text or "") for r in repository.pinned(asked, inv, files).collect())
    assert pinned == [("docs/r.md", "current", "", "r"), ("none", "unavailable", "not-in-inventory", ""), ("src/a b.ts", "current", "", "x\n"), ("src/a b.ts", "stale", "", ""), ("src/b.png", "unavailable", "not-text", "")]
    led = L.MemoryLedger(spark)
    assert led.facts(led.commit("u", None, repository.facts(inv))).count() == 4
    c = repository.coherence(spark.createDataFrame([("docs/r.md", "old"), ("zz", "r")], "path string, revision string"), inv)
    assert sorted(tuple(r) for r in c.collect()) == [("docs/r.md", "REVISION_MISMATCH"), ("zz", "RESOURCE_MISSING")]


def test_documents(spark, tmp_path):
    d = spark.createDataFrame([("a", '{"$id":"x","$ref":"y"}'), ("b", '{"$id":"x"}'), ("c", "[]"), ("d", "{}"), ("e", "not json"), ("f", '{"$id":"z","$ref":"x#/q"}'), ("g", '{"$id":"w","$ref":"gone"}')], "path string, text string")
    got = {r.path: r.code for r in documents.schema_catalog(d).collect()}
    assert got == {"a": "SCHEMA_ID_DUPLICATE", "b": "SCHEMA_ID_DUPLICATE", "c": "SCHEMA_NOT_OBJECT", "d": "SCHEMA_ID_MISSING", "e": "SCHEMA_NOT_OBJECT", "f": None, "g": "SCHEMA_REFERENCE_MISSING"}
    md = documents.markdown(spark.createDataFrame([("a", "x\n# One #\n```\n# no\n```\n## Two\n"), ("b", "#" * (600 << 10))], "path string, text string"))
    assert {r.path: (r.title, r.headings, r.code) for r in md.collect()} == {"a": ("One", ["One", "Two"], None), "b": (None, None, "MARKDOWN_TOO_LARGE")}
    (tmp_path / "f.ndjson").write_text('{"sequence":1,"kind":"x","body":"b"}\n{"sequence":1,"kind":"x"}\nbroken\n{"sequence":4,"kind":"end"}\n')
    f = documents.frames(spark, str(tmp_path / "f.ndjson"))
    assert f.count() == 3 and sorted(tuple(r) for r in documents.frame_errors(f).collect()) == [("FRAME_MISSING", 2), ("FRAME_REPEATED", 1)]
    n = spark.createDataFrame([(1, "a", None, "fn", "f", 1, None), (2, "b", "m.b", "fn", "f", 9, 1)], "id int, name string, qualified_name string, kind string, file string, line int, parent_id int")
    told = {"node": n, "edge": spark.createDataFrame([(1, 2, "call"), (1, 9, "call")], "source_id int, target_id int, edge_kind string"), "metric": spark.createDataFrame([(1, 5)], "node_id int, fan_in int"), "syntax": spark.createDataFrame([(7, 2), (8, 9)], "at int, parent_id int")}
    lines = documents.code_graph(told)
    of = lambda p, name, line: f'"{p}file":"f","{p}kind":"fn","{p}line":{line},"{p}qualified_name":"{name}"'
    assert sorted((r.relation, r.line) for r in lines.collect()) == sorted([
        ("node", '{"file":"f","kind":"fn","line":1,"name":"a","qualified_name":"a"}'), ("node", f'{{"file":"f","kind":"fn","line":9,"name":"b",{of("parent_", "a", 1)},"qualified_name":"m.b"}}'),
        ("edge", f'{{"edge_kind":"call",{of("source_", "a", 1)},{of("target_", "m.b", 9)}}}'), ("metric", f'{{"fan_in":5,{of("", "a", 1)}}}'), ("syntax", f'{{"at":7,{of("parent_", "m.b", 9)}}}'), ("syntax", '{"at":8}'),
    ])
    moved = {"node": n.withColumn("id", F.col("id") + 50).withColumn("parent_id", F.col("parent_id") + 50)}
    moved["edge"], moved["metric"], moved["syntax"] = told["edge"].select(F.col("source_id") + 50, F.col("target_id") + 50, "edge_kind").toDF("source_id", "target_id", "edge_kind"), told["metric"].select((F.col("node_id") + 50).alias("node_id"), "fan_in"), told["syntax"].select("at", (F.col("parent_id") + 50).alias("parent_id"))
    assert documents.graph_digest(lines).first()[0] == documents.graph_digest(lines.repartition(3)).first()[0] == documents.graph_digest(documents.code_graph(moved)).first()[0]
    assert documents.checkpoint_key({"a": b"1", "b": b"2"}) == documents.checkpoint_key({"b": b"2", "a": b"1"}) != documents.checkpoint_key({"a": b"1"})


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:03", "a"), (3, "2024-01-01 01:00:00", "a")], "id int, t string, k string").withColumn("t", F.to_timestamp("t"))
    src.unionByName(src).write.parquet(str(tmp_path / "in"))
    s = changes.deduplicated(changes.events(spark, str(tmp_path / "in"), "id int, t timestamp, k string"), ["id"], "t", "1 day")
    seen = []
    changes.apply_each(s, lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [1, 2, 3]
    assert sorted(r.n for r in changes.bursts(src, "k", "t").collect()) == [1, 2]
    assert sorted(r.n for r in changes.windowed(src, ["k"], "t", "1 hour", "30 minutes").collect()) == [1, 1, 2, 2]
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(tuple(r) for r in changes.delta(cur, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), spark.createDataFrame([(1,)], "id int"), "id").collect()) == [(2, "c"), (3, "d")]


def test_stream_without_a_bound_drops_no_late_row(spark, tmp_path):
    far = spark.createDataFrame([(7, "2024-01-01 00:00:00"), (8, "2020-01-01 00:00:00"), (7, "2024-01-01 00:00:00"), (9, "2019-01-01 00:00:00")], "id int, t string").withColumn("t", F.to_timestamp("t"))
    for k in range(4):
        far.where(F.col("id") == [7, 8, 9, 7][k]).coalesce(1).write.mode("append").parquet(str(tmp_path / "far"))
    late = changes.deduplicated(changes.events(spark, str(tmp_path / "far"), "id int, t timestamp", 1), ["id"], "t", None)
    every = []
    changes.apply_each(late, lambda df, n: every.extend(r.id for r in df.collect()), str(tmp_path / "far_cp")).awaitTermination()
    assert sorted(every) == [7, 8, 9]


def test_facts_without_inputs_are_not_looked_up(spark, monkeypatch):
    looked, unmet = [], L._unmet
    monkeypatch.setattr(L, "_unmet", lambda *a: looked.append(1) or unmet(*a))
    led = L.MemoryLedger(spark)
    g = led.commit("u", None, shard(spark, "a", ("f1", [], "1"), ("f2", [], "2")))
    assert led.facts(g).count() == 2 and not looked
    assert code(lambda: led.commit("u", g, shard(spark, "b", ("f3", ["f9"], "3")))) == "INPUT_DANGLING" and looked
    assert led.facts(led.commit("u", g, shard(spark, "b", ("f3", ["f1"], "3")))).count() == 3
