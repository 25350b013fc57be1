"""Merkle trees, statistics by deltas, pruned families and postings against plain recomputation."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import parse_query
from factloom.operators import deltas, merkle, postings, search
from factloom.sources import families


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def directory_digest(files, at=""):
    """By recursion: (digest, files, bytes) of a directory of {path: (digest, bytes)}."""
    names, total, size = {}, 0, 0
    for p, (d, b) in files.items():
        if p.startswith(at):
            name = p[len(at) :].split("/")[0]
            names[name] = f"{at}{name}/" if "/" in p[len(at) :] else ("file", d)
            total, size = total + 1, size + b
    parts = {}
    for name, what in names.items():
        line = f"file:{name}:{what[1]}" if isinstance(what, tuple) else f"directory:{name}:{directory_digest(files, what)[0]}"
        parts.setdefault(sha(name)[:2], []).append(line)
    return sha("\n".join(sorted(f"{b}:{sha(chr(10).join(sorted(ls)))}" for b, ls in parts.items()))), total, size


def random_tree(rng, n):
    return {"/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + f"/f{k}" if rng.random() < 0.9 else f"f{k}": (sha(str(rng.random())), rng.randint(0, 9)) for k in range(n)}


def frame(spark, files):
    return spark.createDataFrame([(p, d, b) for p, (d, b) in files.items()], "path string, digest string, bytes long")


@pytest.mark.parametrize("named", [500, 0])
def test_merkle_descent(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(merkle, "NAMED", named)
    rng = random.Random(4)
    old = random_tree(rng, 120)
    new = dict(old)
    gone, changed = rng.sample(sorted(old), 3), rng.sample(sorted(old), 3)
    for p in changed:
        new[p] = (sha("new" + p), 1)
    for p in gone:
        new.pop(p, None)
    new["b/brand/new/f"] = (sha("x"), 2)
    a, b = (merkle.saved(merkle.tree(frame(spark, t)), str(tmp_path / n)) for n, t in (("a", old), ("b", new)))
    roots = {r.path: (r.digest, r.files, r.bytes) for r in a.where("kind = 'directory'").collect()}
    assert roots[""] == directory_digest(old) and all(v == directory_digest(old, f"{k}/" if k else "") for k, v in roots.items())
    found, looked = merkle.differences(a, b)
    want = {p: "unlink" for p in gone} | {p: "change" for p in changed if p not in gone} | {"b/brand/new/f": "add"}
    assert {r.path: r.change for r in found.collect()} == want
    same, one = merkle.differences(a, a)
    assert same.isEmpty() and one == [2]
    # only the children of directories that differ are looked at
    differ = {"/".join(p.split("/")[:k]) for p in want for k in range(len(p.split("/")))}
    children = lambda t: {"/".join(p.split("/")[:k]) for p in t for k in range(1, len(p.split("/")) + 1) if "/".join(p.split("/")[: k - 1]) in differ}
    assert sum(looked) == 2 + len(children(old)) + len(children(new)) < 2 * 120
    read = []

    def reader(paths):
        read.extend(r.path for r in paths.collect())
        return paths.withColumn("lines", F.lit(1))

    cold = spark.createDataFrame([(p, 1) for p in old], "path string, lines int")
    again, _ = merkle.refreshed(cold, a, b, reader)
    assert sorted(r.path for r in again.collect()) == sorted(new) and sorted(read) == sorted(p for p, c in want.items() if c != "unlink")


def test_merkle_edges(spark):
    assert merkle.tree(frame(spark, {})).count() == 0
    with pytest.raises(ValueError, match="segments"):
        merkle.tree(frame(spark, {"a/b/c": ("d", 1)}), 2)
    one = merkle.tree(frame(spark, {"f": (sha("1"), 5)}))
    assert merkle.differences(merkle.tree(frame(spark, {})), one)[0].collect() == [("f", "add")]


def test_statistics_by_deltas_equal_a_cold_run(spark):
    rng, files = random.Random(9), {}
    dims = {"lang": F.col("lang"), "all": F.lit("all")}
    to = lambda rows: spark.createDataFrame(rows, "id int, lang string, value long, size long")
    measure = lambda df, sign: deltas.signed(df, dims, F.col("value"), F.col("size"), sign)
    state = measure(to([]), 1)
    batches = []
    for step in range(3):
        gone = rng.sample(sorted(files), min(len(files), 15))
        removed = [files.pop(k) for k in gone]
        added = [(1000 * step + k, rng.choice(["a", "b", None]), rng.choice([0, 3, 5_000, 70_000, rng.randrange(9_000)]), rng.randrange(50)) for k in range(25)]
        files.update({r[0]: r for r in added})
        batches.append((to(added), to(removed)))
    state = deltas.maintained(state, batches, measure, lambda s: spark.createDataFrame(s.collect(), deltas.STATE))
    assert deltas.faults(state).isEmpty()
    groups = {}
    for _, lang, value, size in files.values():
        for key in (("lang", lang or "unassigned"), ("all", "all")):
            groups.setdefault(key, []).append((value, size))
    rank = lambda vs, r: sorted(v for v, _ in vs)[math.ceil(r * len(vs)) - 1]
    got = {(r.dimension, r.key): (r.files, r.bytes, r.total, r.median, r.p95) for r in deltas.summaries(state).collect()}
    assert got == {k: (len(v), sum(s for _, s in v), sum(x for x, _ in v), rank(v, 0.5), rank(v, 0.95)) for k, v in groups.items()}
    all_gone = deltas.applied(state, measure(to(list(files.values())), -1))
    assert deltas.summaries(all_gone).isEmpty() and all_gone.isEmpty()
    assert deltas.faults(deltas.applied(all_gone, measure(to([(1, "a", 1, 1)]), -1))).count() == 2


def test_families_are_pruned_in_the_scan(spark, tmp_path):
    t = lambda **own: spark.createDataFrame([("i", "k", "s", *own.values())], ["fact_id", "kind", "subject", *own])
    schema = families.write({"symbols": t(name="n", size=1), "bodies": t(text="b"), "sources": t(path="p")}, str(tmp_path / "f"))
    with pytest.raises(families.UnknownCapability):
        families.plan(["x"], {"calls": "bodies"})
    wanted = families.plan(["b", "a", "c"], {"a": "symbols", "b": "bodies", "c": "symbols"})
    assert wanted == ["symbols", "bodies"]
    some = families.read(spark, str(tmp_path / "f"), schema, ["symbols"])
    plan = some.select("fact_id", "symbols.name")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(family" in plan and "IN (symbols)" in plan.replace("= symbols", "IN (symbols)")
    assert "ReadSchema: struct<fact_id:string,symbols:struct<name:string>>" in plan
    assert some.columns == ["fact_id", "kind", "subject", "family", "symbols"] and some.first().symbols.name == "n" and some.count() == 1
    assert families.read(spark, str(tmp_path / "f"), schema, wanted).count() == 2


def test_postings_give_what_the_scan_gives(spark, tmp_path):
    rng = random.Random(3)
    words = ["core", "coral", "api", "apex", "graph", "grab", "node", "x1"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    entries = [(f"s{k}", say(1), say(2), say(3), say(1), rng.choice(["fam", "other"]), rng.choice(["active", "draft"])) for k in range(300)]
    index = spark.createDataFrame(entries, "source string, name string, title string, path string, alias string, family string, status string")
    schema = postings.built(index, str(tmp_path / "i"))
    full = 0
    for asked in ("co", "core api", "gra node", '"core api"', "x1 family:fam", "zzz", "", "co status:draft", "c"):
        q = parse_query(asked)
        got, enough = postings.top(spark, index, str(tmp_path / "i"), schema, q, limit=10)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in search.top(search.ranked(index, q), 10).collect()], asked
        full += enough
    assert full >= 5
    plan = postings.candidates(spark, str(tmp_path / "i"), schema, parse_query("core"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "co" in plan


def test_postings_of_a_frequent_token_are_parted(spark, tmp_path, monkeypatch):
    """Tasks and files follow the number of entries, also where all have the same token."""
    import glob

    monkeypatch.setattr(postings, "ENTRIES", 20)
    index = spark.range(200).selectExpr("concat('s', id) AS source", "'same' AS name", "'' AS title", "'' AS path", "'' AS alias", "'' AS family", "'' AS status")
    schema = postings.built(index, str(tmp_path / "i"))
    assert len(glob.glob(str(tmp_path / "i" / "bucket=sa" / "part-*"))) >= 8 and spark.read.schema(schema).parquet(str(tmp_path / "i")).count() == 200
