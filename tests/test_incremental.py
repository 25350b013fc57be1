import pytest
from pyspark.sql import functions as F

from factloom.operators import incremental as I
from factloom.operators import modules as M
from factloom.sources.checkpoints import Checkpoints, Miss


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_private_edits_stay_where_they_are(spark):
    shapes = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "1", "1"), ("d", None, None)], "source string, before string, after string")
    imports = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "c"), ("b", "e"), ("f", "d")], "src string, dst string")
    hit = lambda *s: rows(I.affected(shapes, imports, spark.createDataFrame([(x,) for x in s], "source string")))
    assert hit("a") == [("a", "changed")]
    assert hit("b") == [("b", "changed"), ("c", "importer"), ("e", "importer")]
    assert hit("d") == [("d", "changed"), ("f", "importer")]


def test_manifests_and_overlays(spark):
    cur = spark.createDataFrame([("a", "1", "n"), ("b", "2", "m"), ("c", "3", "n")], "shard_key string, shard_digest string, namespace string")
    assert I.carried(cur, ["n"]).count() == 1 and I.carried(cur, []).count() == 3
    made = I.reconstruct(cur, spark.createDataFrame([("b", "9"), ("d", "4")], "shard_key string, shard_digest string"), spark.createDataFrame([("a",)], "shard_key string"))
    assert rows(made) == [("b", "9"), ("c", "3"), ("d", "4")]
    old = spark.createDataFrame([("s", "1", "specification", "pass"), ("t", "1", "universe", "pass"), ("u", "0", "specification", "pass")], "spec string, identity string, scope string, status string")
    assert rows(I.reusable(old, spark.createDataFrame([("s", "1"), ("t", "1"), ("u", "1")], "spec string, identity string"))) == [("s", "1", "specification", "pass")]
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, p string")
    assert rows(I.overlay(base, spark.createDataFrame([("b", None), ("z", "q")], "k string, p string"), "k", "p")) == [("a", "x"), ("b", None)]
    assert I.same_keys(base, base, "k") and not I.same_keys(base, base.limit(1), "k")
    assert rows(I.history(spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "path string, at int"), 2)) == [("a", 2), ("a", 3)]


def test_modules(spark):
    b = M.boundaries(spark.createDataFrame([("s1", "p/a/x"), ("s2", "q"), ("s3", "p/b")], "spec string, path string"), spark.createDataFrame([("p/a",), ("p/b",), ("p",)], "root string").where("root != 'p'"))
    assert rows(b) == [("s1", "p/a", None), ("s2", None, "BOUNDARY_MISSING"), ("s3", "p/b", None)]
    assert rows(M.boundaries(spark.createDataFrame([("s", "p/a")], "spec string, path string"), spark.createDataFrame([("p",), ("p/a",)], "root string"))) == [("s", None, "BOUNDARY_AMBIGUOUS")]
    e = spark.createDataFrame([("m1", "P", "interface", True), ("m1", "x", "const", True), ("m2", "Q", "interface", False), ("m3", "A", "interface", True), ("m3", "B", "interface", True), ("m4", "P", "interface", True)], "module string, name string, kind string, local boolean")
    assert rows(M.ports(e)) == [("m1", "P", "PORT_NAME_REPEATED"), ("m2", None, "PORT_MISSING"), ("m3", None, "PORT_AMBIGUOUS"), ("m4", "P", "PORT_NAME_REPEATED")]
    g = spark.createDataFrame([("api.d.ts", "file"), ("laws", "directory")], "pattern string, kind string")
    n = spark.createDataFrame([("a/.spec/api.d.ts", "file"), ("a/.spec/laws", "file"), ("a/.spec/zz", "file"), (".spec/l", "link"), ("a/.spec/.history/x", "file"), ("b/c", "file")], "path string, kind string")
    assert rows(M.grammar_errors(n, g, [".history"])) == [(".spec/l", "ENTRY_LINK"), ("a/.spec/laws", "ENTRY_KIND"), ("a/.spec/zz", "ENTRY_UNKNOWN")]
    f = lambda *p: dict(rows(M.topology_fingerprint(spark.createDataFrame([(x,) for x in p], "path string"))))
    assert f("a/x", "a/y", "z") == f("z", "a/y", "a/x") and f("a/x")["a"] != f("a/y")["a"]
    a = F.array
    assert spark.range(1).select(M.sorted_unique(a(F.lit(1), F.lit(2))), M.sorted_unique(a(F.lit(1), F.lit(1))), M.disjoint(a(F.lit(1)), a(F.lit(2)))).first()[:] == (True, False, True)


def test_verified_texts(spark):
    from factloom.functions.identity import derive_id

    files = spark.createDataFrame([("a", "d1"), ("b", "d2")], "path string, digest string")
    asked = files.withColumn("revision", derive_id("source-revision", "local", F.concat("path", F.lit("\n"), "digest"))).withColumn("digest", F.when(F.col("path") == "b", "old").otherwise(F.col("digest")))
    asked = asked.unionByName(spark.createDataFrame([("c", "d", "r")], "path string, digest string, revision string"))
    assert rows(M.verify_text(asked, files)) == [("a", "verified"), ("b", "stale"), ("c", "unavailable")]


def test_checkpoints(spark, tmp_path):
    c = Checkpoints(spark, str(tmp_path / "c"), most=2)
    df = spark.createDataFrame([(1, "a")], "i int, s string")

    def miss(scope, key):
        with pytest.raises(Miss) as e:
            c.restore(scope, key)
        return e.value.reason

    assert miss("s", {}) == "absent"
    c.save("s", {"v": 1}, {"t": df, "u": df.limit(0)})
    got = c.restore("s", {"v": 1})
    assert rows(got["t"]) == [(1, "a")] and got["u"].count() == 0 and miss("s", {"v": 2}) == "key"
    c.save("s", {"v": 2}, {"t": df.union(df)})
    assert c.restore("s", {"v": 2})["t"].count() == 2
    at = next(p for p in (tmp_path / "c").iterdir() if p.is_dir())
    (next(p for p in at.iterdir() if p.is_dir()) / "t").rename(tmp_path / "moved")
    assert miss("s", {"v": 2}) == "blob-absent"
    (tmp_path / "moved").rename(next(p for p in at.iterdir() if p.is_dir()) / "t")
    assert c.restore("s", {"v": 2})["t"].count() == 2
    # the same schema and number of rows, other values
    folder = next(p for p in at.iterdir() if p.is_dir()) / "t"
    spark.createDataFrame([(1, "a"), (1, "b")], "i int, s string").write.mode("overwrite").parquet(str(folder))
    assert miss("s", {"v": 2}) == "digest"
    manifest = next(p for p in at.iterdir() if p.name.startswith("manifest-"))
    manifest.write_text("{")
    (at / f".{manifest.name}.crc").unlink(missing_ok=True)
    assert miss("s", {"v": 2}) == "unreadable"
    c.save("s2", {}, {"t": df})
    c.save("s3", {}, {"t": df})
    assert len([p for p in (tmp_path / "c").iterdir() if p.is_dir()]) == 2 and c.restore("s3", {})
