import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import classify, identity, lines, text


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_ids_and_grammar(spark):
    ((a, ok, bad),) = one(spark, [("x",)], "v string", identity.derive_id("fact", "n", F.col("v")), identity.is_id(identity.derive_id("fact", "n", F.col("v"))), identity.is_id(F.col("v")))
    assert ok and not bad and a.startswith("fact:")
    ((b,),) = one(spark, [("x",)], "v string", identity.derive_id("fact", "m", F.col("v")))
    assert a != b


def test_canonical_json_ignores_key_order_and_tags_values():
    import datetime as dt

    assert identity.canonical_json({"b": 1, "a": [True, None]}) == identity.canonical_json({"a": [True, None], "b": 1}) == '{"a":[true,null],"b":1}'
    assert identity.canonical_json({"x": 2**60, "d": dt.date(2024, 1, 2)}) == '{"d":{"$date":"2024-01-02"},"x":{"$bigint":"1152921504606846976"}}'
    assert "\\u2028" in identity.canonical_json("\u2028")
    with pytest.raises(TypeError):
        identity.canonical_json({1, 2})


def test_cursor_round_trip():
    assert identity.decode_cursor(identity.encode_cursor(a=1)) == {"a": 1}
    for bad in ("!", "e30x", identity.encode_cursor(a=1)[:-3]):
        with pytest.raises(ValueError):
            identity.decode_cursor(bad)


def test_paths(spark):
    paths = ["a/b", "", "/a", "a/../b", "a\\b", "./a", "a//b", "C:/x", "a"]
    got = one(spark, [(p,) for p in paths], "p string", identity.portable_path(F.col("p")), identity.canonical_path(F.col("p")), identity.ancestors(F.col("p")))
    assert [g[0] for g in got] == [True, False, False, False, False, True, True, False, True]
    assert [g[1] for g in got] == [True, False, False, False, False, False, False, False, True]
    assert got[0][2] == ["a", "a/b"]


@pytest.mark.parametrize(("pattern", "yes", "no"), [("src/**", ["src/a", "src/a/b"], ["lib/a"]), ("*.ts", ["a.ts"], ["b/a.ts", "a.tsx"]), ("**/*.ts", ["a.ts", "b/c/a.ts"], ["a.js"]), ("a?[bc].{x,y}", ["azb.x", "a1c.y"], ["azd.x", "ab.x"]), ("a[!b]c", ["axc"], ["abc"])])
def test_globs(spark, pattern, yes, no):
    got = one(spark, [(p,) for p in yes + no], "p string", identity.path_in_scope(F.col("p"), [pattern]))
    assert [g[0] for g in got] == [True] * len(yes) + [False] * len(no)


def test_scope_excludes_after_including(spark):
    got = one(spark, [("src/a.ts",), ("src/gen/a.ts",)], "p string", identity.path_in_scope(F.col("p"), ["src/**"], ["src/gen/**"]))
    assert [g[0] for g in got] == [True, False]


@pytest.mark.parametrize(("t", "physical", "blank"), [("", 0, 0), ("a", 1, 0), ("a\n", 1, 0), ("a\r\n\r\nb", 3, 1), ("\r", 1, 1), ("a\rb\n\n", 3, 1), ("\n", 1, 1), (" \t\n\u00a0\nx", 3, 2)])
def test_text_lines(spark, t, physical, blank):
    ((m,),) = one(spark, [(t,)], "t string", lines.text_metrics(F.col("t")))
    assert tuple(m) == (physical, 0, 0, blank, physical - blank)


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("/** docs\n * continue\n */\nconst value = 1 // trailing\n\n// note\n", (6, 1, 4, 1)),
        ("", (0, 0, 0, 0)),
        ("const a = `x\n\n// no comment\n`;", (4, 4, 0, 0)),
        ("s = '// no'\r\n/* a */ b\r/*\n\n*/", (5, 2, 3, 0)),
        ("a = `x ${ `y // no ${b}\n */` } z`; // c\n\nlet r = /[/*]/g, d = a / b / c // z\n  // only\nreturn /['\"]/ // d\n", (6, 4, 1, 1)),
        ("if (x) { f(`${{a: 1}}`) } /* open\n", (1, 1, 0, 0)),
        ("'unclosed\n// c", (2, 1, 1, 0)),
    ],
)
def test_scanner(spark, t, want):
    assert lines.scan_curly(t) == want
    ((m,),) = one(spark, [(t,)], "t string", lines.curly_metrics(F.col("t")))
    assert tuple(m)[:4] == want


def test_classification(spark):
    want = {
        "packages/core/src/index.ts": ("implementation", "authored", "active", "runtime", "core", "packages", "typescript"),
        "packages/@s/x/__tests__/a.test.ts": ("test", "authored", "active", "development", "@s/x", "packages", "typescript"),
        "README.md": ("unknown", "authored", "active", "documentation", None, None, "markdown"),
        "a/.spec/api.d.ts": ("specification", "authored", "active", "runtime", None, "a", "typescript"),
        "vendor/legacy/x.go": ("implementation", "vendored", "deprecated", "runtime", None, "vendor", "go"),
        "dist/archive/fixtures/x.gen.ts": ("fixture", "generated", "historical", "build", None, "dist", "typescript"),
        ".json": ("unknown", "authored", "active", "unknown", None, None, "unknown"),
    }
    p = F.col("p")
    got = one(spark, [(k,) for k in want], "p string", "p", *[f(p) for f in classify.AXES.values()], classify.package(p), classify.area(p), classify.language(p, F.lit("text")))
    assert {g[0]: g[1:] for g in got} == want
    assert one(spark, [("a.PNG",), ("a.bin",)], "p string", classify.language(p, F.lit("binary"))) == [("image",), ("binary",)]


def test_classifiers_merge_by_priority(spark):
    c = [(10, "z", {"purpose": F.lit("test")}, F.array(F.lit("z"))), (90, "a", {"purpose": F.lit("unknown"), "delivery": F.lit("build")}, F.array(F.lit("a"), F.lit("z")))]
    m = classify.merge(c)
    assert one(spark, [(1,)], "x int", m["purpose"], m["delivery"], m["lifecycle"], m["evidence"]) == [("test", "build", "unknown", ["a", "z"])]
    s = classify.in_scope({"purpose": F.lit("test")}, {"purpose": []})
    assert one(spark, [(1,)], "x int", s) == [(False,)]


def points(needle, candidate):
    """Each letter at its first place behind the one before, scored by what the text says of it."""
    places = []
    for c in needle:
        left = [i for i, x in enumerate(candidate) if x == c and (not places or i > places[-1])]
        if not left:
            return 0
        places.append(left[0])
    if not places:
        return 0
    near = sum(12 if b == a + 1 else 4 for a, b in zip([-2, *places], places))
    starts = 8 * sum(i == 0 or candidate[i - 1] == " " for i in places)
    return near + starts - min(80, len(candidate) - len(needle))


def test_fuzzy_scores_agree(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("ab ") for _ in range(rng.randint(0, 4))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    got = one(spark, pairs, "n string, c string", text.fuzzy(F.col("n"), F.col("c")))
    assert [g[0] for g in got] == [points(n, c) for n, c in pairs]
    assert points("ab", "ab") == 4 + 8 + 12


def test_tabs_by_name_or_beginning():
    tabs = ["graph", "grid", "laws", "law"]
    assert text.parse_query("tab:graph x", tabs).tab == "graph" and text.parse_query("section:gra", tabs).tab == "graph"
    # two tabs begin so, one letter is too few, a whole name wins
    assert [text.parse_query(f"tab:{t}", tabs).tab for t in ("gr", "g", "law", "laws", "la", "xx")] == [None, None, "law", "laws", None, None]



def test_normalize(spark):
    assert text.normalize("Élan_Vital  (2)") == "elan vital 2"
    assert one(spark, [("Élan",), (None,)], "t string", text.normalize_udf(F.col("t"))) == [("elan",), (None,)]
    assert one(spark, [(" A-b__C ",)], "t string", text.normalized(F.col("t"))) == [("a b c",)]


def test_query_parser():
    q = text.parse_query('"two words" family:Core status:active tab:la x:y section:zz', ["laws", "layout", "api"])
    assert q.terms == ["two words", "tab la", "x y", "section zz"] and q.families == ["core"] and q.statuses == ["active"] and q.tab is None
    assert text.parse_query("section:ap", ["laws", "api"]).tab == "api"


def test_names(spark):
    got = one(spark, [("@a/b/c",), ("x/y",), ("./z",), ("",), ("@a",)], "s string", text.package_name(F.col("s")))
    assert [g[0] for g in got] == ["@a/b", "x", None, None, None]
    assert one(spark, [("a.b c/é",)], "s string", text.encode_id(F.col("s"))) == [("a%2Eb%20c%2F%C3%A9",)]
    assert one(spark, [(r"call foo.bar() or \baz, not a\b",)], "t string", text.mentions(F.col("t")))[0][0] == ["call", "foo.bar()", "or", "not", "a"]
