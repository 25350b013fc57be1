"""Values of occurrences and framed transactions against versions by recursion and by hand."""

import base64
import hashlib
import json
import random

from factloom.operators import body
from factloom.sources import transactions


def evaluated(i, own, sources, depth, limits):
    """(kind, values, reasons, construct) by recursion."""
    top_depth, alternatives = limits
    if i in own and own[i] != (None, None, None):
        value, construct, reason = own[i]
        if construct:
            return "unsupported", [], set(), construct
        return ("unknown", [], {reason}, None) if reason else ("known", [value], set(), None)
    if i not in own:
        return "unknown", [], {"VALUE_OCCURRENCE_MISSING"}, None
    if not sources.get(i):
        return "unknown", [], {"VALUE_NO_SEMANTIC_PATH"}, None
    if depth == top_depth:
        return "unknown", [], {"VALUE_DEPTH_LIMIT"}, None
    got = [evaluated(s, own, sources, depth + 1, limits) for s in sources[i]]
    constructs = [g[3] for g in got if g[0] == "unsupported"]
    if constructs:
        return "unsupported", [], set(), min(constructs)
    lost = set().union(*[g[2] for g in got if g[0] == "unknown"])
    if lost:
        return "unknown", [], lost, None
    values = sorted({v for g in got for v in g[1]})
    if len(values) == 1:
        return "known", values, set(), None
    more = {"VALUE_ALTERNATIVE_LIMIT" if len(values) > alternatives else "VALUE_ALTERNATIVES"}
    return "ambiguous", values[:alternatives], more.union(*[g[2] for g in got]), None


def test_evaluation_by_recursion(spark):
    rng = random.Random(12)
    for depth, alternatives in ((4, 3), (6, 2)):
        own, sources = {}, {}
        for i in range(160):
            own[i] = rng.choice([(rng.choice("abcde"), None, None)] * 6 + [(None, rng.choice(["new", "call"]), None), (None, None, rng.choice(["R1", "R2"]))]) if i < 50 else (None, None, None)
            if i >= 50:
                sources[i] = sorted(set(rng.choices(range(max(0, i - 60), i), k=rng.choice([0, 1, 2, 3]))))
        sources[159], sources[158], sources[60] = [158], [159], [61]  # a cycle, and a way on to it
        sources[157] = [159, 999]
        sources[0] = [1]  # one that has a value of its own doesn't look on
        o = spark.createDataFrame([(i, *v) for i, v in own.items()], "id int, value string, construct string, reason string")
        s = spark.createDataFrame([(i, x) for i, xs in sources.items() for x in xs], "`id` int, `from` int")
        got = {r.id: (r.kind, list(r["values"]), set(r.reasons), r.construct) for r in body.evaluate(o, s, depth, alternatives, steps=3).collect()}
        want = {i: evaluated(i, own, sources, 0, (depth, alternatives)) for i in own}
        assert got == want and {k for k, *_ in want.values()} == {"known", "unknown", "ambiguous", "unsupported"}


def test_calls(spark):
    calls = spark.createDataFrame([("c1", "f", False), ("c2", None, False), ("c3", "f", True), ("c4", "ext", False), ("c5", "rec", False), ("c6", "void", False)], "id string, target string, dynamic boolean")
    returns = spark.createDataFrame([("f", "r1", False), ("f", "r2", False), ("rec", "r3", True), ("void", None, False)], "function string, expression string, recursive boolean")
    own, through = body.call_results(calls, returns)
    assert sorted((r.id, r.construct, r.reason) for r in own.collect()) == [("c2", None, "VALUE_DYNAMIC_CALL"), ("c3", None, "VALUE_DYNAMIC_CALL"), ("c4", "external-or-bodyless-call", None), ("c5", None, "VALUE_RECURSION"), ("c6", None, "VALUE_RETURN_MISSING")]
    assert sorted((r.id, r["from"]) for r in through.collect()) == [("c1", "r1"), ("c1", "r2")]
    o = spark.createDataFrame([("r1", "x", None, None), ("r2", "y", None, None), ("c1", None, None, None)], "id string, value string, construct string, reason string").unionByName(own)
    assert {r.id: r.kind for r in body.evaluate(o, through).collect()} == {"r1": "known", "r2": "known", "c1": "ambiguous", "c2": "unknown", "c3": "unknown", "c4": "unsupported", "c5": "unknown", "c6": "unknown"}


def frames_of(i, text, parts=2, **changes):
    raw = text.encode()
    head = {"payload": "delta", "bytes": len(raw), "chunks": parts, "sha256": hashlib.sha256(raw).hexdigest()} | changes.get("head", {})
    step = -(-len(raw) // parts)
    out = [{"kind": "start", **head}] + [{"kind": "chunk", "sequence": k, "data": base64.b64encode(raw[k * step : (k + 1) * step]).decode()} for k in range(parts)] + [{"kind": "end", **head}]
    changes.get("then", lambda f: None)(out)
    return [{"id": i, "at": k, "size": 10} | f for k, f in enumerate(out)]


def test_transactions(spark):
    good = json.dumps({"a": "ü" * 50})

    def put(at, **what):
        return lambda f: f[at].update(what)

    cases = {
        None: frames_of(1, good, 7), "TRANSACTION_TOO_LARGE": frames_of(2, good + " " * 2000), "CHUNKS_EXCEED_BYTES": frames_of(3, good, head={"chunks": 10_000}), "START_INVALID": frames_of(4, good, head={"sha256": "no"}), "FRAME_TOO_LARGE": frames_of(5, good, then=put(1, size=999)),
        "CHUNK_UNANNOUNCED": frames_of(6, good, 2, head={"chunks": 1}), "CHUNK_ORDER": frames_of(7, good, then=lambda f: f.insert(1, f.pop(2))), "BYTES_EXCEEDED": frames_of(8, good, head={"bytes": 9}), "BYTES_MISSING": frames_of(9, good, head={"bytes": 999}),
        "CHUNKS_MISSING": frames_of(10, good, then=lambda f: f.pop(2)), "END_BEFORE_START": frames_of(11, good, then=lambda f: (f.pop(0), f.pop(0), f.pop(0))), "BODY_INVALID": frames_of(12, "[1]"), "DIGEST_INVALID": frames_of(13, good, head={"sha256": "0" * 64}),
        "END_MISMATCH": frames_of(14, good, then=put(3, payload="transaction")), "TRANSACTION_UNFINISHED": frames_of(15, good, then=lambda f: f.pop()), "CHUNK_ENCODING": frames_of(16, good, then=put(1, data="a===")), "TRANSACTION_ACTIVE": frames_of(17, good, then=lambda f: f.insert(1, dict(f[0]))),
    }
    rows = [f for fs in cases.values() for f in fs] + [{"id": 99, "at": 0, "kind": "acknowledged", "size": 3}]
    names = [c.split()[0] for c in transactions.FRAMES.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], transactions.FRAMES)
    got = {r.id: (r.code, r.body) for r in transactions.assembled(df, max_frame=500, max_bytes=1000).collect()}
    assert got == {fs[0]["id"]: (code, None if code else good) for code, fs in cases.items()}
    assert transactions.assembled(df.limit(0)).count() == 0
