"""Each operator against a brute-force version, and its edge cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bytebpe, chat, embedding, mixing, nearcopies, quality, queries, simhash, tokencounts, tokenfiles, toxicity, urls
from factloom.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, component_id string, fp string, row string, id string"


def docs(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names operators use for their own."""
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, "x", "y", "z", None, "q") for i, t, s in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n)) + "."


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", None), (5, "one two", "b"), (5, "one two", "b"), (None, "null id here", "b"), (7, "wörd " * 30000, "a"), (8, "\x00\x01     x", "")]


@pytest.mark.parametrize("split", [1_000_000, 3])
def test_components_of_paths_stars_and_cycles(spark, split):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 3000)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), split_degree=split).collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(50))
    assert got[2002] == 2000 and 3000 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 ----------------------------------------------------------------------------------------------


def test_fold_keeps_places():
    for t in ["Idi0t", "IDІOT", "могon", "İstanbul ß ﬁ", "ＬＯＳＥＲ", "$tup1d"]:
        assert len(toxicity.fold(t)) == len(t)
    assert toxicity.fold("Idi0t") == "idiot" and toxicity.fold("$tup1d") == "stupid" and toxicity.fold("ＬＯＳＥＲ") == "loser"
    assert toxicity.fold("іdіоt") == "idiot"


def test_hits_at_word_bounds_with_exceptions():
    lex = toxicity.Lexicon({"clown": 2.0, "idiot": 3.0}, {"lowei": 4.0}, ("clown fish",))
    found = lambda t: [(a, b) for a, b, _ in toxicity.hits(t, lex.key())]
    assert found("an idiot!") == [(3, 8)] and found("idiots idiotic 1d1ot") == [(15, 20)]
    assert found("clown fish and clown") == [(15, 20)]
    assert found("Loweiment, xlowei") == [(0, 5)]
    assert found("idiot$$$ [idiot]") == [(0, 5), (10, 15)]
    assert toxicity.score("i​diot", lex, lex.key()) > toxicity.score("", lex, lex.key())
    assert toxicity.hits("", toxicity.Lexicon().key()) == []


def test_one_stands_for_i_and_l():
    lex = toxicity.Lexicon({w: 3.0 for w in toxicity.SEED})
    assert all(len(toxicity.hits(t, lex.key())) == 1 for t in ["1oser", "c1own", "assho1e", "worth1ess", "|oser", "1d1ot", "imbeci!e", "VI1E vermin"])
    df, spelt = toxicity._candidates([("b1urgh blurgh", 1), ("blurgh", 1)], (4,))
    assert df[0, "biurgh", 1] == 2 and spelt[0, "biurgh"].most_common(1)[0][0] == "blurgh"


WORDS = {"idiot": 3.0, "lid": 2.0, "il": 1.5, "clown": 2.5, "tot": 1.0}
STARTS = {"lowe": 4.0, "idio": 2.0, "lo": 0.5}


def hits_by_search(text):
    """Every entry looked for in the folded text at every place where a word of the text begins."""
    shape = toxicity.shape(text)
    spots = [i for i in range(len(text)) if i == 0 or not text[i - 1].isalnum()]
    fits = lambda x, i, whole: shape.startswith(x, i) and (not whole or i + len(x) == len(text) or not text[i + len(x)].isalnum())
    away = [(i, i + len(x)) for x in ("clown fish", "il") for i in spots if fits(toxicity.shape(x), i, True)]
    found = []
    for i in spots:
        best = max([(w, i + len(x)) for x, w in WORDS.items() if fits(toxicity.shape(x), i, True)] + [(w, i + len(x)) for x, w in STARTS.items() if fits(toxicity.shape(x), i, False)], default=None)
        if best and not any(p <= i and best[1] <= q for p, q in away):
            found.append((i, best[0]))
    return found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "1d1oт", "IDIOTS", "lid", "1|!", "il", "clown", "c1own fish", "clown  fish", "lowe", "l0wering", "tot", " ", ", ", "é", "_", "9"]), max_size=14))
def test_hits_by_brute_force(parts):
    text = "".join(parts)
    lex = toxicity.Lexicon(WORDS, STARTS, ("clown fish", "il"))
    assert [(a, w) for a, _, w in toxicity.hits(text, lex.key())] == hits_by_search(text)


def test_weak_signs_count_where_they_gather(spark):
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        signs = ["zzbl" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(4, 7) if toxic else i % 9 == 0)]
        w = prose(rng, 80).split() + signs
        rng.shuffle(w)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    d = docs(spark, rows)
    lex = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.scored(d, lex).collect()}
    assert any(x.startswith("zzbl") for x in lex.starts)
    assert not any(got[i] for i in range(600) if i % 5) and sum(got[i] for i in range(0, 600, 5)) >= 114


def test_toxicity_learns_from_allowed_rows_only(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng, 60)
        if bad:
            text += " blarghish " + prose(rng, 5)
        # rows held out carry lies: they must not count
        held = zlib.crc32(str(i).encode()) % 3 == 1
        rows.append((i, text, "s"))
        labels.append((i, 1, int(bad) if not held else int(not bad)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(9000, None, None), (9001, "", None)])
    lex = toxicity.learn(d, lab)
    assert "blarghish" in lex.words or any("blarghish".startswith(b) for b in lex.starts)
    got = {r.doc_id: r.score for r in toxicity.scored(d, lex).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(400))
    assert 0 <= got[9000] == got[9001] < 0.7
    kept = toxicity.drop_toxic(d, lex)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4} | {9000, 9001}


def test_copies_make_no_signs(spark):
    rng = random.Random(13)
    clean = [(i, prose(rng, 40), "s") for i in range(200)]
    copied = prose(rng, 40) + " idiot"
    bad = [(1000 + i, copied, "s") for i in range(40)] + [(2000 + i, prose(rng, 40) + " zzblurg", "s") for i in range(40)]
    lab = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, *_ in clean + bad], "doc_id long, quality int, toxic int")
    lex = toxicity.learn(docs(spark, clean + bad), lab)
    assert "zzblurg" in lex.words or any("zzblurg".startswith(b) for b in lex.starts)
    assert not set(copied.split()) & (set(lex.words) - set(toxicity.SEED))


def test_texts_that_share_a_word_are_no_copies(spark):
    rng = random.Random(14)
    word = F.concat(F.lit("w"), F.col("id").cast("string"))
    shared = spark.range(50_000).select(word.alias("w")).orderBy(F.xxhash64("w")).first().w
    clean = [(i, f"{prose(rng, 40)} {shared}", "s") for i in range(200)]
    bad = [(1000 + i, f"{prose(rng, 40)} {shared} zzblurg", "s") for i in range(60)]
    lab = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, *_ in clean + bad], "doc_id long, quality int, toxic int")
    lex = toxicity.learn(docs(spark, clean + bad), lab)
    assert "zzblurg" in lex.words or any("zzblurg".startswith(b) for b in lex.starts)


@pytest.mark.parametrize("chunk", [256, 5])
def test_near_copies_stay_once_for_each_class(spark, chunk):
    rng = random.Random(15)
    rows = [(1, "", 0), (2, None, 0), (3, "one two", 0), (4, "One, two.", 0), (5, "one three", 0)]
    for g in range(6):
        base, line = prose(rng, 80).split(), prose(rng, 12)
        for k in range(12):
            w = list(base)
            for _ in range(3 * (k > 0)):
                w[rng.randrange(80)] = prose(rng, 1)
            rows.append((100 * g + 10 + k, " ".join(w), g % 2))
        rows += [(1000 + 100 * g + k, f"{prose(rng, 60)} {line}", 0) for k in range(5)]
    rows.append((9999, rows[5][1], 1))
    got = nearcopies.one_of_copies(spark.createDataFrame(rows, "i long, t string, y int"), "i", "t", "y", chunk_rows=chunk)
    want = {1, 3, 5, 9999} | {100 * g + 10 for g in range(6)} | {1000 + 100 * g + k for g in range(6) for k in range(5)}
    assert sorted(r.i for r in got.collect()) == sorted(want)
    assert nearcopies.one_of_copies(spark.createDataFrame([], "i long, t string, y int"), "i", "t", "y").count() == 0


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lex = toxicity.learn(docs(spark, EDGES), none)
    assert set(lex.words) >= {"idiot"} and toxicity.scored(docs(spark, EDGES), lex).count() == len(EDGES)
    assert toxicity.scored(docs(spark, []), lex).count() == 0


# --- 2 ----------------------------------------------------------------------------------------------


def links_of(rows, threshold=0.98):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, up = Counter(), {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, x, l), (j, y, m) = ok[a], ok[b]
            if l == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return n, find


@pytest.mark.parametrize("chunk, few", [(512, 32), (8, 32), (512, 2), (8, 2), (512, 0)])
def test_embedding_links_are_all_found(spark, chunk, few):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            c = rng.standard_normal(64)
            for _ in range(rng.integers(1, 12)):
                v = c + rng.standard_normal(64) * np.linalg.norm(c) * rng.choice([0.01, 0.02, 0.03])
                rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1.0, 1000.0])], label))
                k += 1
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, None, 0), (k + 3, [0.0] * 64, 0), (k + 4, [float("nan")] * 64, 0), (k + 5, [None] + [1.0] * 63, 1), (k + 6, [float("inf")] * 64, 1), (k + 7, [], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, kept string, n_links int")
    n, find = links_of(rows)
    got = embedding.near_duplicates(df, chunk_rows=chunk, dealt_rows=chunk, few=few).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert r.n_links == 0 and r.component_id is None and not r.kept
        else:
            assert (r.vec_id, r.n_links, r.component_id) == (r.vec_id, n[r.vec_id], find(r.vec_id)) and r.kept == (r.vec_id == r.component_id)
    assert sum(n.values()) > 200


def test_divided_cells_find_every_close_pair_once():
    """Any two rows of a cell that are within the radius meet in one finer cell, one of them at home."""
    import pyarrow as pa

    rng, width, threshold = np.random.default_rng(4), 8, 0.98
    radius = embedding._radius(0, 8, 64, threshold)
    xy = (rng.standard_normal((400, 8)) * radius * 0.5).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 400), pa.array([64] * 400, pa.int32()), pa.array([0] * 400, pa.int32()), pa.array([5] * 400), pa.array([0] * 400, pa.int8()), pa.array(range(400)), pa.array(xy.tolist(), pa.list_(pa.float32()))], names=["label", "dim", "block", "cell", "role", "rep", "xy"])
    out = [r for b in embedding._divided(iter([batch.slice(0, 100), batch.slice(100)]), threshold, width, 3, 2.0) for r in b.to_pylist()]
    cells, met = {}, Counter()
    for r in out:
        cells.setdefault(r["sub"], []).append((r["rep"], r["part"]))
    for rows in cells.values():
        for k, (a, p) in enumerate(rows):
            for b, q in rows[k + 1 :]:
                if not (p and q):
                    met[min(a, b), max(a, b)] += 1
    near = {(a, b) for a in range(400) for b in range(a + 1, 400) if ((xy[a].astype(float) - xy[b].astype(float)) ** 2).sum() <= radius * radius}
    assert len(near) > 500 and all(met[p] == 1 for p in near) and max(met.values()) == 1


def test_embedding_labels_of_other_types(spark):
    one, far = [1.0, 2.0, 3.0], [-1.0, 2.0, 0.5]
    rows = [(1, one, "a"), (2, one, "a"), (3, one, "b"), (4, far, "a"), (5, one, None)]
    text = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in text.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    rows = [(1, one, 1.2), (2, one, 1.7), (3, one, 0.0), (4, one, -0.0)]
    real = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double"))
    assert sorted((r.vec_id, r.component_id) for r in real.collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]


def test_embedding_of_no_rows(spark):
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pigeonhole_grid_reaches_every_close_block():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    y = embedding._coordinates(x, 7)
    u = embedding._unit(x)
    assert np.allclose(y @ y.T, u @ u.T) and np.array_equal(embedding._coordinates(x[5:6], 7)[0], y[5])


# --- 3 ----------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be [INST]good[/INST]"), (1, 1, "user", "hi\\</s>"), (1, 2, "assistant", "a[\\INST]\n"), (1, 4, "assistant", ""), (1, 3, "user", None), (1, 5, "user", "[[INST]"),
        (2, 0, "assistant", "[INST" + "]"), (3, 0, None, "x"), (3, 0, "user", "tie"), (4, None, "user", "<</s>"), (None, 0, "assistant", "no id"), (5, 1, "ro[/INST]le", "$1 \\1 ü€😀"), (5, 2, "assistant", "😀" * 5000),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    convs = {}
    for r in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
    replies = made.where("loss_start IS NOT NULL").count()
    assert replies == sum(r[2] == "assistant" for r in rows)
    # no control string but the template's own
    for r in made.collect():
        assert r.formatted.count("[INST]") == r.formatted.count("[/INST]") == r.formatted.count("</s>")
    assert chat.digests(chat.examples(df.where("false"))).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    often, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if often[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab#\n \t\x0b é\x1c", max_size=80))
def test_quality_features_by_brute_force(text):
    assert quality.features(text)[:5] == base_counts(text)


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(4)
    good = [(1000 + i, ".\n".join(prose(rng, 20) for _ in range(5)), "s") for i in range(60)]
    junk = [(100 + i, " ".join(w + "***" for w in prose(rng, 80).split()), "s") for i in range(8)]
    d = docs(spark, good + junk + EDGES)
    got = {r.doc_id: r for r in quality.judge(d).collect()}
    for i, t, _ in good + junk + EDGES:
        r = got[i]
        n = base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
    assert all(got[i].kept for i, *_ in good) and not any(got[i].kept for i, *_ in junk)
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)
    assert quality.judge(docs(spark, [])).count() == 0 and quality.keep_good(docs(spark, [])).count() == 0


def test_posterior_beats_all_must_pass():
    """Rules that err now and then: no one rule's bad vote decides, what they say together does."""
    rng = np.random.default_rng(3)
    n, rates = 20_000, [(0.02, 0.9), (0.15, 0.6), (0.1, 0.7), (0.3, 0.35), (0.05, 0.8)]  # a bad vote's rate on good and on bad documents
    truth = rng.random(n) < 0.85
    votes = np.stack([np.where(rng.random(n) < np.where(truth, g, b), 1, np.where(rng.random(n) < 0.8, 2, 0)) for g, b in rates], axis=1)
    codes = (votes * 3 ** np.arange(4, -1, -1)).sum(axis=1)
    counts = Counter(codes.tolist())
    model = quality.fit(dict(counts), 5)
    kept = model.posterior(votes) >= 0.5
    strict = ~(votes == 1).any(axis=1)
    right, strictly = (kept == truth).mean(), (strict == truth).mean()
    assert (kept != strict).sum() > 1000 and right > 0.97 > 0.7 > strictly
    # where the two differ, the truth sides with the posterior
    assert (kept == truth)[kept != strict].mean() > 0.95
    assert abs(model.share - 0.85) < 0.02 and all(abs(model.bad[k, 1] - b) < 0.06 and abs(model.good[k, 1] - g) < 0.02 for k, (g, b) in enumerate(rates))
    # the same estimate by a plain loop over documents' votes
    share, good, bad = model.share, model.good, model.bad
    for v in votes[:200]:
        p, q = share, 1 - share
        for k, x in enumerate(v):
            p, q = p * good[k, x], q * bad[k, x]
        assert model.posterior(v[None])[0] == pytest.approx(p / (p + q))


def test_one_bad_vote_is_outvoted(spark):
    rng = random.Random(12)
    fine = [(i, ".\n".join(prose(rng, 20) for _ in range(8)) + ".", "s") for i in range(80)]
    junk = [(500 + i, "\n".join(" ".join(w + "#*$" for w in prose(rng, 20).split()) for _ in range(8)), "s") for i in range(12)]
    line = prose(rng, 10)
    # prose with lines that repeat, and short prose: one rule speaks against each
    odd = [(800 + i, ".\n".join([*(prose(rng, 14) for _ in range(8)), line, line, line]) + ".", "s") for i in range(4)] + [(900 + i, prose(rng, 60), "s") for i in range(4)]
    d = docs(spark, fine + junk + odd)
    votes = {n: quality.rules(F.col)[n].alias(n) for n in quality.rules(F.col)}
    made = spark.createDataFrame([(i, *quality.features(t)) for i, t, _ in odd], "doc_id long, " + quality._DDL)
    assert all(1 in r[1:] for r in made.select("doc_id", *votes.values()).collect())
    kept = {r.doc_id: r.kept for r in quality.judge(d).collect()}
    assert all(kept[i] for i, *_ in fine + odd) and not any(kept[i] for i, *_ in junk)


def em_by_hand(patterns):
    """Expectation-maximisation written out: patterns is votes -> documents; the posterior of each."""
    believed = {True: (0.45, 0.10, 0.45), False: (0.40, 0.35, 0.25)}
    good = {}
    for votes in patterns:
        bad, fine = votes.count(1), votes.count(2)
        good[votes] = 0.95 if not bad else (fine + 1) / (bad + fine + 2)
    for _ in range(500):
        rate = {}
        for side in (True, False):
            for k in range(8):
                t = [10 * believed[side][v] + sum(n * (good[p] if side else 1 - good[p]) for p, n in patterns.items() if p[k] == v) for v in range(3)]
                rate[side, k] = [x / sum(t) for x in t]
        share = (sum(n * good[p] for p, n in patterns.items()) + 9) / (sum(patterns.values()) + 10)
        new = {}
        for p in patterns:
            a, b = math.log(share), math.log(1 - share)
            for k, v in enumerate(p):
                a, b = a + math.log(rate[True, k][v]), b + math.log(rate[False, k][v])
            new[p] = 1 / (1 + math.exp(min(500, max(-500, b - a))))
        moved = max((abs(new[p] - good[p]) for p in patterns), default=0)
        good = new
        if moved < 1e-9:
            break
    return good


def test_posteriors_by_hand(answer, spark, sf):
    """The query's posterior and verdict from votes counted one document at a time."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made = spark.createDataFrame([(i, *quality.features(t)) for i, t in texts.items()], ["doc_id", *quality.FEATURES])
    votes = {r[0]: tuple(r)[1:] for r in made.select("doc_id", *quality.rules(F.col).values()).collect()}
    got = {r.doc_id: r for r in answer("op4_quality_rules").itertuples()}
    want = em_by_hand(Counter(votes[i] for i in texts if not got[i].base_failed))
    for i, r in got.items():
        if not r.base_failed:
            assert r.posterior == pytest.approx(want[votes[i]], abs=1e-6) and r.kept == (want[votes[i]] >= 0.5)
        else:
            assert not r.kept
    assert any(r.kept for r in got.values()) and any(not r.kept and not r.base_failed for r in got.values())


def test_em_of_nothing_and_of_abstentions():
    assert quality.fit({}, 8).share == pytest.approx(0.9)
    assert 0 < quality.fit({0: 5}, 8).posterior(np.zeros((1, 8), int))[0] < 1


# --- 5 ----------------------------------------------------------------------------------------------

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aÀßéi̇́ .,!'st\n\t \x1cİΣσ0९|<>", max_size=60)))
def test_words_encode_as_the_whole_text(text):
    got = np.frombuffer(tokenfiles.encoder(tokenfiles.default_tokenizer()).encode(text), "<i4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_token_files(spark, tmp_path):
    rows = EDGES[:6] + EDGES[7:] + [(-3, "It's <|endoftext|> here, don't", "a"), (30, prose(random.Random(1), 500), "a")]
    d = docs(spark, rows).repartition(3)
    got = tokenfiles.write_and_read(d).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(((i, t or "") for i, t, _ in rows), key=lambda r: r[0])):
        ids = TOKENIZER.encode(t, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
    path = str(tmp_path / "tokens")
    tokenfiles.write(d, path, files=2)
    import glob

    import pyarrow.parquet as pq

    files = sorted(glob.glob(f"{path}/part-*"))
    ids = [pq.read_table(f, columns=["id"])["id"].to_pylist() for f in files]
    assert sum(ids, []) == sorted(r[0] for r in rows)
    column = pq.ParquetFile(files[-1]).metadata.row_group(0).column(4)
    assert "DICTIONARY" in str(column.encodings) and column.has_offset_index
    # counts without ids, and the ids of one document: the scan reads these columns and pushes the filter down
    few = tokenfiles.read(spark, path).select("id", "n_tokens")
    assert "tokens:array" not in few._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    one = tokenfiles.read(spark, path).where("id = 30")
    assert "EqualTo(id,30)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.first().tokens == TOKENIZER.encode(rows[-1][1], add_special_tokens=False).ids + [2]
    assert tokenfiles.write_and_read(docs(spark, [])).count() == 0


def test_token_files_of_another_tokenizer(spark, tmp_path):
    other = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(other)
    rows = [(1, "Two  Words,\nthen MORE", "a"), (2, None, "a"), (3, " lead", "a")]
    path = str(tmp_path / "other")
    tokenfiles.write(docs(spark, rows), path, tokenizer=other, end_id=50256, files=1)
    got = {r.id: r.tokens for r in tokenfiles.read(spark, path).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [50256] for i, t, _ in rows}


def test_number_of_token_files_follows_the_texts(spark, tmp_path):
    import glob

    path = str(tmp_path / "many")
    tokenfiles.write(docs(spark, [(i, "one two three four", "a") for i in range(400)] + [(None, f"no id {i}", "a") for i in range(400)]), path, file_bytes=1000)
    assert len(glob.glob(f"{path}/part-*")) >= 8


# --- 6 ----------------------------------------------------------------------------------------------


def judged_by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v == "allow", h + p, v) for v, h, p in ((v, re.sub("[A-Z]", lambda m: m[0].lower(), h), p) for v, h, p in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_by_brute_force(spark):
    rng = random.Random(9)
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "EXAMPLE.net", "x.y.example.net", "org", "", "..", "é.org", "com.", "a.com:80", "com\x01x", "x.com\x02", "\x02.com", "\U0010ffff\U0010ffff\U0010ffff\U0010ffff.com", "com\x02e", "\x01"]
    paths = ["", "/", "/en/", "/en/7", "/en/71", "/EN/7", "/de/8x?q=/en/", "/es/#/de/", "?/en/7", "#/en/7", "/de"]
    urls_ = [rng.choice(["http://", "https://", "x:", "://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)]
    urls_ += [None, "", "nothing", "http://"] + ["http://example.com/en/7"] * 100
    df = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls_)], "page_id long, url string, host int, verdict string")
    rules = urls.RULES + [("block", "example.com", "/en/71"), ("allow", "y.example.net", ""), ("block", "notexample.com", "/"), ("block", "COM\x02", "/en/"), ("allow", "\x01", "/de")]
    for given_rules in (urls.RULES, rules, []):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df, given_rules).collect()}
        assert got == {i: judged_by_hand(u, given_rules) for i, u in enumerate(urls_)}
    assert urls.judged(df.where("false")).count() == 0


def test_urls_by_the_rules_of_the_contract(spark):
    """The contract's list, word by word, and a page for each rule."""
    assert urls.RULES == [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    said = [("a.com/en/1", "block"), ("example.com/en/71", "allow"), ("a.net/de/1", "allow"), ("x.example.net/de/8", "block"), ("example.net/de/7", "allow"), ("a.org/es/", "block"), ("a.net/en/", "block")]
    df = spark.createDataFrame([(i, f"http://{u}") for i, (u, _) in enumerate(said)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judged(df, default="block").collect()}
    assert [got[i][1] for i in range(len(said))] == [v for _, v in said] and got[2][0] == "net/de/" and got[6][0] is None


# --- 7 ----------------------------------------------------------------------------------------------


def level(sizes, weights, most=3.0):
    total, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        for i in over or free:
            target[i] = most * sizes[i] if over else share[i]
        free = free - over if over else set()
    return target


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for _ in range(20):
        size = rng.integers(1, 50, 200)
        p = mixing.flight(np.full(200, rng.random()), size, rng) if _ else mixing.flight(np.zeros(200), size, rng)
        q = rng.random(200)
        r = mixing.flight(q, size, rng)
        assert ((r > 0) & (r < 1)).sum() <= 2 and abs(r.sum() - q.sum()) < 1e-6 and abs((r * size).sum() - (q * size).sum()) < 1e-4
        assert p.min() >= 0 and p.max() <= 1


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 40)), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}" if rng.random() > 0.1 else None) for i in range(1500)] + [(5000, None, "s0"), (5001, "", "empty"), (5002, "one", "tiny")]
    d = docs(spark, rows)
    plan = mixing.plan(d, chunk=64).collect()
    again = mixing.plan(d.repartition(7), chunk=64).collect()
    assert sorted((r.id, r.copies) for r in plan) == sorted((r.id, r.copies) for r in again)
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len(WORD.findall(t or "")) for _, t, s in rows if s == x) for x in sources]
    want = dict(zip(sources, level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])))
    for x, n in zip(sources, sizes):
        mine = [r for r in plan if r.source == x]
        assert all(r.source_size == n and r.target == pytest.approx(want[x]) for r in mine)
        assert all(0 <= r.copies <= 3 for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - want[x]) <= max(40, 0.02 * want[x])
    out = mixing.mixed(d)
    assert out.columns == d.columns and out.where("doc_id = 5002").count() <= 3
    assert mixing.plan(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0


# --- 8 ----------------------------------------------------------------------------------------------


def simhash_by_hand(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n .", max_size=60))
def test_simhash_by_brute_force(text):
    assert simhash.fingerprint(text) % 2**64 == simhash_by_hand(text)


@pytest.mark.parametrize("chunk", [256, 3])
def test_simhash_links_by_brute_force(spark, chunk):
    rng = random.Random(7)
    prints = [0, 0xFFFFFFFFFFFFFFFF]
    for _ in range(15):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 15)):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            prints.append(y)
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame(list(enumerate(signed)), "rep long, fp long"), chunk_rows=chunk)
    got = {r.node: r.component for r in components(edges).collect()}
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                p, q = sorted((find(i), find(j)))
                up[q] = p
    assert {i: got.get(i, i) for i in range(len(prints))} == {i: find(i) for i in range(len(prints))}


def test_simhash_documents(spark):
    rng = random.Random(8)
    base = prose(rng, 300)
    rows = EDGES + [(20, base, "a"), (21, base.upper(), "a"), (22, base + " end", "b"), (23, prose(rng, 300), "b")]
    d = docs(spark, rows)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert all(got[i][0] == simhash_by_hand(t) for i, t, _ in rows)
    assert got[1][1] == got[2][1] == got[3][1] == 1 and got[21][1] == 20 and got[23][1] == 23
    kept = simhash.keep_one(d)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == d.columns and len(ids) == len(set(ids)) and {1, 4, 20, 23, None} <= set(ids) and not {2, 3, 21} & set(ids)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_simhash_groups_of_repeated_ids_keep_one_each(spark):
    rng = random.Random(9)
    a, b, c = prose(rng, 200), prose(rng, 200), prose(rng, 200)
    rows = [(5, a, "a"), (5, b, "a"), (5, b.upper(), "b"), (6, b, "b"), (7, a, "b"), (3, c, "a"), (5, c, "b"), (None, a, "b")]
    d = docs(spark, rows)
    got = {(r.doc_id, r.text.lower() if r.text else r.text) for r in simhash.keep_one(d).collect()}
    assert got == {(5, a), (5, b), (3, c), (None, a)} and simhash.keep_one(d).count() == 4
    ids = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(d.where("doc_id IS NOT NULL")).collect())
    assert ids == [(3, 3), (5, 3), (5, 5), (5, 5), (5, 5), (6, 5), (7, 5)]


# --- 9 ----------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1\n\t'é 日😀.s"), max_size=120), st.integers(1, 10))
def test_pieces_encode_as_the_whole(text, size):
    path, pattern = bytebpe.default_ranks(), public_tokenizers.PATTERN
    whole = bytebpe.encoding(path, pattern).encode_ordinary(text)
    ids = bytebpe.encode(text, path, pattern, size)
    assert ids.tolist() == whole and bytebpe.decode(ids, path, pattern).decode() == text
    assert "".join(bytebpe.pieces(text, size)) == text


def test_long_texts_without_blanks_are_cut():
    text = "日本語の文です。ここで切れます、" * 2000
    assert max(map(len, bytebpe.pieces(text, 1000))) < 1100


def test_byte_bpe_query_columns(spark):
    d = docs(spark, EDGES)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.round_trips(d).collect()}
    enc = bytebpe.encoding(bytebpe.default_ranks(), public_tokenizers.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    whole = {i: enc.encode_ordinary(t or "") for i, t, _ in EDGES}
    assert got == {(i, len(whole[i]), sha(b"".join(x.to_bytes(4, "little") for x in whole[i])), sha((t or "").encode())) for i, t, _ in EDGES}
    ids = {r.doc_id: r.ids for r in bytebpe.encoded(d).collect()}
    assert ids[5] == enc.encode_ordinary("one two") and ids[1] == []
    assert bytebpe.round_trips(docs(spark, [])).count() == 0


# --- 10 ---------------------------------------------------------------------------------------------

CHANGES = "doc_id long, tokenizer string, op string, source string, lang string, n_tokens long, seq int, batch string"


def test_token_rollup(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame([(*r, "x") for r in rows], CHANGES)
    r = tokencounts.TokenRollup(spark, str(tmp_path / "r"), buckets=4)
    assert r.totals().count() == 0
    one = batch((1, "t", "insert", "a", "en", 10, 0), (2, "t", "insert", "a", None, 5, 0), (2, "t", "insert", "a", None, 5, 0), (3, "t", "insert", None, "en", None, 0), (None, "t", "insert", "a", "en", 7, 0), (1, "u", "insert", "a", "en", 1, 0))
    assert r.apply(1, one) and not r.apply(1, one)
    assert r.apply(2, batch((1, "t", "revise", "b", "en", 12, 1), (1, "t", "revise", "b", "en", 99, 0), (2, "t", "delete", None, None, 0, 0), (9, "t", "delete", "a", "en", 4, 0), (4, "t", "revise", "a", "en", 3, 0)))
    got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert got == {("b", "en", "t"): (1, 12), (None, "en", "t"): (1, 0), ("a", "en", "t"): (1, 3), ("a", "en", "u"): (1, 1)}
    assert r.apply(4, batch()) and not r.apply(2, one)
    # one that would come after a later one is refused and changes nothing
    with pytest.raises(tokencounts.BatchLate):
        r.apply(3, one)
    # a writer lost before its commit file has its name leaves nothing behind
    open(tmp_path / "r/commits/5.0123", "wb").close()
    assert 5 not in r.commits() and r.apply(5, batch((2, "t", "insert", "a", "en", 2, 0)))
    again = tokencounts.TokenRollup(spark, str(tmp_path / "r"), buckets=4)
    assert {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in again.totals().collect()}[("a", "en", "t")] == (2, 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_rollup_equals_a_recount(spark, tmp_path, seed):
    """Random batches, sent twice and now and then late, with snapshots between, against all state kept by hand."""
    rng = random.Random(seed)
    r = tokencounts.TokenRollup(spark, str(tmp_path / "r"), compact_after=3, buckets=3)
    held, done, number = {}, set(), 0
    for _ in range(8):
        number += rng.choice([1, 1, 2])
        rows = [(rng.randint(1, 12), rng.choice("tu"), rng.choice(["insert", "revise", "delete"]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.randint(0, 9), s) for s in range(rng.randint(0, 10))]
        df = spark.createDataFrame([(*x, "x") for x in rows], CHANGES)
        late = rng.randint(1, number)
        assert r.apply(number, df)
        for x in sorted(rows, key=lambda x: x[6]):
            key, last = (x[0], x[1]), max(y[6] for y in rows if y[:2] == x[:2])
            if x[6] == last:
                held.pop(key, None)
                if x[2] != "delete":
                    held[key] = (x[3], x[4], x[5])
        done.add(number)
        if late in done:
            assert not r.apply(late, df)
        else:
            with pytest.raises(tokencounts.BatchLate):
                r.apply(late, df)
        want = {}
        for (_, t), (source, lang, n) in held.items():
            d, k = want.get((source, lang, t), (0, 0))
            want[source, lang, t] = (d + 1, k + n)
        assert {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()} == want
    assert r._named("snapshots") and len(r._since()[1]) < 3


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    r = tokencounts.TokenRollup(spark, str(tmp_path / "r"), buckets=16)
    r.apply(1, spark.createDataFrame([(i, "t", "insert", "a", "en", 1, 0, "x") for i in range(200)], CHANGES))
    some = r._state([3, 5])
    assert {x.bucket for x in some.collect()} == {3, 5}
    assert "PartitionFilters: [" in some._jdf.queryExecution().executedPlan().toString() and len(some.inputFiles()) < 16 or some.count() < 200


def counts_by_library(rows, poor):
    """The query's totals from the libraries' own counts of whole texts."""
    enc = bytebpe.encoding(bytebpe.default_ranks(), public_tokenizers.PATTERN)
    both = lambda t: {tokencounts.WORDS: len(TOKENIZER.encode(t, add_special_tokens=False).ids), tokencounts.BYTES: len(enc.encode_ordinary(t))}
    want = {}
    for i, t, source, lang in rows:
        if i is None or i not in poor:
            for tok, n in both(re.sub(r"[#*$%&|<>]", "", t or "")).items():
                d, k = want.get((source, lang, tok), (0, 0))
                want[source, lang, tok] = (d + 1, k + n)
    return want


def test_a_crowd_of_equal_rows_counts_and_mixes_whole(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "BLOCK", 7)
    rows = [(None, "same words here", "hot")] * 40 + [(3, "same words here", "hot")] * 25 + [(k, "other words", "cold") for k in range(10, 30)]
    d = docs(spark, rows)
    got = {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in tokencounts.maintained(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert {k[0]: v[0] for k, v in got.items()} == {"hot": 65, "cold": 20} and all(v[1] % v[0] == 0 for v in got.values())
    # chunks of 8: the crowd of one id and size is dealt over them
    plan = mixing.plan(d, chunk=8).collect()
    assert len(plan) == 85 and Counter(r.source for r in plan) == {"hot": 65, "cold": 20}
    taken = Counter()
    for r in plan:
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[r.source] - r.target) <= 3 for r in plan)


def test_scores_by_hand(spark, sf):
    """The query's scores from hits looked for one by one, and the curve."""
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lex = toxicity.learn(d, labels)
    entries = [(toxicity.shape(w), x, True) for w, x in lex.words.items()] + [(toxicity.shape(w), x, False) for w, x in lex.starts.items()]
    away = [toxicity.shape(x) for x in lex.exceptions]
    c0, c1, c2, c3 = lex.curve
    got = {r.doc_id: r for r in queries.QUERIES["op1_toxicity"](spark, sf).collect()}
    for r in d.collect():
        text = toxicity.visible(r.text or "")
        shape, ends = toxicity.shape(text), lambda i: i == len(text) or not text[i].isalnum()
        weights = []
        for m in re.finditer(r"(?<![^\W_])[^\W_]|(?<![^\W_])[\W_](?=)", text):
            i = m.start()
            fits = [(x, i + len(e)) for e, x, whole in entries if shape.startswith(e, i) and (not whole or ends(i + len(e)))]
            if fits:
                x, end = max(fits, key=lambda f: f[0])
                spared = any(shape.startswith(e, k) and ends(k + len(e)) and k <= i and end <= k + len(e) and (k == 0 or not text[k - 1].isalnum()) for e in away for k in range(max(0, i - len(e)), i + 1))
                weights += [] if spared else [x]
        total = sum(weights)
        z = c0 + (c1 * max(weights) + c2 * math.log1p(total) + c3 * math.log1p(100 * total / max(50, len(text.split()))) if weights else 0)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), r.doc_id
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_token_counts_of_null_and_repeated_ids(spark):
    rows = [(1, "a b c", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, "x #y", "t"), (2, "x #", "t"), (None, "n u l l", "s"), (None, "n u l l", "s"), (3, "k", None), (4, "p q", "t"), (4, "p #", "t"), (7, None, "s"), (8, "", "s"), (9, "wörd <b> " * 5000, "t")]
    for poor in ({4}, set()):
        lab = spark.createDataFrame([(i, 0) for i in poor] + [(3, 1), (None, 0)], "doc_id long, quality int")
        got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in tokencounts.maintained(docs(spark, rows), lab).collect()}
        assert got == counts_by_library([(i, t, s, "en") for i, t, s in rows], poor)
    assert tokencounts.maintained(docs(spark, []), lab).count() == 0


# --- all --------------------------------------------------------------------------------------------


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def db(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(df):
    # a column of whole numbers with nulls comes as floats from one side
    one = lambda v: None if v is None or v is pd.NA or v != v else str(v) if isinstance(v, (str, bool, np.bool_)) else round(float(v), 6)
    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return sorted(([one(v) for v in r] for r in df.itertuples(index=False)), key=repr)


#: Queries that give a row for each row of a table; the others sum up.
ROWS_OF = {1: "documents", 2: "embeddings", 4: "documents", 5: "documents", 6: "pages", 7: "documents", 8: "documents", 9: "documents", 12: "documents"}


@pytest.fixture(scope="module")
def answer(spark, sf):
    """Each query's rows over the smallest tables, run once."""
    import functools

    return functools.lru_cache(None)(lambda name: queries.QUERIES[name](spark, sf).toPandas())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_and_equals_its_sql(answer, db, name):
    got = answer(name)
    table = ROWS_OF.get(int(name[2:].split("_")[0]))
    assert len(got) == db.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0] if table else len(got)
    if name in queries.ORACLE_SQL:
        want = db.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_queries_of_documents_by_brute_force(answer, db):
    """What the queries say of each document of the table, from the libraries and by hand."""
    rows = db.sql("SELECT doc_id, coalesce(text, ''), source, lang FROM documents ORDER BY doc_id").fetchall()
    by = lambda name: {r.doc_id: r for r in answer(name).itertuples()}
    enc, sha = bytebpe.encoding(bytebpe.default_ranks(), public_tokenizers.PATTERN), lambda b: hashlib.sha256(b).hexdigest()
    op4, op5, op7, op8, op9 = (by(n) for n in ("op4_quality_rules", "op5_token_files", "op7_source_mixing", "op8_simhash_near_dedup", "op9_byte_bpe"))
    start, prints, sizes = 0, {}, Counter()
    for i, t, s, _ in rows:
        r, n = op4[i], base_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n and r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        ids = np.array(TOKENIZER.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (op5[i].start, op5[i].n_tokens, op5[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        whole = np.array(enc.encode_ordinary(t), "<u4")
        assert (op9[i].n_tokens, op9[i].ids_sha256, op9[i].decoded_sha256) == (len(whole), sha(whole.tobytes()), sha(t.encode()))
        prints[i] = simhash_by_hand(t)
        assert op8[i].fingerprint == f"{prints[i]:016x}"
        assert op7[i].size == n[0] and op7[i].taken % max(1, n[0]) == 0 and op7[i].taken <= 3 * n[0]
        sizes[s] += n[0]
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = dict(zip(order, level([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    for i, _, s, _ in rows:
        assert op7[i].source_size == sizes[s] and op7[i].target == pytest.approx(want[s])
    up = {i: i for i in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                up[q] = p
    assert {i: r.component_id for i, r in op8.items()} == {i: find(i) for i in prints}
    poor = {r[0] for r in db.sql("SELECT doc_id FROM labels WHERE quality = 0").fetchall()}
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in answer("op10_token_counts").itertuples()}
    assert got == counts_by_library([(i, t, s, l) for i, t, s, l in rows], poor)


def test_pipeline_by_brute_force(spark, sf):
    """Each stage's decisions on what the stage before it kept."""
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, d, sf)
        kept[name] = (d.collect(), out.collect())
        d = spark.read.schema(out.schema).parquet(_put(out))
    before, after = kept["quality"]
    want = {r.doc_id for r in quality.judge(spark.createDataFrame(before)).collect() if r.kept}
    assert {r.doc_id for r in after} == want
    before, after = kept["toxicity"]
    lex = toxicity.learn(spark.createDataFrame(before), spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if toxicity.score(r.text, lex, lex.key()) < 0.7}
    before, after = kept["near_duplicates"]
    prints, left = {r.doc_id: simhash_by_hand(r.text) for r in before}, set()
    groups = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and groups[a] != groups[b]:
                low, high = sorted((groups[a], groups[b]))
                groups = {k: low if v == high else v for k, v in groups.items()}
    assert {r.doc_id for r in after} == set(groups.values())
    before, after = kept["mixing"]
    times, words = Counter(r.doc_id for r in after), Counter()
    for r in before:
        words[r.source] += len(WORD.findall(r.text))
    assert set(times) <= {r.doc_id for r in before} and max(times.values()) <= 3
    order = sorted(s for s in words if s is not None) + [None] * (None in words)
    for s, t in zip(order, level([words[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])):
        mine = [len(WORD.findall(r.text)) for r in before if r.source == s]
        assert abs(sum(len(WORD.findall(r.text)) for r in after if r.source == s) - t) <= max(mine)
    before, after = kept["encoding"]
    enc = bytebpe.encoding(bytebpe.default_ranks(), public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.n_tokens) for r in after) == sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in before)


def test_pipeline_stages_hand_on_documents(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    names = d.columns
    for name, stage in p.STAGES:
        out = stage(spark, d, sf)
        if name != p.STAGES[-1][0]:
            assert out.columns == names
            before = d.count()
            d = spark.read.schema(out.schema).parquet(_put(out))
            assert name == "mixing" or 0 < d.count() <= before
        else:
            assert out.count() == d.count()


def _put(df):
    from factloom.llm.common import scratch_path

    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return path
