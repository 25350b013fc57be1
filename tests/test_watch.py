"""Streams of notifications against a loop over them, and against windows."""

import datetime as dt
import random

from factloom.streaming import changes, watch

START = dt.datetime(2024, 1, 1)


def notifications(seed, n, groups=3, paths=6):
    rng, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 5, 20, 60, 79, 80, 200])
        out.append((f"g{rng.randrange(groups)}", f"p{rng.randrange(paths)}", rng.choice(["add", "change", "change", "unlink"]), rng.choice("ab"), START + dt.timedelta(milliseconds=at), i))
    return out


def by_loop(rows, quiet, capacity, until=None):
    """Bursts of each group, by hand: a list of fingerprints, the least recent first, and an open burst."""
    out, seen, open_ = [], {}, {}

    def close(g):
        first = {}
        for ts, path, event in open_.get(g, []):
            a, _ = first.get(path, (event, None))
            first[path] = (a, event)
        ends = [x[0] for x in open_.pop(g, [])]
        for path, (a, b) in first.items():
            if (a, b) != ("add", b) or b != "unlink":
                kind = "add" if a == "add" else "unlink" if b == "unlink" else "change"
                if not (a == "add" and b == "unlink"):
                    out.append((g, ends[0], ends[-1], path, kind))

    for g, path, event, mark, ts, _ in sorted(rows, key=lambda r: (r[4], r[5])):
        told, mine = "missing" if event == "unlink" else mark, seen.setdefault(g, [])
        known = next((m for p, m in mine if p == path), None)
        mine[:] = [x for x in mine if x[0] != path] + [(path, told)]
        del mine[:-capacity]
        if known == told:
            continue
        if open_.get(g) and ts - open_[g][-1][0] >= quiet:
            close(g)
        open_.setdefault(g, []).append((ts, path, event))
        if len({p for _, p, _ in open_[g]}) >= capacity:
            close(g)
    for g in list(open_):
        if until is None or open_[g][-1][0] + quiet < until:
            close(g)
    return sorted(out)


def through_stream(spark, tmp_path, rows, files, **more):
    rows = sorted(rows, key=lambda r: (r[4], r[5]))
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], watch.WATCHED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = watch.folded(changes.events(spark, str(tmp_path / "in"), watch.WATCHED, 1), **more)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(watch.BURSTS).parquet(str(tmp_path / "out")).collect()


def test_stream_equals_the_loop(spark, tmp_path):
    rows = notifications(1, 120)
    for name, capacity in (("wide", 4096), ("narrow", 3)):
        got = through_stream(spark, tmp_path / name, rows, 3, capacity=capacity)
        quiet = dt.timedelta(milliseconds=80)
        assert sorted((r.group, r.start, r.end, r.path, r.event) for r in got) == by_loop(rows, quiet, capacity, max(r[4] for r in rows))
        # the state of a group never has more than its bounds
        assert max(r.remembered for r in got) <= capacity and max(r.waiting for r in got) < capacity
    batch = watch.folded_batch(spark.createDataFrame(rows, watch.WATCHED)).collect()
    assert sorted(tuple(r) for r in batch) == by_loop(rows, quiet, 4096)


def test_folds():
    w, quiet, ms = watch.Watch(), 80_000, 1000
    assert w.hear("a", "add", "1", 0, quiet, 9) == [] and w.hear("a", "change", "2", 5 * ms, quiet, 9) == [] and w.hear("a", "change", "2", 9 * ms, quiet, 9) == []
    assert w.hear("b", "unlink", None, 10 * ms, quiet, 9) == [] and w.hear("b", "add", "3", 11 * ms, quiet, 9) == [] and w.hear("c", "add", "4", 12 * ms, quiet, 9) == [] and w.hear("c", "unlink", None, 13 * ms, quiet, 9) == []
    again = watch.Watch.read(w.text())
    assert again.hear("d", "change", "5", 93 * ms, quiet, 9) == [(0, 13 * ms, "a", "add"), (0, 13 * ms, "b", "change")]
    assert again.flush() == [(93 * ms, 93 * ms, "d", "change")] and again.flush() == []
