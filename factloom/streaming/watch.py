"""A stream of file notifications folded to bursts of changes: duplicates dropped, quiet waited for.

A notification (WATCHED) says that a path was added, changed or unlinked, with a fingerprint of what is
there now. One that tells nothing new against the last fingerprint of its path is dropped; the last
`capacity` paths of a group are remembered, the one that was heard of longest ago goes first. What is left
is folded to one event for each path (an add and a change are an add, an add and an unlink nothing), and
the fold is handed on as a burst once the group has been quiet: when a later notification shows it, or when
the stream's clock, its watermark, passes the time. A burst of `capacity` paths is handed on at once, so a
group's state is bounded by twice `capacity` paths.

`folded` is the stream, with one state row a group and an event-time timer; `folded_batch` gives the same
for a finished table by windows, without a bound on the paths remembered. The gap, the clock and the bound
on a burst are ours.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATCHED = "group string, path string, event string, fingerprint string, ts timestamp, id long"
BURSTS = "group string, start timestamp, end timestamp, path string, event string, remembered int, waiting int"
CAPACITY = 4_096
MISSING = "missing"


class Watch:
    """The state of one group: fingerprints by path, the least recent first, and the open burst."""

    def __init__(self, seen: list | None = None, open_: list | None = None, start: int = 0, last: int = 0) -> None:
        self.seen: dict[str, str] = dict(seen or [])
        self.open: dict[str, tuple[str, str]] = {p: (a, b) for p, a, b in open_ or []}
        self.start, self.last = start, last

    @classmethod
    def read(cls, text: str) -> Watch:
        return cls(**json.loads(text))

    def text(self) -> str:
        return json.dumps({"seen": list(self.seen.items()), "open_": [(p, *e) for p, e in self.open.items()], "start": self.start, "last": self.last})

    def flush(self) -> list[tuple[int, int, str, str]]:
        """(start, end, path, event) of the open burst, by path; nothing of a path that came and went."""
        out = []
        for path, (first, last) in sorted(self.open.items()):
            event = {(True, True): "change", (True, False): "unlink", (False, True): "add", (False, False): None}[first != "add", last != "unlink"]
            if event:
                out.append((self.start, self.last, path, event))
        self.open = {}
        return out

    def hear(self, path: str, event: str, fingerprint: str | None, at: int, quiet: int, capacity: int) -> list[tuple[int, int, str, str]]:
        """Takes one notification at a time in microseconds; gives the bursts that end with it."""
        told = MISSING if event == "unlink" else fingerprint or ""
        known = self.seen.pop(path, None)
        self.seen[path] = told
        if len(self.seen) > capacity:
            del self.seen[next(iter(self.seen))]
        if known == told:
            return []
        out = self.flush() if self.open and at - self.last >= quiet else []
        if not self.open:
            self.start = at
        self.open[path] = (self.open[path][0] if path in self.open else event, event)
        self.last = at
        return out + (self.flush() if len(self.open) >= capacity else [])


def folded(stream: DataFrame, quiet_ms: int = 80, late: str = "0 seconds", capacity: int = CAPACITY) -> DataFrame:
    """BURSTS of a stream of WATCHED, one row for each path of a burst; `remembered` and `waiting` are the sizes
    of the group's state when the row was made.

    A group's rows of one micro-batch are taken by (ts, id) in one task, so a trigger bounds what that task
    holds; group by workspace, and by parts of one where it is large.
    """
    quiet = quiet_ms * 1000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watch = Watch.read(state.get[0]) if state.exists else Watch()
        out: list[tuple] = []

        def put(bursts: list[tuple[int, int, str, str]]) -> None:
            out.extend((*b, len(watch.seen), len(watch.open)) for b in bursts)

        if state.hasTimedOut:
            put(watch.flush())
        else:
            rows = pd.concat(list(batches)).sort_values(["us", "id"])
            for path, event, fingerprint, at in zip(rows["path"], rows["event"], rows["fingerprint"], rows["us"].tolist()):
                put(watch.hear(path, event, fingerprint, at, quiet, capacity))
        if watch.open:
            due = (watch.last + quiet) // 1000
            if due <= state.getCurrentWatermarkMs():
                put(watch.flush())
            else:
                state.setTimeoutTimestamp(due)
        state.update((watch.text(),))
        if out:
            made = pd.DataFrame(out, columns=["start", "end", "path", "event", "remembered", "waiting"])
            made.insert(0, "group", key[0])
            yield made

    # times are microseconds since the epoch in Python, whatever the session's time zone
    timed = stream.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    told = timed.groupBy("group").applyInPandasWithState(run, BURSTS.replace("timestamp", "long"), "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn("start", F.timestamp_micros("start")).withColumn("end", F.timestamp_micros("end"))


def folded_batch(rows: DataFrame, quiet_ms: int = 80) -> DataFrame:
    """(group, start, end, path, event) of a table of WATCHED, as `folded` with room for every path."""
    told = F.when(F.col("event") == "unlink", F.lit(MISSING)).otherwise(F.coalesce("fingerprint", F.lit("")))
    by_path = Window.partitionBy("group", "path").orderBy("ts", "id")
    by_group = Window.partitionBy("group").orderBy("ts", "id")
    new = rows.withColumn("__told", told).withColumn("__was", F.lag("__told").over(by_path)).where(~F.col("__told").eqNullSafe(F.col("__was")))
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(by_group)
    numbered = new.withColumn("__new", F.coalesce((gap >= quiet_ms * 1000).cast("int"), F.lit(0))).withColumn("__k", F.sum("__new").over(by_group.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct("ts", "id")
    paths = numbered.groupBy("group", "__k", "path").agg(F.min_by("event", order).alias("first"), F.max_by("event", order).alias("last"), F.min("ts").alias("__s"), F.max("ts").alias("__e"))
    whole = Window.partitionBy("group", "__k")
    before, after = F.col("first") != "add", F.col("last") != "unlink"
    event = F.when(before & after, "change").when(before, "unlink").when(after, "add")
    return paths.select("group", F.min("__s").over(whole).alias("start"), F.max("__e").over(whole).alias("end"), "path", event.alias("event")).where("event IS NOT NULL")
