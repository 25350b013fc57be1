"""The fact ledger: immutable shards of facts, generations that name them, and the newest as current.

Shards are content-addressed and written once; a generation is a manifest of shards, so unchanged
shards are shared between generations. A commit writes its tables first and the generation's small file
last, whole and without overwriting: a reader sees a whole generation or none, and of two writers with
the same base one wins and the other's base is stale. The highest generation is current. A reader is
pinned to the generation it opened.

Shards lie below the attempt that wrote them, in folders by the beginning of their digest, and a manifest
names each shard's attempt: a reader never meets what another writer of the same shard left, and a read of
some shards opens their folders only. A commit takes over the base's own shards where the content is the
same and writes the others; what it is given is written once, before anything is read from it. It looks at
the facts that it brings and, of the others, at those that name or are named by a fact that it adds or
takes away.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.identity import set_digest
from factloom.operators.diffs import manifest_changes
from factloom.operators.facts import SCHEMA as FACTS
from factloom.sources.tables import Rounds, publish, small_text

MANIFEST = "shard_key string, shard_digest string, namespace string, schema_version int, facts bigint, capabilities array<string>, attempt string"


class LedgerError(ValueError):
    """A transaction or lookup that the ledger refuses; `code` says why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Generation:
    universe: str
    sequence: int
    id: str
    producer: str
    source_manifest: str
    capabilities: tuple[str, ...]
    attempt: str = ""


def fact_line() -> Column:
    """What a fact adds to its shard's digest: all but the digest itself."""
    return F.to_json(F.struct("fact_id", "namespace", "schema_version", "kind", "subject", "completeness", "pass_id", "pass_version", "evidence", "inputs", "payload"))


#: Letters of a digest by which shards are dealt to folders.
FOLDER_LETTERS = 2


def folder_of(digest: Column) -> Column:
    return F.substring(F.substring_index(digest, ":", -1), 1, FOLDER_LETTERS)


def digests(facts: DataFrame) -> DataFrame:
    """(shard_key, shard_digest, namespace, schema_version, facts) of facts that have a shard_key.

    Facts' hashes are sorted and hashed by their first letters, then those of a shard together, so that
    no task holds all hashes of a large shard.
    """
    one = facts.select("shard_key", "namespace", "schema_version", F.sha2(fact_line(), 256).alias("h")).withColumn("n", F.lit(1).cast("long"))
    for letters in (3, 1, 0):
        key = F.substring("h", 1, letters) if letters else F.lit("")
        joined = F.array_join(F.array_sort(F.collect_list("h")), "\n")
        one = one.groupBy("shard_key", key.alias("k")).agg(F.min("namespace").alias("namespace"), F.min("schema_version").alias("schema_version"), F.concat("k", F.sha2(joined, 256)).alias("h"), F.sum("n").alias("n")).drop("k")
    body = F.concat_ws("\n", "shard_key", "namespace", F.col("schema_version").cast("string"), "h")
    return one.select("shard_key", F.concat(F.lit("fact-shard-digest:"), F.sha2(body, 256)).alias("shard_digest"), "namespace", "schema_version", F.col("n").alias("facts"))


def violations(facts: DataFrame) -> DataFrame:
    """(code, subject): what makes a shard's facts unfit, by stable codes."""
    repeated = facts.groupBy("fact_id").count().where("count > 1").select(F.lit("FACT_ID_DUPLICATE").alias("code"), F.col("fact_id").alias("subject"))
    mixed = facts.groupBy("shard_key").agg(F.count_distinct("namespace", "schema_version").alias("n")).where("n > 1").select(F.lit("SHARD_NAMESPACE_MIXED").alias("code"), F.col("shard_key").alias("subject"))
    spans = facts.where(F.exists("evidence", lambda e: (e["start"] < 0) | (e["end"] < e["start"]))).select(F.lit("FACT_SPAN_INVALID").alias("code"), F.col("fact_id").alias("subject"))
    blank = facts.where("fact_id IS NULL OR namespace IS NULL OR kind IS NULL OR subject IS NULL OR schema_version IS NULL OR schema_version < 1").select(F.lit("FACT_FIELD_MISSING").alias("code"), F.col("fact_id").alias("subject"))
    return repeated.unionByName(mixed).unionByName(spans).unionByName(blank)


def dangling_inputs(facts: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(fact_id, input): provenance inputs that no fact has; with `among`, inputs of `facts` that no fact of `among` has."""
    return _unmet(facts.select("fact_id", F.explode("inputs").alias("input")), facts if among is None else among)


def _unmet(inputs: DataFrame, among: DataFrame) -> DataFrame:
    return inputs.join(among.select(F.col("fact_id").alias("input")), "input", "left_anti").select("fact_id", "input")


def lineage(facts: DataFrame) -> DataFrame:
    """(src, dst): edges from an input to the facts made of it."""
    return facts.select(F.explode("inputs").alias("src"), F.col("fact_id").alias("dst"))


class Ledger:
    """A ledger in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # small files -----------------------------------------------------------------------------------

    def _load(self, name: str) -> dict | None:
        found = small_text(self.spark, f"{self.root}/{name}")
        return json.loads(found) if found else None

    def _store(self, name: str, value: dict) -> bool:
        """Writes a file whole; False if it is there already."""
        return publish(self.spark, f"{self.root}/{name}", json.dumps(value, sort_keys=True))

    # reading ---------------------------------------------------------------------------------------

    def current(self, universe: str) -> Generation | None:
        known = self._sequences(universe)
        return self.generation(universe, known[-1]) if known else None

    def _sequences(self, universe: str) -> list[int]:
        return sorted(int(n) for n in self._names(f"{universe}/generations") if n.isdigit())

    def generation(self, universe: str, sequence: int) -> Generation:
        found = self._load(f"{universe}/generations/{sequence}")
        if found is None:
            raise LedgerError("GENERATION_MISSING", f"{universe} has no generation {sequence}")
        return Generation(universe, sequence, found["id"], found["producer"], found["source_manifest"], tuple(found["capabilities"]), found["attempt"])

    def manifest(self, g: Generation) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{g.universe}/manifests/{g.attempt}")

    def shards(self, universe: str, manifest: DataFrame | None = None, folders: list[str] | None = None) -> DataFrame:
        """All facts that lie in a universe, with their attempt, or those of the shards of a manifest, found
        in the attempts that it names and, if given, some folders of them."""
        all_ = self.spark.read.schema("shard_key string, " + FACTS + ", attempt string, folder string").parquet(f"{self.root}/{universe}/shards")
        if manifest is None:
            return all_.drop("folder")
        attempts = [r[0] for r in manifest.select("attempt").distinct().collect()]  # commits whose shards are kept
        some = all_.where(F.col("attempt").isin(attempts))
        some = some if folders is None else some.where(F.col("folder").isin(folders))
        return some.drop("folder").join(manifest.select("attempt", "shard_digest"), ["attempt", "shard_digest"], "left_semi").select(*all_.columns[:-1])

    def facts(self, g: Generation, keys: list[str] | None = None) -> DataFrame:
        """The facts of a generation, or of its shards with some keys: its manifest, joined with the facts."""
        own = self.manifest(g)
        if keys is None:
            found = self.shards(g.universe, own)
        else:
            own = own.where(F.col("shard_key").isin(keys))
            found = self.shards(g.universe, own, self._folders(own))
        return found.drop("attempt").withColumn("generation", F.lit(g.id))

    def _folders(self, manifest: DataFrame) -> list[str]:
        """The folders that some shards lie in: at most 256 names."""
        return [r[0] for r in manifest.select(folder_of(F.col("shard_digest"))).distinct().collect()]

    # writing ---------------------------------------------------------------------------------------

    def commit(self, universe: str, base: Generation | None, upserts: DataFrame, deletes: list[str] = (), producer: str = "factloom", source_manifest: str = "", capabilities: list[str] = ()) -> Generation:
        """A new generation: the base's shards without `deletes` and those that `upserts` (facts with a
        shard_key) replaces. Refuses stale bases, unknown deletes, unfit facts and dangling inputs."""
        return self.publish(self.stage(universe, base, upserts, deletes, producer, source_manifest, capabilities))

    def stage(self, universe: str, base: Generation | None, upserts: DataFrame, deletes: list[str] = (), producer: str = "factloom", source_manifest: str = "", capabilities: list[str] = ()) -> Generation:
        """The first half of a commit: validates and writes all but the generation's own file. No one
        sees a staged generation until `publish`, which a producer may hold back until it is ready."""
        self._fresh(universe, base)
        rounds = Rounds(self.spark, "commit")
        sequence = (base.sequence if base else 0) + 1
        attempt = f"{sequence}-{rounds.name}"
        self._store(f"{universe}/staged/{attempt}", {})
        columns = self.spark.createDataFrame([], "shard_key string, " + FACTS).columns
        upserts = rounds.put(upserts.select(*[c for c in columns if c != "shard_digest"]))
        bad = violations(upserts).first()
        if bad:
            raise LedgerError(bad.code, str(bad.subject))
        old = self.manifest(base) if base else self.spark.createDataFrame([], MANIFEST)
        missing = sorted(set(deletes) - {r[0] for r in old.where(F.col("shard_key").isin(*deletes)).select("shard_key").collect()}) if deletes else []
        if missing:
            raise LedgerError("DELETE_UNKNOWN", ", ".join(missing))
        there = old.groupBy(F.col("shard_digest").alias("__d")).agg(F.min("attempt").alias("__a"))
        new = digests(upserts).withColumn("capabilities", F.array(*[F.lit(c) for c in sorted(set(capabilities))]).cast("array<string>"))
        new = rounds.put(new.join(there, F.col("shard_digest") == F.col("__d"), "left").withColumn("attempt", F.coalesce("__a", F.lit(attempt))).drop("__d", "__a"))
        kept = old.join(new.select("shard_key"), "shard_key", "left_anti")
        kept = kept.where(~F.col("shard_key").isin(*deletes)) if deletes else kept
        unchanged = new.where(F.col("attempt") != attempt).select("shard_digest")
        fresh = new.where(F.col("attempt") == attempt).select(F.col("shard_key").alias("__k"), F.col("shard_digest").alias("__d"))
        rows = upserts.join(fresh, F.col("shard_key") == F.col("__k")).withColumnRenamed("__d", "shard_digest").select(*columns, folder_of(F.col("shard_digest")).alias("folder"))
        rows.write.partitionBy("folder").parquet(f"{self.root}/{universe}/shards/attempt={attempt}")
        self._closed(universe, base, upserts, new, unchanged, kept, list(deletes))
        kept.unionByName(new).write.parquet(f"{self.root}/{universe}/manifests/{attempt}")
        manifest = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{universe}/manifests/{attempt}")
        digest = set_digest(manifest, F.col("shard_digest")).first()
        rounds.clean()
        return Generation(universe, sequence, "generation:" + (digest[0] if digest else hashlib.sha256(b"").hexdigest()), producer, source_manifest, tuple(sorted(set(capabilities))), attempt)

    def _fresh(self, universe: str, base: Generation | None) -> None:
        now = self._sequences(universe)
        if (now[-1] if now else None) != (base and base.sequence):
            raise LedgerError("BASE_STALE", f"current is {now[-1] if now else None}, base is {base and base.sequence}")

    def _closed(self, universe: str, base: Generation | None, upserts: DataFrame, new: DataFrame, unchanged: DataFrame, kept: DataFrame, deletes: list[str]) -> None:
        """Whether every input still has its fact: those of new facts, and those of kept facts that a
        fact taken away was for. Shards whose digest is that of the base are as sound as they were."""
        rounds, found, there = Rounds(self.spark, "closed"), None, None
        if base:
            there = self.shards(universe, kept).select("fact_id", "inputs")
        brought = upserts.join(unchanged.join(new, "shard_digest").select(F.col("shard_key").alias("__same")), F.col("shard_key") == F.col("__same"), "left_anti")
        # facts are looked up only where new ones name any, kept facts only where those lie beyond their own, or
        # where facts go
        loose, n = rounds.counted(brought.select("fact_id", F.explode("inputs").alias("input")))
        if n:
            loose, n = rounds.counted(_unmet(loose, upserts))
        if n:
            found = (loose.join(there.select(F.col("fact_id").alias("input")), "input", "left_anti") if base else loose).first()
        if base and not found:
            old, replaced = self.manifest(base), new.join(unchanged, "shard_digest", "left_anti").select("shard_key")
            gone = old.join(replaced, "shard_key", "left_semi").unionByName(old.where(F.col("shard_key").isin(*deletes)) if deletes else old.limit(0))
            lost = self.shards(universe, gone, self._folders(gone)).select("fact_id")
            lost, n = rounds.counted(lost.join(upserts.select("fact_id"), "fact_id", "left_anti"))
            if n:
                found = there.select("fact_id", F.explode("inputs").alias("input")).join(lost.select(F.col("fact_id").alias("input")), "input", "left_semi").first()
        rounds.clean()
        if found:
            raise LedgerError("INPUT_DANGLING", f"{found.fact_id} needs {found.input}")

    def publish(self, g: Generation) -> Generation:
        """The second half of a commit: makes a staged generation the current one, if its base still is."""
        mark = self._path(f"{self.root}/{g.universe}/staged/{g.attempt}")
        try:
            self._fresh(g.universe, self.generation(g.universe, g.sequence - 1) if g.sequence > 1 else None)
            if not self._store(f"{g.universe}/generations/{g.sequence}", {"id": g.id, "producer": g.producer, "source_manifest": g.source_manifest, "capabilities": list(g.capabilities), "attempt": g.attempt}):
                raise LedgerError("BASE_STALE", f"generation {g.sequence} was published by another writer")
        finally:
            self._fs.delete(mark, False)
        return g

    def rollover(self, old: str, new: str, facts: DataFrame, producer: str = "factloom", source_manifest: str = "", capabilities: list[str] = ()) -> Generation:
        """All facts as the next generation of universe `new`, which a changed configuration asks for in
        place of `old`: complete and without the old lineage. Where `new` has generations already, shards
        that the facts don't have are deleted from it; `old` stays as it is for its readers."""
        if old == new:
            raise LedgerError("UNIVERSE_SAME", f"{old} is no other universe")
        base = self.current(new)
        gone = []
        if base:
            held = self.manifest(base).select("shard_key").join(facts.select("shard_key").distinct(), "shard_key", "left_anti")
            gone = [r[0] for r in held.collect()]  # shard keys: names, one for each shard that goes
        return self.commit(new, base, facts, gone, producer, source_manifest, capabilities)

    def changes(self, old: Generation, new: Generation) -> DataFrame:
        return manifest_changes(self.manifest(old), self.manifest(new))

    # leases, retention, integrity -------------------------------------------------------------------

    def lease(self, g: Generation, seconds: float = 60.0, name: str | None = None) -> str:
        """Keeps a generation from retention until the lease ends; `name` renews a lease."""
        until = int((time.time() + seconds) * 1000)
        name = name or f"{g.sequence}-{time.time_ns()}"
        self._store(f"{g.universe}/leases/{name}.{until}", {"sequence": g.sequence})
        for other in self._lease_files(g.universe, name)[:-1]:
            self._fs.delete(self._path(f"{self.root}/{g.universe}/leases/{other}"), False)
        return name

    def renew(self, g: Generation, name: str, seconds: float = 60.0) -> str:
        """A lease that has ended can't be renewed: its generation may be gone."""
        if not self._lease_files(g.universe, name, time.time()):
            raise LedgerError("LEASE_ENDED", name)
        return self.lease(g, seconds, name)

    def _lease_files(self, universe: str, name: str | None = None, at: float | None = None) -> list[str]:
        """Files of leases, by when they end; of one name, or those that hold at a time."""
        files = sorted((n for n in self._names(f"{universe}/leases", "") if n.rsplit(".", 1)[-1].isdigit()), key=lambda n: int(n.rsplit(".", 1)[-1]))
        return [n for n in files if (name is None or n.rsplit(".", 1)[0] == name) and (at is None or int(n.rsplit(".", 1)[-1]) > at * 1000)]

    def release(self, universe: str, name: str) -> None:
        for n in self._lease_files(universe, name):
            self._fs.delete(self._path(f"{self.root}/{universe}/leases/{n}"), False)

    def _names(self, folder: str, no: str = ".") -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if not no or no not in n) if self._fs.exists(at) else []

    def retain(self, universe: str, top: int = 2) -> list[int]:
        """Drops generations beyond the newest `top` that no lease holds, with their manifests; returns
        them. Their shards go with `sweep`."""
        known = self._sequences(universe)[::-1]
        held = {int(n.split("-")[0]) for n in self._lease_files(universe, at=time.time())}
        out = [s for s in known[top:] if s not in held]
        for s in out:
            g = self.generation(universe, s)
            self._fs.delete(self._path(f"{self.root}/{universe}/generations/{s}"), False)
            self._fs.delete(self._path(f"{self.root}/{universe}/manifests/{g.attempt}"), True)
        return out

    def sweep(self, universe: str, grace: float = 24 * 3600.0) -> int:
        """Removes the facts of shards that no generation has, folder by folder; returns the number of
        folders that went or were written anew. Attempts that are staged and not older than `grace` seconds
        stay whole, and a commit takes over shards of its base alone, which a sweep spares as long as it can
        be published; so commits may run meanwhile."""
        rounds = Rounds(self.spark, "sweep")
        orphans = rounds.put(self.orphans(universe, grace).withColumn("folder", folder_of(F.col("shard_digest"))))
        found = orphans.select("attempt", "folder").distinct().collect()  # names of folders
        root = f"{self.root}/{universe}/shards"
        for attempt, name in found:
            at, side = f"{root}/attempt={attempt}/folder={name}", f"{self.root}/{universe}/swept/{attempt}-{name}-{time.time_ns()}"
            whole = self.spark.read.schema("shard_key string, " + FACTS).parquet(at)
            gone = orphans.where((F.col("attempt") == attempt) & (F.col("folder") == name)).select("shard_digest")
            rest = whole.join(gone, "shard_digest", "left_anti")
            if rest.isEmpty():
                self._fs.delete(self._path(at), True)
                continue
            rest.write.parquet(side)
            old = self._path(f"{side}-old")
            self._fs.rename(self._path(at), old)
            self._fs.rename(self._path(side), self._path(at))
            self._fs.delete(old, True)
        rounds.clean()
        return len(found)

    def _staged(self, universe: str, grace: float) -> list[str]:
        """Attempts that may still be published."""
        at = self._path(f"{self.root}/{universe}/staged")
        files = self._fs.listStatus(at) if self._fs.exists(at) else []
        return [s.getPath().getName() for s in files if s.getModificationTime() > (time.time() - grace) * 1000]

    def orphans(self, universe: str, grace: float = 0.0) -> DataFrame:
        """(attempt, shard_digest): shards that no generation has, nor an attempt staged within `grace` seconds."""
        shards = self.shards(universe).select("attempt", "shard_digest").distinct()
        staged = self._staged(universe, grace) if grace else []
        shards = shards.where(~F.col("attempt").isin(staged)) if staged else shards
        paths = [f"{self.root}/{universe}/manifests/{self.generation(universe, s).attempt}" for s in self._sequences(universe)]
        return shards.join(self.spark.read.schema(MANIFEST).parquet(*paths).select("attempt", "shard_digest"), ["attempt", "shard_digest"], "left_anti") if paths else shards

    def verify(self, g: Generation) -> DataFrame:
        """(shard_key, code): shards of a generation that are missing, or whose facts don't give their digest."""
        there = digests(self.facts(g)).select(F.col("shard_key").alias("__k"), F.col("shard_digest").alias("__d"))
        met = self.manifest(g).join(there, F.col("shard_key") == F.col("__k"), "left")
        code = F.when(F.col("__d").isNull() & (F.col("facts") > 0), "SHARD_MISSING").when(F.col("__d") != F.col("shard_digest"), "SHARD_DIGEST_INVALID")
        return met.select("shard_key", code.alias("code")).where("code IS NOT NULL")

    def quarantine(self, universe: str) -> list[int]:
        """Moves generations that don't verify out of the way; the newest good one is current then."""
        bad = [n for n in self._sequences(universe) if not self.verify(self.generation(universe, n)).isEmpty()]
        for n in bad:
            self._fs.mkdirs(self._path(f"{self.root}/{universe}/quarantine"))
            self._fs.rename(self._path(f"{self.root}/{universe}/generations/{n}"), self._path(f"{self.root}/{universe}/quarantine/{n}"))
        return bad


class MemoryLedger(Ledger):
    """The same ledger in a folder that ends with the session; for tests and advisory runs."""

    def __init__(self, spark: SparkSession) -> None:
        super().__init__(spark, Rounds(spark, "ledger").root)


def select_store(spark: SparkSession, root: str | None, policy: str = "required") -> tuple[Ledger, str | None]:
    """The durable ledger at `root`; where it can't be had, an advisory run gets one for the session
    and the reason, a required one fails."""
    try:
        if not root:
            raise LedgerError("STORE_UNCONFIGURED", "no root is given")
        ledger = Ledger(spark, root)
        ledger._fs.mkdirs(ledger._path(ledger.root))
        return ledger, None
    except Exception as e:
        if policy != "advisory":
            raise
        return MemoryLedger(spark), str(e)
