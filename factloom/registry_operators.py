"""More registered queries: one for each operator that the headline queries of `registry` don't go through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import classify, syntax
from factloom.functions.identity import canonical_path, path_in_scope, portable_path
from factloom.functions.text import encode_id, fuzzy, normalize_udf, package_name
from factloom.operators import body, completeness, conformance, contracts, diffs, facts, graph, impact, incremental, ledger, modules, ownership, search
from factloom.operators.facts import FactFilter
from factloom.plans import passes, policy
from factloom.registry import _PATH, _SEEDS, _page_paths, _seeds, _t, order_facts, query
from factloom.sources import documents, observations, repository
from factloom.sources.tables import Rounds
from factloom.streaming import changes

# --- facts --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS fact_id FROM orders WHERE o_custkey % 7 IN (0, 3) AND o_custkey % 5 = 1 AND o_orderstatus = 'F'")
def fact_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects and symbols both test the subject, so their lists intersect."""
    own = [str(i) for i in range(0, 40_000) if i % 7 in (0, 3)]
    both = FactFilter(namespaces=("F",), subjects=tuple(own[:500]), symbols=tuple(x for x in own[:500] if int(x) % 5 == 1))
    rows = order_facts(_t(spark, sf_dir, "orders"))
    # the lists are of remainders, so that they hold for any number of customers
    rows = rows.withColumn("subject", F.when((F.col("subject").cast("long") % 7).isin(0, 3) & (F.col("subject").cast("long") % 5 == 1), F.lit(both.symbols[0])).when((F.col("subject").cast("long") % 7).isin(0, 3), F.lit(own[0])).otherwise("none"))
    return facts.select(rows, both).select("fact_id")


@query("""
WITH f AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F') ORDER BY o_orderkey LIMIT 300)
SELECT o_orderkey AS fact_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 + 1 AS page, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'F')) AS total FROM f
""")
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages, each found by the cursor of the one before; a page's rows come to the driver by design."""
    rows, f, cursor, out = facts.headers(order_facts(_t(spark, sf_dir, "orders"))), FactFilter(namespaces=("O", "F")), None, []
    for n in range(1, 4):
        page = facts.page(rows, f, "generation", 100, cursor, total=True)
        out += [(r.fact_id, n, page.total) for r in page.rows]
        cursor = page.cursor
        if cursor is None:
            break
    return spark.createDataFrame(out, "fact_id long, page long, total long")


def _part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as facts: the brand is the namespace, the type the kind; each is made of its half and, of some, of one that isn't there."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    key = lambda c: F.concat(F.lit("part:"), c.cast("string"))
    inputs = F.array_compact(F.array(F.when(F.col("p_partkey") > 0, key(F.expr("p_partkey div 2"))), F.when(F.col("p_size") == 50, key(-F.col("p_partkey") - 1))))
    return p.select(
        key(F.col("p_partkey")).alias("fact_id"), F.col("p_brand").alias("namespace"), F.when(F.col("p_size") == 49, 2).otherwise(1).alias("schema_version"), F.col("p_type").alias("kind"), F.col("p_name").alias("subject"),
        F.struct(F.when(F.col("p_size") > 45, "partial").otherwise("complete").alias("kind")).alias("completeness"), inputs.alias("inputs"),
        F.when(F.col("p_size") == 48, F.lit("[1]")).when(F.col("p_size") == 47, F.lit('{"size":null}')).otherwise(F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name")))).alias("payload"), "p_size",
    )


@query("SELECT 'part:' || p_partkey AS fact_id, 'part:' || (-p_partkey - 1) AS input FROM part WHERE p_size = 50")
def dangling_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.dangling_inputs(_part_facts(spark, sf_dir))


@query(f"""
WITH RECURSIVE t AS (SELECT p_partkey AS dst, p_partkey // 2 AS src FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, -p_partkey - 1 FROM part WHERE p_size = 50), {_SEEDS},
c(node) AS (SELECT node FROM seed UNION SELECT t.dst FROM c JOIN t ON t.src = c.node)
SELECT 'part:' || node AS node FROM c
""")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was made, near or far, of some facts."""
    edges = ledger.lineage(_part_facts(spark, sf_dir))
    return graph.closure(edges, _seeds(spark, sf_dir).select(F.concat(F.lit("part:"), F.col("node").cast("string")).alias("node"))).select("node")


@query("""
SELECT o_orderkey AS fact_id, o_orderstatus AS namespace, 'base' AS origin FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, o_orderstatus, 'staged' FROM orders WHERE o_orderkey % 3 = 0
""")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_facts(_t(spark, sf_dir, "orders")).select("fact_id", "namespace")
    third = F.col("fact_id") % 3 == 0
    return facts.merged(rows.where(~third).withColumn("origin", F.lit("base")), rows.where(third).withColumn("origin", F.lit("staged")))


@query("SELECT 'part:' || p_partkey AS fact_id, p_size AS size, p_name AS name FROM part WHERE p_brand = 'Brand#1' AND p_size < 45")
def typed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = facts.Contract("Brand#1", "struct<size: int, name: string>", 1, ("size", "name"))
    sound = _part_facts(spark, sf_dir).where("p_size < 45")
    return facts.typed(sound, contract).select("fact_id", "payload.size", "payload.name")


@query("""
SELECT 'part:' || p_partkey AS fact_id, concat_ws(',', CASE WHEN p_brand <> 'Brand#1' THEN 'namespace:' || p_brand END, CASE WHEN p_size = 49 THEN 'schema-version:2' END,
  CASE WHEN p_size = 48 THEN 'payload' END, CASE WHEN p_size IN (47, 48) THEN 'field:size' END) AS faults
FROM part WHERE p_brand <> 'Brand#1' OR p_size BETWEEN 47 AND 49
""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.violations(_part_facts(spark, sf_dir), facts.Contract("Brand#1", "struct<size: int, name: string>", 1, ("size",)))
    return found.select("fact_id", F.array_join("faults", ",").alias("faults"))


@query("SELECT p_brand AS namespace, p_name AS subject, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def repeated_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.repeated(_part_facts(spark, sf_dir))


@query("SELECT p_brand AS namespace, p_name AS subject FROM part GROUP BY ALL HAVING count(*) = 1")
def one_fact_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_facts(spark, sf_dir)
    several = facts.repeated(rows).select("namespace", "subject")
    return facts.one_each(rows.join(several, ["namespace", "subject"], "left_anti")).select("namespace", "subject")


@query("""
WITH f AS (SELECT p_brand AS ns, p_type AS kind, CASE WHEN p_size > 45 THEN 'partial' ELSE 'complete' END AS level,
  CASE p_size WHEN 48 THEN 3 WHEN 47 THEN 13 ELSE strlen('{"size":' || p_size || ',"name":"' || p_name || '"}') END AS b FROM part)
SELECT dimension, key, count(*) AS facts, sum(b)::BIGINT AS bytes FROM (SELECT 'all' AS dimension, 'all' AS key, b FROM f UNION ALL SELECT 'namespace', ns, b FROM f UNION ALL SELECT 'kind', kind, b FROM f UNION ALL SELECT 'completeness', level, b FROM f) GROUP BY ALL
""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.corpus_summary(_part_facts(spark, sf_dir))


@query("""
SELECT 'part:' || p_partkey AS fact_id, p_brand AS namespace, p_type AS kind, CASE p_size WHEN 48 THEN 3 WHEN 47 THEN 13 ELSE strlen('{"size":' || p_size || ',"name":"' || p_name || '"}') END AS bytes
FROM part ORDER BY bytes DESC, fact_id LIMIT 20
""")
def largest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.largest_facts(_part_facts(spark, sf_dir))


# --- ledger -------------------------------------------------------------------------------------------


def _order_shards(spark: SparkSession, sf_dir: str, price: str = "o_totalprice") -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("shard-"), (F.col("o_custkey") % 8).cast("string")).alias("shard_key"), F.lit(None).cast("string").alias("shard_digest"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("fact_id"), F.lit("orders").alias("namespace"),
        F.lit(1).alias("schema_version"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").cast("string").alias("subject"),
        F.struct(F.lit("complete").alias("kind"), F.array().cast("array<struct<code:string,message:string>>").alias("reasons")).alias("completeness"), F.lit("load").alias("pass_id"), F.lit("1").alias("pass_version"),
        F.array(F.struct(F.lit("orders").alias("source"), F.lit("r").alias("revision"), F.lit(0).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("end"))).alias("evidence"), F.array().cast("array<string>").alias("inputs"), F.expr(price).cast("string").alias("payload"),
    )


@query("""
SELECT 'o:' || o_orderkey AS fact_id, 'shard-' || (o_custkey % 8) AS shard_key, o_custkey % 8 = 2 AS again FROM orders WHERE o_custkey % 8 <> 5
""")
def ledger_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a generation after a commit that replaces one shard and deletes another."""
    store = ledger.MemoryLedger(spark)
    first = store.commit("u", None, _order_shards(spark, sf_dir))
    second = store.commit("u", first, _order_shards(spark, sf_dir, "concat('again:', o_orderkey)").where("shard_key = 'shard-2'"), ["shard-5"])
    return store.facts(second).select("fact_id", "shard_key", F.col("payload").startswith("again:").alias("again"))


@query("SELECT 'shard-' || k AS shard_key, CASE WHEN k = 5 THEN 'delete' ELSE 'upsert' END AS change FROM (SELECT DISTINCT o_custkey % 8 AS k FROM orders WHERE o_custkey % 8 IN (2, 5))")
def ledger_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ledger.MemoryLedger(spark)
    first = store.commit("u", None, _order_shards(spark, sf_dir))
    second = store.commit("u", first, _order_shards(spark, sf_dir, "-o_orderkey").where("shard_key = 'shard-2'"), ["shard-5"])
    return store.changes(first, second)


@query("SELECT count(DISTINCT o_custkey % 8) FILTER (o_custkey % 8 = 2) AS orphans, 0::BIGINT AS left_over, 0::BIGINT AS faults FROM orders")
def ledger_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that no generation has once the first one is dropped, what is left of them after the sweep, and whether all digests still hold."""
    store = ledger.MemoryLedger(spark)
    first = store.commit("u", None, _order_shards(spark, sf_dir))
    second = store.commit("u", first, _order_shards(spark, sf_dir, "-o_orderkey").where("shard_key = 'shard-2'"))
    store.retain("u", 1)
    orphans = store.orphans("u").count()
    store.sweep("u")
    return spark.createDataFrame([(orphans, store.orphans("u").count(), store.verify(second).count())], "orphans long, left_over long, faults long")


@query("SELECT 'shard-' || (o_custkey % 8) AS shard_key, count(*) AS facts FROM orders GROUP BY ALL")
def ledger_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by content: the same digest, whatever the order and the partitions of the facts."""
    one, two = ledger.digests(_order_shards(spark, sf_dir)), ledger.digests(_order_shards(spark, sf_dir).orderBy(F.desc("fact_id")))
    return one.join(two.select("shard_key", "shard_digest"), ["shard_key", "shard_digest"], "left_semi").select("shard_key", "facts")


@query("""
SELECT 'FACT_ID_DUPLICATE' AS code, 'k' || (p_partkey // 2) AS subject FROM part GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'SHARD_NAMESPACE_MIXED', p_type FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) > 1
UNION ALL SELECT 'FACT_SPAN_INVALID', 'k' || (p_partkey // 2) FROM part WHERE p_size > 40 UNION ALL SELECT 'FACT_FIELD_MISSING', 'k' || (p_partkey // 2) FROM part WHERE p_size = 7
""")
def shard_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    rows = p.select(
        F.col("p_type").alias("shard_key"), F.concat(F.lit("k"), F.expr("p_partkey div 2").cast("string")).alias("fact_id"), F.col("p_brand").alias("namespace"), F.lit(1).alias("schema_version"), F.when(F.col("p_size") != 7, "k").alias("kind"),
        F.col("p_name").alias("subject"), F.array(F.struct((40 - F.col("p_size")).alias("start"), F.lit(50).alias("end"))).alias("evidence"),
    )
    return ledger.violations(rows)


@query("""
WITH c AS (SELECT o_custkey AS shard_key, count(*) AS d FROM orders GROUP BY 1), u AS (SELECT o_custkey AS shard_key, -count(*) AS d FROM orders WHERE o_totalprice > 100000 GROUP BY 1), g AS (SELECT DISTINCT o_custkey AS shard_key FROM orders WHERE o_custkey % 11 = 0)
SELECT shard_key::VARCHAR AS shard_key, d::VARCHAR AS shard_digest FROM c WHERE shard_key NOT IN (SELECT shard_key FROM u) AND shard_key NOT IN (SELECT shard_key FROM g) UNION ALL SELECT shard_key::VARCHAR, d::VARCHAR FROM u
""")
def reconstruct_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string").alias("shard_key")
    current = o.groupBy(key).agg(F.count("*").cast("string").alias("shard_digest"))
    upserts = o.where("o_totalprice > 100000").groupBy(key).agg((-F.count("*")).cast("string").alias("shard_digest"))
    return incremental.reconstruct(current, upserts, o.where("o_custkey % 11 = 0").select(key).distinct())


@query("SELECT o_custkey AS shard_key, o_orderstatus AS namespace FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def carried_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.carried(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shard_key"), F.col("o_orderstatus").alias("namespace")).distinct(), ["F"])


@query("SELECT p_partkey AS spec, CASE WHEN p_size % 2 = 0 THEN 'pass' ELSE 'fail' END AS status FROM part WHERE p_size % 5 <> 0 AND p_type <> 'PROMO'")
def reusable_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    previous = p.select(F.col("p_partkey").alias("spec"), F.col("p_name").alias("identity"), F.when(F.col("p_type") == "PROMO", "universe").otherwise("specification").alias("scope"), F.when(F.col("p_size") % 2 == 0, "pass").otherwise("fail").alias("status"))
    now = p.select(F.col("p_partkey").alias("spec"), F.when(F.col("p_size") % 5 == 0, "another").otherwise(F.col("p_name")).alias("identity"))
    return incremental.reusable(previous, now).select("spec", "status")


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_name END AS p_name FROM part")
def catalog_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return incremental.overlay(p.select("p_partkey", "p_name"), p.where("p_type = 'PROMO'").select("p_partkey", F.col("p_brand").alias("p_name")), "p_partkey", "p_name")


@query('SELECT path, "at" FROM (SELECT user_id AS path, event_id AS "at", row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3')
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.history(_t(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("at")), 3)


@query("""
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_id FROM r WHERE r <= 2 OR event_type = 'purchase'
""")
def retained_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two of each user, and those that something holds."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    held = e.where("event_type = 'purchase'").select("event_id")
    return ownership.retained(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 2, held).select("user_id", "event_id")


# --- repository ---------------------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id FROM p WHERE (regexp_full_match(path, 'en/[^/]*') OR regexp_full_match(path, '([^/]+/)*[^/]*1[^/]*')) AND NOT regexp_full_match(path, 'fr/.*') AND NOT regexp_full_match(path, '[^/][^/]/[1-3][^/]*')
""")
def glob_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(_t(spark, sf_dir, "pages")).where(path_in_scope(F.col("path"), ["en/*", "**/*1*"], ["fr/**", "??/[1-3]*"])).select("page_id")


_ODD = ["", "/", "./", "../", "x/../", "C:/", "a\\\\", "a//", "ok/"]


@query(f"""
WITH o(i, head) AS (VALUES {", ".join(f"({i}, '{h}')" for i, h in enumerate(h.replace(chr(92) * 2, chr(92)) for h in _ODD))}), p AS (SELECT page_id, head || {_PATH} AS path FROM pages JOIN o ON i = page_id % 9),
q AS (SELECT page_id, path, path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, chr(92)) AND NOT regexp_matches(path, '^[A-Za-z]:') AND NOT list_contains(string_split(path, '/'), '..') AS portable FROM p)
SELECT page_id, portable, portable AND NOT list_contains(string_split(path, '/'), '') AND NOT list_contains(string_split(path, '/'), '.') AS canonical FROM q
""")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.lit(h.replace("\\\\", "\\")) for h in _ODD])
    p = _page_paths(_t(spark, sf_dir, "pages")).withColumn("path", F.concat(F.get(heads, (F.col("page_id") % 9).cast("int")), "path"))
    return p.select("page_id", portable_path(F.col("path")).alias("portable"), canonical_path(F.col("path")).alias("canonical"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _page_paths(_t(spark, sf_dir, "pages")).withColumn("path", F.regexp_replace("path", "/+$", "")).where("path <> ''").groupBy("path").agg(F.min("page_id").alias("n"))
    ends = F.array(*[F.lit(e) for e in (".ts", ".md", "/legacy/a.go", ".png", "/.history/x.json", "/dist/y.css")])
    path = F.concat("path", F.get(ends, (F.col("n") % 6).cast("int")))
    return repository.inventory(p.select(path.alias("path"), F.col("n").alias("bytes"), F.sha2(F.col("n").cast("string"), 256).alias("digest"), F.when(F.col("n") % 6 == 3, "binary").otherwise("text").alias("content")).distinct())


_INVENTORY = f"""
g AS (SELECT regexp_replace({_PATH}, '/+$', '') AS path, min(page_id) AS n FROM pages GROUP BY 1),
f AS (SELECT DISTINCT path || ['.ts', '.md', '/legacy/a.go', '.png', '/.history/x.json', '/dist/y.css'][(n % 6)::INT + 1] AS path, n, sha256(n::VARCHAR) AS digest FROM g WHERE path <> ''),
i AS (SELECT path, n, digest, 'source:' || sha256('factloom.identity' || chr(0) || 'source' || chr(0) || 'local' || chr(0) || path) AS source,
  'source-revision:' || sha256('factloom.identity' || chr(0) || 'source-revision' || chr(0) || 'local' || chr(0) || path || chr(10) || digest) AS revision FROM f)
"""


@query(f"""
WITH {_INVENTORY}
SELECT path, source, revision, CASE n % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'markdown' WHEN 2 THEN 'go' WHEN 3 THEN 'image' WHEN 4 THEN 'json' ELSE 'unknown' END AS language,
  CASE WHEN n % 6 = 4 THEN 'historical' WHEN n % 6 = 2 THEN 'deprecated' ELSE 'active' END AS lifecycle, CASE WHEN n % 6 = 5 THEN 'generated' ELSE 'authored' END AS provenance,
  CASE n % 6 WHEN 1 THEN 'documentation' WHEN 5 THEN 'build' WHEN 0 THEN 'runtime' WHEN 2 THEN 'runtime' ELSE 'unknown' END AS delivery FROM i
""")
def repository_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select("path", "source", "revision", "language", "lifecycle", "provenance", "delivery")


@query(f"""
WITH {_INVENTORY}, q AS (SELECT path || CASE WHEN n % 10 = 9 THEN '.gone' ELSE '' END AS path, CASE n % 4 WHEN 0 THEN 'old' WHEN 1 THEN NULL ELSE revision END AS revision, n FROM i)
SELECT q.path, CASE WHEN n % 10 = 9 OR n % 6 = 3 OR n % 7 = 0 THEN 'unavailable' WHEN n % 4 = 0 OR n % 5 = 0 THEN 'stale' ELSE 'current' END AS status,
  CASE WHEN n % 10 = 9 THEN 'not-in-inventory' WHEN n % 6 = 3 THEN 'not-text' WHEN n % 7 = 0 THEN 'unreadable' END AS reason FROM q
""")
def pinned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inventory(spark, sf_dir)
    n = F.col("bytes")
    asked = rows.select(F.concat("path", F.when(n % 10 == 9, ".gone").otherwise("")).alias("path"), F.when(n % 4 == 0, "old").when(n % 4 == 1, None).otherwise(F.col("revision")).alias("revision"))
    bodies = rows.where("bytes % 7 <> 0").select("path", F.when(n % 5 == 0, F.lit("edited")).otherwise(n.cast("string")).cast("binary").alias("body"))
    return repository.pinned(asked, rows, bodies).select("path", "status", "reason")


@query(f"""
WITH {_INVENTORY}
SELECT path || CASE WHEN n % 3 = 0 THEN 'x' ELSE '' END AS path, CASE WHEN n % 3 = 0 THEN 'RESOURCE_MISSING' ELSE 'REVISION_MISMATCH' END AS code FROM i WHERE n % 3 = 0 OR n % 4 = 1
""")
def incoherent_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inventory(spark, sf_dir)
    resources = rows.select(F.concat("path", F.when(F.col("bytes") % 3 == 0, "x").otherwise("")).alias("path"), F.when(F.col("bytes") % 4 == 1, "old").otherwise(F.col("revision")).alias("revision"))
    return repository.coherence(resources, rows)


@query(f"WITH {_INVENTORY} SELECT source AS subject, 'fact:' || sha256('factloom.identity' || chr(0) || 'fact' || chr(0) || 'local' || chr(0) || 'file' || chr(10) || path) AS fact_id, revision, n AS stop FROM i")
def repository_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.get("evidence", F.lit(0))
    return repository.facts(_inventory(spark, sf_dir)).select("subject", "fact_id", e["revision"].alias("revision"), e["end"].alias("stop"))


@query(f"WITH {_INVENTORY} SELECT path FROM i WHERE n % 2 = 0 UNION SELECT path FROM i WHERE n % 3 = 0 UNION SELECT path || '.new' FROM i WHERE n % 5 = 0")
def change_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inventory(spark, sf_dir)
    return repository.changes(rows.where("bytes % 2 = 0"), rows.where("bytes % 3 = 0"), rows.where("bytes % 5 = 0").select(F.concat("path", F.lit(".new")).alias("path")))


@query(f"""
WITH {_INVENTORY}
SELECT path, CASE n % 6 WHEN 1 THEN 'markdown' WHEN 3 THEN 'image' WHEN 2 THEN 'binary' ELSE 'text' END AS presentation,
  CASE n % 6 WHEN 1 THEN 'text/markdown' WHEN 3 THEN 'image/png' WHEN 4 THEN 'application/json' WHEN 2 THEN 'application/octet-stream' ELSE 'text/plain' END AS media_type FROM i
""")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select("path", classify.presentation(F.col("path")).alias("presentation"), classify.media_type(F.col("path")).alias("media_type"))


@query(f"""
WITH {_INVENTORY}
SELECT path, CASE WHEN n % 6 = 2 THEN 'deprecated' WHEN n % 2 = 0 THEN 'historical' ELSE 'active' END AS lifecycle, CASE WHEN n % 6 = 5 THEN 'a,b' ELSE 'a' END AS evidence FROM i
""")
def merged_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classifiers: one of high priority that knows some paths only, and the path's own."""
    rows, p = _inventory(spark, sf_dir), F.col("path")
    n = F.col("bytes")
    first = {"lifecycle": F.when(n % 6 == 2, "unknown").when(n % 2 == 0, "historical").otherwise("unknown"), "purpose": F.lit("unknown"), "provenance": F.lit("unknown"), "delivery": F.lit("unknown")}
    merged = classify.merge([(1, "own", {axis: rung(p) for axis, rung in classify.AXES.items()}, F.array(F.lit("a"))), (9, "first", first, F.when(n % 6 == 5, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"))))])
    return rows.select("path", merged["lifecycle"].alias("lifecycle"), F.array_join(merged["evidence"], ",").alias("evidence"))


@query(f"""
WITH {_INVENTORY}, q AS (SELECT path, n, CASE WHEN n % 5 = 0 THEN 'other' ELSE digest END AS digest, revision FROM i)
SELECT path, CASE WHEN n % 7 = 0 THEN 'unavailable' WHEN n % 5 = 0 THEN 'stale' ELSE 'verified' END AS status FROM q
""")
def verified_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inventory(spark, sf_dir)
    asked = rows.select("path", F.when(F.col("bytes") % 5 == 0, "other").otherwise(F.col("digest")).alias("digest"), "revision")
    return modules.verify_text(asked, rows.where("bytes % 7 <> 0").select("path", "digest"))


@query(f"""
WITH {_INVENTORY}, s(spec, folder, root) AS (VALUES ('s1', 'en/.spec', 'en'), ('s2', '.spec', '.'), ('s3', 'es/3', 'es/3'), ('s4', 'fr/1', 'none'))
SELECT spec, count(path) AS history, coalesce(sum(n), 0)::BIGINT AS bytes FROM s LEFT JOIN i ON starts_with(path, CASE root WHEN '.' THEN '.history/' ELSE root || '/.history/' END) GROUP BY spec
""")
def module_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of modules' contexts, through the ledger."""
    specs = spark.createDataFrame([("s1", "en/.spec", "en"), ("s2", ".spec", "."), ("s3", "es/3", "es/3"), ("s4", "fr/1", "none")], "spec string, folder string, root string")
    seen = observations.context(specs, _inventory(spark, sf_dir))
    empty = specs.select("spec", F.lit("{}").alias("payload"))
    store = ledger.MemoryLedger(spark)
    g = observations.materialize(store, "observed", specs, {"layout": empty, "test": empty, "schema": empty, "context": seen}, "m1")
    found = store.facts(g).where("kind = 'module-context'")
    past = F.from_json("payload", "struct<history: array<struct<path: string, bytes: bigint>>>")["history"]
    return found.select(F.col("subject").alias("spec"), F.size(past).cast("long").alias("history"), F.aggregate(past, F.lit(0).cast("long"), lambda a, x: a + x["bytes"]).alias("bytes"))


# --- names and texts ----------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def search_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(normalize_udf("text"), 256).alias("digest"))


@query("""
WITH a AS (SELECT p_partkey, p_name AS t, strpos(p_name, 's') AS x FROM part), b AS (SELECT *, CASE WHEN x > 0 AND strpos(substr(t, x + 1), 'n') > 0 THEN x + strpos(substr(t, x + 1), 'n') ELSE 0 END AS y FROM a),
c AS (SELECT *, CASE WHEN y > 0 AND strpos(substr(t, y + 1), 'g') > 0 THEN y + strpos(substr(t, y + 1), 'g') ELSE 0 END AS z FROM b)
SELECT p_partkey, (CASE WHEN z = 0 THEN 0 ELSE 4 + CASE WHEN x = 1 OR substr(t, x - 1, 1) = ' ' THEN 8 ELSE 0 END
  + CASE WHEN y = x + 1 THEN 12 ELSE 4 END + CASE WHEN substr(t, y - 1, 1) = ' ' THEN 8 ELSE 0 END + CASE WHEN z = y + 1 THEN 12 ELSE 4 END + CASE WHEN substr(t, z - 1, 1) = ' ' THEN 8 ELSE 0 END - least(length(t) - 3, 80) END)::INT AS score FROM c
""")
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", fuzzy(F.lit("sng"), F.col("p_name")).alias("score"))


_SPECIFIERS = ["", "./", "../x/", "@s/", "@s/p/", "/", "node:"]


@query(f"""
WITH o(i, head) AS (VALUES {", ".join(f"({i}, '{h}')" for i, h in enumerate(_SPECIFIERS))}), p AS (SELECT page_id, head || {_PATH} AS s FROM pages JOIN o ON i = page_id % 7)
SELECT page_id, CASE WHEN s = '' OR starts_with(s, '.') OR starts_with(s, '/') THEN NULL WHEN starts_with(s, '@') THEN CASE WHEN contains(s, '/') THEN split_part(s, '/', 1) || '/' || split_part(s, '/', 2) END ELSE split_part(s, '/', 1) END AS package,
  replace(url_encode(s), '.', '%2E') AS encoded FROM p
""")
def specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.lit(h) for h in _SPECIFIERS])
    s = F.concat(F.get(heads, (F.col("page_id") % 7).cast("int")), "path")
    return _page_paths(_t(spark, sf_dir, "pages")).select("page_id", package_name(s).alias("package"), encode_id(s).alias("encoded"))


@query("""
WITH e AS (SELECT user_id, array_agg('p' || (event_id % 20) ORDER BY event_id DESC) AS a FROM events WHERE event_id % 3 = 0 GROUP BY user_id),
k AS (SELECT user_id, i, x, row_number() OVER (PARTITION BY user_id, x ORDER BY i) AS r FROM (SELECT user_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM e)),
m AS (SELECT user_id, x, i, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM k WHERE r = 1)
SELECT user_id, string_agg(x, ',' ORDER BY i) AS recent FROM m WHERE n <= 12 GROUP BY user_id
""")
def recent_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's bounded most-recent-first list, after all visits in order."""
    visits = _t(spark, sf_dir, "events").where("event_id % 3 = 0").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    names = F.transform("ids", lambda i: F.concat(F.lit("p"), (i % 20).cast("string")))
    return visits.select("user_id", F.array_join(F.aggregate(names, F.array().cast("array<string>"), lambda a, x: search.push_recent(a, x)), ",").alias("recent"))


@query("""
WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS a, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)
SELECT o_custkey, a = list_sort(list_distinct(a)) AS rising, NOT list_has_any(s, ['P']) AS apart FROM o
""")
def list_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("a"), F.collect_set("o_orderstatus").alias("s"))
    return each.select("o_custkey", modules.sorted_unique(F.col("a")).alias("rising"), modules.disjoint(F.col("s"), F.array(F.lit("P"))).alias("apart"))


# --- owners and bodies --------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 9 END, l_suppkey) AS k FROM lineitem) SELECT l_partkey, l_suppkey FROM r WHERE k = 1
""")
def canonical_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(9)
    return ownership.canonical(_t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey"], [rank, F.col("l_suppkey")]).select("l_partkey", "l_suppkey")


_ROOTS = [("english", "en"), ("seven", "en/7"), ("french", "fr"), ("es", "es/1"), ("deep", "fr/2/x")]


@query(f"""
WITH o(owner, root) AS (VALUES {", ".join(str(o) for o in _ROOTS)}), t AS (SELECT DISTINCT {_PATH} AS target FROM pages UNION SELECT unnest(['.', 'english', 'en', 'fr', 'fr/2', 'nowhere', 'es/1/x'])),
m AS (SELECT target, owner, 0 AS rung FROM t, o WHERE target = '.' UNION ALL SELECT target, owner, 1 FROM t JOIN o ON target = owner
  UNION ALL SELECT target, owner, 2 FROM t JOIN o ON root = target OR starts_with(root, target || '/')
  UNION ALL SELECT target, owner, 3 FROM (SELECT target, owner, rank() OVER (PARTITION BY target ORDER BY length(root) DESC) AS k FROM t JOIN o ON target = root OR starts_with(target, root || '/')) WHERE k = 1),
w AS (SELECT *, min(rung) OVER (PARTITION BY target) AS low FROM m)
SELECT DISTINCT target, owner FROM w WHERE rung = low
""")
def resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = spark.createDataFrame(_ROOTS, "owner string, root string")
    names = spark.createDataFrame([(x,) for x in (".", "english", "en", "fr", "fr/2", "nowhere", "es/1/x")], "target string")
    return ownership.resolve_targets(_page_paths(_t(spark, sf_dir, "pages")).select(F.col("path").alias("target")).unionByName(names), owners)


@query("""
WITH c AS (SELECT l_orderkey AS d, l_partkey % 7 = 0 AS exact, l_linenumber AS depth, length(l_shipmode) AS dir, l_suppkey AS owner FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'a/b' ELSE 'a' END AS l_shipmode FROM lineitem))
SELECT d AS declaration, arg_min(owner, (NOT exact, depth, -dir, owner)) AS owner FROM c GROUP BY d
""")
def declaration_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("declaration"), (F.col("l_partkey") % 7 == 0).alias("exact"), F.col("l_linenumber").alias("depth"), F.when(F.col("l_returnflag") == "A", "a/b").otherwise("a").alias("directory"), F.col("l_suppkey").alias("owner"))
    return conformance.declaration_owner(rows, ["declaration"])


@query("""
WITH c AS (SELECT event_id AS call, CASE WHEN event_type = 'signup' THEN 'build' ELSE 'f' || (event_id % 9) END AS target, 'f' || (user_id % 9) AS f FROM events),
b AS (SELECT event_id AS call, CASE WHEN event_type = 'purchase' THEN 'build' END AS argument_symbol, 'f' || (event_id % 11) AS parameter FROM events)
SELECT call, NULL::VARCHAR AS via FROM c WHERE target = 'build'
UNION ALL SELECT DISTINCT o.call, o.target FROM b JOIN c o ON o.call = b.call JOIN c i ON i.target = b.parameter AND i.f = o.target WHERE b.argument_symbol = 'build'
""")
def builder_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    name = lambda c, n: F.concat(F.lit("f"), (F.col(c) % n).cast("string"))
    calls = e.select(F.col("event_id").alias("call"), F.when(F.col("event_type") == "signup", "build").otherwise(name("event_id", 9)).alias("target"), name("user_id", 9).alias("function"))
    bindings = e.select(F.col("event_id").alias("call"), F.when(F.col("event_type") == "purchase", "build").alias("argument_symbol"), name("event_id", 11).alias("parameter"))
    return body.builder_calls(calls, bindings, "build")


@query("""
WITH o AS (SELECT event_id AS id FROM events WHERE event_id % 13 <> 0), b AS (SELECT user_id AS block, event_id AS occurrence FROM events WHERE event_id % 17 <> 0 UNION ALL SELECT user_id + 1, event_id FROM events WHERE event_id % 19 = 0 AND event_id % 17 <> 0),
e AS (SELECT user_id AS src, user_id + 1 AS dst FROM events), n AS (SELECT occurrence, count(*) AS n FROM b GROUP BY 1)
SELECT CASE WHEN n IS NULL THEN 'OCCURRENCE_UNPLACED' ELSE 'OCCURRENCE_REPEATED' END AS code, id::VARCHAR AS id FROM o LEFT JOIN n ON occurrence = id WHERE n IS NULL OR n > 1
UNION ALL SELECT 'OCCURRENCE_UNKNOWN', occurrence::VARCHAR FROM b WHERE occurrence NOT IN (SELECT id FROM o)
UNION ALL SELECT 'BLOCK_UNKNOWN', x::VARCHAR FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) WHERE x NOT IN (SELECT block FROM b)
""")
def body_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    one = e.where("event_id % 17 <> 0").select(F.col("user_id").alias("block"), F.col("event_id").alias("occurrence"))
    two = e.where("event_id % 19 = 0 AND event_id % 17 <> 0").select((F.col("user_id") + 1).alias("block"), F.col("event_id").alias("occurrence"))
    return body.topology_errors(e.where("event_id % 13 <> 0").select(F.col("event_id").alias("id")), one.unionByName(two), e.select(F.col("user_id").alias("src"), (F.col("user_id") + 1).alias("dst")))


_NODES = ["CallExpression", "NewExpression", "StringLiteral", "NumericLiteral", "TrueKeyword", "ConditionalExpression", "BinaryExpression", "ImportSpecifier", "IfStatement", "Unheard"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _NODES])
    e = _t(spark, sf_dir, "events")
    fields = F.array(*[F.lit(x) for x in ("expression", "arguments", "left", "thenStatement", "none")])
    return e.select("event_id", F.get(kinds, (F.col("event_id") % 10).cast("int")).alias("kind"), F.when(F.col("event_id") % 3 == 0, "+=").otherwise("+").alias("operator"), F.get(fields, (F.col("user_id") % 5).cast("int")).alias("field"), (F.col("event_id") % 4).alias("place"), F.concat(F.lit("1"), (F.col("user_id") % 3).cast("string"), F.when(F.col("event_id") % 20 == 3, "x").otherwise("")).alias("text"))


@query("""
WITH n AS (SELECT event_id, event_id % 10 AS k, event_id % 3 = 0 AS a, user_id % 5 AS f, event_id % 4 AS p FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'call' WHEN 1 THEN 'construction' WHEN 7 THEN 'import' END AS occurrence,
  CASE WHEN k = 0 THEN 'call' WHEN k IN (2, 3, 4) THEN 'expression' WHEN k IN (5, 8) THEN 'branch' WHEN k = 6 THEN CASE WHEN a THEN 'assignment' ELSE 'expression' END END AS body,
  CASE WHEN k = 0 AND f = 0 THEN 'callee' WHEN k = 0 AND f = 1 THEN 'argument:' || p WHEN k = 6 AND f = 2 THEN 'left' WHEN k = 8 AND f = 0 THEN 'condition' WHEN k = 8 AND f = 3 THEN 'then' ELSE 'child:' || (p + 1) END AS role FROM n
""")
def syntax_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kind")
    return _nodes(spark, sf_dir).select("event_id", syntax.occurrence_kind(k).alias("occurrence"), syntax.body_kind(k, F.col("operator")).alias("body"), syntax.child_role(k, F.col("field"), F.col("place"), F.col("place") + 1).alias("role"))


@query("""
WITH n AS (SELECT event_id, user_id, event_id % 10 AS k, '1' || (user_id % 3) || CASE WHEN event_id % 20 = 3 THEN 'x' ELSE '' END AS t FROM events),
v AS (SELECT event_id, user_id, CASE WHEN k IN (2, 4) OR (k = 3 AND NOT contains(t, 'x')) THEN 'known' WHEN k IN (0, 1) THEN 'unsupported' ELSE 'unknown' END AS kind,
  CASE WHEN k = 2 THEN 's' || t WHEN k = 3 AND NOT contains(t, 'x') THEN 'n' || t WHEN k = 4 THEN 't' END AS value FROM n),
w AS (SELECT a.event_id, a.kind, a.kind = 'known' AND b.kind = 'known' AS two, a.value = b.value AS same FROM v a JOIN v b ON b.event_id = a.event_id + 10)
SELECT event_id, kind, CASE WHEN two AND same THEN 'known' WHEN two THEN 'ambiguous' ELSE 'unknown' END AS conditional, CASE WHEN two AND same THEN 1 WHEN two THEN 2 ELSE 0 END AS n FROM w
""")
def literal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nodes fold to, and what a conditional of a node and the tenth after it does."""
    rows = _nodes(spark, sf_dir).select("event_id", syntax.literal(F.col("kind"), F.col("text")).alias("v"))
    met = rows.join(rows.select((F.col("event_id") - 10).alias("event_id"), F.col("v").alias("w")), "event_id")
    both = syntax.conditional(F.col("v"), F.col("w"))
    return met.select("event_id", F.col("v.kind").alias("kind"), both["kind"].alias("conditional"), F.size(both["values"]).alias("n"))


# --- conformance --------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT l_orderkey AS e, l_suppkey AS o, l_returnflag <> 'A' AS al FROM lineitem), m AS (SELECT e, min(al) AS al FROM c GROUP BY e)
SELECT c.e AS expected, min(c.o) AS observed FROM c JOIN m ON m.e = c.e AND m.al = c.al GROUP BY c.e HAVING count(DISTINCT c.o) = 1
""")
def seed_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.bind_seeds(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("expected"), F.col("l_suppkey").alias("observed"), (F.col("l_returnflag") != "A").alias("alias")))


@query("""
WITH t AS (SELECT user_id AS f, event_id % 50 AS i, min(CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'skip' ELSE 'todo' END) AS s FROM events GROUP BY ALL)
SELECT o_orderkey AS reference, CASE WHEN s = 'active' THEN 'pass' WHEN s IN ('skip', 'todo') THEN 'indeterminate' ELSE 'fail' END AS status FROM orders LEFT JOIN t ON f = o_custkey AND i = o_orderkey % 60
""")
def test_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "skip").otherwise("todo")
    tests = _t(spark, sf_dir, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 50).alias("id"), state.alias("state"))
    return conformance.evidence_of_tests(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 60).alias("id")), tests)


test_evidence.__test__ = False


@query("""
WITH a AS (SELECT user_id % 40 AS p, user_id AS f, event_id AS i FROM events WHERE event_type IN ('view', 'click'))
SELECT p AS package, count(*) AS n, count(DISTINCT f) AS files FROM a GROUP BY p
""")
def evidence_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _t(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("package"), F.col("user_id").alias("file"), F.col("event_id").alias("id"), F.when(F.col("event_type").isin("view", "click"), "active").otherwise("todo").alias("state"))
    return conformance.test_plan(tests.unionByName(tests)).select("package", "n", F.size("files").cast("long").alias("files"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity > 30)")
def inverse_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return conformance.inverse_closure(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), bound, "p_partkey")


@query("""
WITH r AS (SELECT l_orderkey AS o, CASE WHEN l_quantity > 45 THEN 1 WHEN l_quantity > 30 THEN 2 WHEN l_quantity > 20 THEN 3 ELSE 4 END AS k FROM lineitem WHERE l_discount > 0.05), w AS (SELECT o, min(k) AS k FROM r GROUP BY o)
SELECT o_orderkey AS obligation, CASE k WHEN 2 THEN 'fail' WHEN 3 THEN 'indeterminate' WHEN 4 THEN 'pass' ELSE 'error' END AS status, CASE WHEN k IS NULL THEN 'OBLIGATION_UNEVALUATED' END AS code FROM orders LEFT JOIN w ON o = o_orderkey
""")
def resolved_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    results = _t(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("obligation"), F.when(q > 45, "error").when(q > 30, "fail").when(q > 20, "idle").otherwise("pass").alias("status"))
    return conformance.resolve_obligations(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obligation")), results)


@query("""
WITH k(capability) AS (VALUES ('SMALL'), ('LARGE')), x(pattern) AS (VALUES ('small*'), ('*'), ('blue r*'))
SELECT 'CAPABILITY_UNKNOWN' AS code, p_type AS subject FROM part WHERE p_type NOT IN (SELECT capability FROM k)
UNION ALL SELECT DISTINCT 'PACKAGE_OVERLAP', p_name FROM part JOIN x ON starts_with(p_name, rtrim(pattern, '*'))
""")
def semantic_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    known = spark.createDataFrame([("SMALL",), ("LARGE",)], "capability string")
    return conformance.semantic_errors(p.select(F.col("p_type").alias("capability")), known, p.select(F.col("p_name").alias("package")), spark.createDataFrame([("small*",), ("*",), ("blue r*",)], "pattern string"))


@query("SELECT user_id, CASE max(list_position(['pass', 'indeterminate', 'fail', 'error'], s)) WHEN 1 THEN 'pass' WHEN 2 THEN 'indeterminate' WHEN 3 THEN 'fail' ELSE 'error' END AS status FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'pass' WHEN 'signup' THEN 'indeterminate' ELSE 'fail' END AS s FROM events) GROUP BY 1")
def qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("event_type").isin("view", "click"), "pass").when(F.col("event_type") == "signup", "indeterminate").otherwise("fail")
    return conformance.qualify(_t(spark, sf_dir, "events").select("user_id", s.alias("status")), ["user_id"])


@query("""
WITH r AS (SELECT event_id % 500 AS spec, ['specification', 'structure', 'surface', 'dependencies', 'layout', 'schema'][(user_id % 6)::INT + 1] AS p, CASE WHEN value > 60 THEN 3 WHEN value > 45 THEN 2 ELSE 1 END AS k FROM events),
o AS (SELECT spec, max(k) FILTER (p = 'specification') AS a, max(k) FILTER (p = 'structure') AS b, max(k) FILTER (p = 'surface') AS c, max(k) FILTER (p = 'dependencies') AS d, max(k) FILTER (p = 'layout') AS e, max(k) FILTER (p = 'schema') AS f FROM r GROUP BY spec),
n AS (SELECT spec, coalesce(a, 2) AS a, CASE WHEN coalesce(a, 2) <> 1 THEN 2 ELSE coalesce(b, 2) END AS b, c, d, e, f FROM o),
x AS (SELECT spec, 'specification' AS profile, a AS k, false AS blocked FROM n UNION ALL SELECT spec, 'structure', b, a <> 1 FROM n UNION ALL SELECT spec, 'surface', CASE WHEN b <> 1 THEN 2 ELSE coalesce(c, 2) END, b <> 1 FROM n
  UNION ALL SELECT spec, 'dependencies', CASE WHEN b <> 1 THEN 2 ELSE coalesce(d, 2) END, b <> 1 FROM n UNION ALL SELECT spec, 'layout', CASE WHEN a <> 1 THEN 2 ELSE coalesce(e, 2) END, a <> 1 FROM n
  UNION ALL SELECT spec, 'schema', CASE WHEN a <> 1 THEN 2 ELSE coalesce(f, 2) END, a <> 1 FROM n UNION ALL SELECT spec, 'test-evidence', 2, a <> 1 FROM n)
SELECT spec, profile, ['pass', 'indeterminate', 'fail'][k] AS status, blocked FROM x
""")
def profile_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(p) for p in ("specification", "structure", "surface", "dependencies", "layout", "schema")])
    status = F.when(F.col("value") > 60, "fail").when(F.col("value") > 45, "indeterminate").otherwise("pass")
    return policy.qualify(_t(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("spec"), F.get(names, (F.col("user_id") % 6).cast("int")).alias("profile"), status.alias("status")))


@query("""
WITH r AS (SELECT user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 3 ELSE 2 END AS k, event_id % 4 AS c FROM events), t AS (SELECT user_id, max(k) AS k FROM r GROUP BY 1),
m AS (SELECT r.user_id, 'C' || c || ':m' || (c % 2) AS x FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k WHERE r.k > 1)
SELECT t.user_id, CASE t.k WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' ELSE 'unavailable' END AS level, coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') AS reasons, count(x) AS given FROM t LEFT JOIN m ON m.user_id = t.user_id GROUP BY t.user_id, t.k
""")
def completeness_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst level with its reasons: each code and message once in order, and as many as were given where nothing is merged."""
    level = F.when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "error", "unavailable").otherwise("partial")
    code = F.col("event_id") % 4
    rows = _t(spark, sf_dir, "events").select("user_id", level.alias("level"), F.array(F.struct(F.concat(F.lit("C"), code.cast("string")).alias("code"), F.concat(F.lit("m"), (code % 2).cast("string")).alias("message"))).alias("reasons"))
    once = completeness.merge_reasons(rows, ["user_id"])
    each = completeness.fold(rows, ["user_id"], dedupe=False).select("user_id", F.size("reasons").cast("long").alias("given"))
    return once.join(each, "user_id").select("user_id", "level", F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["code"], r["message"])), ",").alias("reasons"), "given")


@query("""
WITH f AS (SELECT source AS ns, lang AS subject, CASE WHEN max(n_chars) > 15000 THEN 3 WHEN max(n_chars) > 5000 THEN 2 ELSE 1 END AS k FROM documents WHERE lang IN ('en', 'fr') GROUP BY ALL),
req AS (SELECT DISTINCT source AS c, l AS subject FROM documents, (SELECT unnest(['en', 'fr', 'es', 'xx']) AS l) WHERE source IS NOT NULL)
SELECT c AS capability, req.subject, CASE coalesce(k, 2) WHEN 1 THEN 'complete' WHEN 2 THEN 'partial' ELSE 'unavailable' END AS level FROM req LEFT JOIN f ON ns = c AND f.subject = req.subject
""")
def scoped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject's own evidence where it has any, the universe's elsewhere."""
    docs = _t(spark, sf_dir, "documents").where("source IS NOT NULL")
    own = docs.where("lang IN ('en', 'fr')").groupBy(F.col("source").alias("namespace"), F.col("lang").alias("subject")).agg(F.max("n_chars").alias("n"))
    own = own.select("namespace", "subject", F.when(F.col("n") > 15000, "unavailable").when(F.col("n") > 5000, "partial").otherwise("complete").alias("level"), F.array(F.lit("long")).alias("reasons"))
    wide = docs.select(F.col("source").alias("capability")).distinct().select("capability", F.lit("partial").alias("level"), F.array(F.lit("wide")).alias("reasons"))
    asked = wide.select(F.lit("r").alias("rule"), "capability", F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "es", "xx")])).alias("subject"))
    return completeness.scoped_evidence(asked, wide, own).select("capability", "subject", "level")


def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as declarations of their brand's module: the type is the kind, the size says what each has."""
    p, n = _t(spark, sf_dir, "part"), F.col("p_size")
    names = lambda c, how: F.when(how, F.array(F.lit(f"{c}1"), F.lit(f"{c}.2")))
    kind = F.when(n % 4 == 0, "class").when(n % 4 == 1, "interface").when(n % 4 == 2, "value").otherwise("callable")
    parts = {
        "type_parameters": names("T", n % 3 == 0), "call_type_parameters": names("U", n % 7 == 0), "facet_type_parameters": names("V", n % 2 == 0), "fields": names("f", n % 5 == 0), "properties": names("p", n % 5 == 1), "callables": names("c", n % 5 == 2),
        "statics": names("s", n % 5 == 3), "overloads": names("o", n % 6 == 0), "parameters": names("a", n % 6 == 1), "errors": names("e", n % 6 == 2), "extends": names("x", n % 6 == 3), "implements": names("i", n % 6 == 4),
    }
    return p.select(
        F.col("p_brand").alias("module"), kind.alias("kind"), F.col("p_name").alias("name"), F.concat_ws("#", "p_brand", F.col("p_partkey").cast("string")).alias("key"), *[c.alias(k) for k, c in parts.items()],
        (n % 2 == 1).alias("value_type"), (n % 3 == 1).alias("returns"), F.when(n % 9 == 0, "async").alias("mode"), (n % 10 == 0).alias("facets"), (n % 20 == 0).alias("facet_value_type"), (n % 30 == 0).alias("facet_type_value"),
    )


@query("""
WITH d AS (SELECT p_brand AS module, p_size AS n, CASE p_size % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'value' ELSE 'callable' END AS kind, p_partkey FROM part),
o AS (SELECT module, n, kind, 'module.' || kind || '.' || replace(url_encode(module || '#' || p_partkey), '.', '%2E') AS pre FROM d),
x AS (
  SELECT module, pre AS id, 'declaration' AS kind FROM o
  UNION ALL SELECT module, pre || '.type', 'value-type' FROM o WHERE n % 2 = 1 UNION ALL SELECT module, pre || '.return', 'return' FROM o WHERE n % 3 = 1 UNION ALL SELECT module, pre || '.mode', 'mode' FROM o WHERE n % 9 = 0
  UNION ALL SELECT module, pre || '.call-signature', 'member' FROM o WHERE kind IN ('class', 'interface') AND (n % 3 = 1 OR n % 6 = 0)
  UNION ALL SELECT module, pre || t, 'type-parameter' FROM o, (SELECT unnest(['.type-parameter.0', '.type-parameter.1']) AS t) WHERE n % 3 = 0
  UNION ALL SELECT module, pre || t, 'type-parameter' FROM o, (SELECT unnest(['.call-signature.type-parameter.0', '.call-signature.type-parameter.1']) AS t) WHERE n % 7 = 0
  UNION ALL SELECT module, pre || '.facet.type', 'type-facet' FROM o WHERE n % 10 = 0 UNION ALL SELECT module, pre || '.facet.value', 'value-facet' FROM o WHERE n % 10 = 0
  UNION ALL SELECT module, pre || '.facet.value.type', 'value-type' FROM o WHERE n % 20 = 0 UNION ALL SELECT module, pre || '.facet.type.value', 'value-type' FROM o WHERE n % 30 = 0
  UNION ALL SELECT module, pre || t, 'type-parameter' FROM o, (SELECT unnest(['.facet.type.type-parameter.0', '.facet.type.type-parameter.1']) AS t) WHERE n % 10 = 0
  UNION ALL SELECT module, pre || t, 'member' FROM o, (SELECT unnest(['1', '.2']) AS e, unnest([0, 1]) AS i), LATERAL (SELECT CASE n % 5 WHEN 0 THEN '.field.f' WHEN 1 THEN '.property.p' WHEN 2 THEN '.callable.c' ELSE '.static.s' END || e AS t) WHERE n % 5 <= 3
  UNION ALL SELECT module, pre || t, 'overload' FROM o, (SELECT unnest(['.overload.0', '.overload.1']) AS t) WHERE n % 6 = 0
  UNION ALL SELECT module, pre || t, 'parameter' FROM o, (SELECT unnest(['.parameter.0.a1', '.parameter.1.a.2']) AS t) WHERE n % 6 = 1
  UNION ALL SELECT module, pre || t, 'error-code' FROM o, (SELECT unnest(['.error.e1', '.error.e%2E2']) AS t) WHERE n % 6 = 2
  UNION ALL SELECT module, pre || t, 'heritage' FROM o, (SELECT unnest(['.extends.x1', '.extends.x%2E2']) AS t) WHERE n % 6 = 3
  UNION ALL SELECT module, pre || t, 'heritage' FROM o, (SELECT unnest(['.implements.i1', '.implements.i%2E2']) AS t) WHERE n % 6 = 4
  UNION ALL SELECT DISTINCT module, 'module.' || module, 'module' FROM o
  UNION ALL SELECT p_brand, 'module.export.' || replace(p_name, ' ', '.') || '.value', 'export' FROM part WHERE p_size > 40
  UNION ALL SELECT p_brand, 'module.import.type.' || replace(url_encode(p_name), '.', '%2E'), 'import' FROM part WHERE p_size < 5
  UNION ALL SELECT p_brand, 'module.package.' || p_type, 'package' FROM part WHERE p_size = 25
) SELECT * FROM x
""")
def contract_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    exports = p.where("p_size > 40").select(F.col("p_brand").alias("module"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("path"), F.lit("value").alias("kind"))
    imports = p.where("p_size < 5").select(F.col("p_brand").alias("module"), F.lit("type").alias("kind"), F.col("p_name").alias("key"))
    packages = p.where("p_size = 25").select(F.col("p_brand").alias("module"), F.col("p_type").alias("package"))
    return contracts.obligations(p.select(F.col("p_brand").alias("module")).distinct(), exports, _contract(spark, sf_dir), imports, packages)


@query("""
WITH e AS (SELECT p_partkey AS k, p_brand AS module, 'x.' || p_partkey AS path, p_size AS n FROM part WHERE p_size > 8),
o AS (SELECT p_partkey AS k, p_brand AS module, 'x.' || p_partkey || CASE WHEN p_size = 9 THEN '.in' ELSE '' END AS path, p_size AS n FROM part WHERE p_size <> 12),
m AS (SELECT e.module AS em, o.module AS om, coalesce(e.module, o.module) AS module, coalesce(e.path, o.path) AS path, e.path AS ep, o.path AS op, coalesce(e.n, o.n) AS n FROM e FULL JOIN o ON e.module = o.module AND e.path = o.path),
c AS (SELECT *, CASE WHEN ep IS NULL THEN 'MODULE_EXPORT_UNDECLARED' WHEN op IS NULL THEN 'MODULE_EXPORT_MISSING' WHEN n = 13 THEN 'MODULE_EXPORT_UNRESOLVED' WHEN n = 14 THEN 'MODULE_DECLARATION_IDENTITY_MISMATCH'
    WHEN n = 15 THEN NULL WHEN n = 16 THEN 'MODULE_FACTORY_FACETS_UNSPECIFIED' WHEN n = 17 THEN 'MODULE_FACTORY_FACETS_MISSING' WHEN n = 18 THEN 'MODULE_EXPORT_TYPE_MODE_MISMATCH' WHEN n = 19 THEN 'MODULE_EXPORT_KIND_MISMATCH' END AS code FROM m)
SELECT module, path, CASE WHEN code = 'MODULE_EXPORT_UNDECLARED' THEN 'observed.export.' || replace(url_encode(path), '.', '%2E') || '.value' ELSE 'module.export.' || path || '.value' END AS id,
  CASE WHEN code IS NULL THEN 'pass' WHEN code IN ('MODULE_EXPORT_UNRESOLVED', 'MODULE_FACTORY_FACETS_UNSPECIFIED') THEN 'error' ELSE 'fail' END AS status, code FROM c
UNION ALL SELECT module, path, 'observed.export.' || replace(url_encode(path), '.', '%2E') || CASE WHEN n = 20 THEN '.interface' ELSE '.value' END, 'pass', NULL FROM c WHERE code IS NULL
""")
def export_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports from both sides, with every rung of the ladder for some size of a part."""
    p, n = _t(spark, sf_dir, "part"), F.col("p_size")
    path = F.concat(F.lit("x."), F.col("p_partkey").cast("string"))
    module, own = F.col("p_brand").alias("module"), F.col("p_partkey").cast("string")
    expected = p.where("p_size > 8").select(
        module, path.alias("path"), F.lit("value").alias("kind"), F.col("p_name").alias("name"), F.lit(False).alias("type_only"), F.when(n.isin(14, 15), "other").alias("source"), (n == 15).alias("opaque"),
        (n == 17).alias("facets"), F.lit(False).alias("factory"), F.lit(True).alias("typed"), F.lit(False).alias("external"),
    )
    kind = F.when(n.isin(16,), "factory").when(n == 19, "class").when(n == 20, "interface").otherwise("value")
    observed = p.where("p_size <> 12").select(module, F.concat(path, F.when(n == 9, ".in").otherwise("")).alias("path"), F.when(n == 20, "interface").otherwise("value").alias("kind"), own.alias("declaration"), (n == 18).alias("type_only"), F.when(n == 15, "other").alias("source"))
    read = p.where("p_size <> 13").select(own.alias("declaration"), F.col("p_name").alias("name"), kind.alias("kind"))
    return contracts.exports(expected, observed, read)


@query("""
WITH e AS (SELECT l_orderkey || '-' || l_linenumber % 3 AS edge, l_suppkey % 5 AS m, CASE l_partkey % 6 WHEN 0 THEN 'platform:node' WHEN 1 THEN 'mod-' || (l_suppkey % 9) ELSE 'package:p' || (l_partkey % 6) END AS target,
  CASE WHEN l_returnflag = 'A' THEN 'src/tests/a.ts' ELSE 'src/a.ts' END AS file, l_quantity > 49 AS deep, l_discount > 0.09 AS provided FROM lineitem),
j AS (SELECT edge, m, CASE WHEN deep THEN 'MODULE_DEEP_IMPORT' WHEN target = 'platform:node' OR target IN ('mod-1', 'mod-3') THEN NULL
  WHEN starts_with(target, 'package:') THEN CASE WHEN target = 'package:p2' OR (target = 'package:p3' AND m < 2) OR (target = 'package:p4' AND contains(file, 'tests')) OR provided THEN NULL ELSE 'MODULE_PACKAGE_UNDECLARED' END
  ELSE 'MODULE_DEPENDENCY_UNOWNED' END AS code FROM e), w AS (SELECT m, edge, min(code) AS code FROM j GROUP BY ALL),
u AS (SELECT DISTINCT m, target FROM e)
SELECT 'mod-' || m AS module, 'observed.dependency.' || edge AS id, CASE WHEN code IS NULL THEN 'pass' ELSE 'fail' END AS status, code FROM w
UNION ALL SELECT 'mod-' || a.m, 'module.package.p2', CASE WHEN u.m IS NULL THEN 'fail' ELSE 'pass' END, CASE WHEN u.m IS NULL THEN 'MODULE_PACKAGE_STALE' END FROM (SELECT unnest(range(5)) AS m) a LEFT JOIN u ON u.m = a.m AND u.target = 'package:p2'
UNION ALL SELECT 'mod-' || m, 'module.package.q', 'fail', 'MODULE_PACKAGE_NOT_DECLARED' FROM (SELECT unnest(range(5)) AS m)
""")
def dependency_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _t(spark, sf_dir, "lineitem")
    mod = lambda c: F.concat(F.lit("mod-"), c.cast("string"))
    k = F.col("l_partkey") % 6
    edges = i.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") % 3).cast("string")).alias("edge"), mod(F.col("l_suppkey") % 5).alias("module"),
        F.when(k == 0, "platform:node").when(k == 1, mod(F.col("l_suppkey") % 9)).otherwise(F.concat(F.lit("package:p"), k.cast("string"))).alias("target"), F.when(F.col("l_returnflag") == "A", "src/tests/a.ts").otherwise("src/a.ts").alias("file"),
        (F.col("l_quantity") > 49).alias("deep"), (F.col("l_discount") > 0.09).alias("provided"),
    )
    five = spark.range(5).select(mod(F.col("id")).alias("module"), F.col("id").alias("m"))
    allowed = five.select("module", F.explode(F.array(F.lit("p2"), F.lit("q"))).alias("package")).withColumn("observed", F.lit(True))
    installed = five.select("module", F.explode(F.array(F.struct(F.lit("p2").alias("package"), F.lit(False).alias("workspace"), F.lit(False).alias("development")), F.struct(F.lit("p4").alias("package"), F.lit(False).alias("workspace"), F.lit(True).alias("development")))).alias("x")).select("module", "x.*")
    patterns = five.where("m < 2").select("module", F.lit("p3*").alias("pattern"))
    return contracts.dependencies(allowed, patterns, installed, edges, spark.createDataFrame([("mod-1",), ("mod-3",)], "module string"))


@query("""
WITH d AS (SELECT p_brand AS m, p_partkey AS k, p_size AS n FROM part)
SELECT m AS module, 'module.class.' || k AS id, CASE WHEN n % 3 = 0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN n % 3 <> 0 THEN 'MODULE_DECLARATION_MISSING' END AS code FROM d WHERE n % 2 = 0
UNION ALL SELECT m, 'observed.declaration.d' || k, CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN NOT (n % 3 = 0 AND n % 2 = 0) THEN 'MODULE_PUBLIC_TYPE_UNDECLARED' END FROM d WHERE n % 5 <> 0
UNION ALL SELECT m, 'module.class.' || k || '.error.E' || (n % 7), CASE WHEN n % 7 = 3 THEN 'pass' ELSE 'fail' END, CASE WHEN n % 7 <> 3 THEN 'ERROR_CODE_MISSING' END FROM d WHERE n % 11 = 0
UNION ALL SELECT m, 'module.import.type.' || k, CASE WHEN n % 4 = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN n % 4 <> 0 THEN 'MODULE_CONTRACT_IMPORT_STALE' END FROM d WHERE n % 13 = 0
UNION ALL SELECT m, 'observed.import.' || k, 'fail', 'MODULE_CONTRACT_IMPORT_UNDECLARED' FROM d WHERE n % 4 = 0 AND n % 13 <> 0 AND m <> 'Brand#1'
""")
def declaration_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations, error codes and imports, each from both sides."""
    d = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("module"), F.lit("class").alias("kind"), F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("declaration"), F.col("p_size").alias("n"))
    one = contracts.declarations(d.where("n % 2 = 0"), d.where("n % 5 <> 0"), d.where("n % 3 = 0 AND n % 2 = 0"))
    codes = d.where("n % 11 = 0").select("module", "kind", "key", F.concat(F.lit("E"), (F.col("n") % 7).cast("string")).alias("error"))
    two = contracts.error_codes(codes, d.select("module").distinct().withColumn("error", F.lit("E3")))
    three = contracts.imports(d.where("n % 13 = 0").select("module", F.lit("type").alias("kind"), "key"), d.where("n % 4 = 0").select("module", "key"), d.select("key", F.lit("Brand#1").alias("owner")))
    return one.unionByName(two).unionByName(three)


# --- impact -------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE s AS (SELECT s_suppkey AS o, 'm' || (s_suppkey % 40) || '/' || s_suppkey AS root FROM supplier), own AS (
  SELECT 'm' || (o % 40) || '/' || o || '/.spec/api.d.ts' AS path, o FROM s UNION SELECT 'm' || (o % 40) || '/shared.ts', o FROM s WHERE o % 3 = 0 UNION SELECT root || '/t.test.ts', o FROM s WHERE o % 4 = 0),
u AS (SELECT o, 'm' || ((o + 1) % 40) || '/' || (o + 1) || '/.spec/api.d.ts' AS path FROM s WHERE o % 5 <> 0 UNION SELECT o, 'ext/' || (o % 3) || '.d.ts' FROM s WHERE o % 6 = 0),
dep AS (SELECT DISTINCT u.o AS src, own.o AS dst FROM u JOIN own ON own.path = u.path WHERE u.o <> own.o),
ch(path, kind) AS (SELECT 'm' || (p_partkey % 45) || '/' || (p_partkey % 60) || CASE p_size % 4 WHEN 0 THEN '/.spec/api.d.ts' WHEN 1 THEN '/src/x.ts' WHEN 2 THEN '/t.test.ts' ELSE '/r.md' END, min(CASE WHEN p_size % 8 = 1 THEN 'add' ELSE 'change' END) FROM part WHERE p_size > 25 GROUP BY 1
  UNION ALL SELECT unnest(['ext/0.d.ts', 'ext/9.d.ts', 'package.json', 'm3/shared.ts', 'x/tsconfig.base.json', 'docs/new.md']), 'change'),
dir AS (SELECT ch.path, own.o FROM ch JOIN own ON own.path = ch.path UNION SELECT ch.path, u.o FROM ch JOIN u ON u.path = ch.path WHERE u.path NOT IN (SELECT path FROM own)
  UNION SELECT ch.path, s.o FROM ch JOIN s ON starts_with(ch.path, root || '/')),
c(path, o) AS (SELECT path, o FROM dir UNION SELECT c.path, dep.src FROM c JOIN dep ON dep.dst = c.o),
t AS (SELECT path, (kind = 'add' AND regexp_matches(path, '\\.ts$|(^|/)\\.spec/')) OR (path NOT IN (SELECT path FROM dir) AND regexp_matches(path, '\\.d\\.ts$|(^|/)package\\.json$|(^|/)tsconfig[^/]*\\.json$')) AS wide FROM ch)
SELECT t.path, CASE WHEN wide THEN s.o ELSE c.o END::VARCHAR AS owner, CASE WHEN wide THEN 'conservative-full' ELSE 'exact' END AS completeness FROM t LEFT JOIN s ON wide LEFT JOIN c ON NOT wide AND c.path = t.path
""")
def path_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is to be refreshed for changed paths, the whole corpus where the index can't tell."""
    o = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    root = lambda n: F.concat(F.lit("m"), text(n % 40), F.lit("/"), text(n))
    api = lambda n: F.concat(root(n), F.lit("/.spec/api.d.ts"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey")
    specs = s.select(api(o).alias("owner"), root(o).alias("root"), api(o).alias("authority"))
    shared = s.where("s_suppkey % 3 = 0").select(api(o).alias("owner"), F.lit("source").alias("family"), F.concat(F.lit("m"), text(o % 40), F.lit("/shared.ts")).alias("path"))
    tests = s.where("s_suppkey % 4 = 0").select(api(o).alias("owner"), F.lit("test").alias("family"), F.lit("x/../t.test.ts").alias("path"))
    uses = s.where("s_suppkey % 5 <> 0").select(api(o).alias("owner"), api(o + 1).alias("path")).unionByName(s.where("s_suppkey % 6 = 0").select(api(o).alias("owner"), F.concat(F.lit("ext/"), text(o % 3), F.lit(".d.ts")).alias("path")))
    k, n = F.col("p_partkey"), F.col("p_size")
    tail = F.when(n % 4 == 0, "/.spec/api.d.ts").when(n % 4 == 1, "/src/x.ts").when(n % 4 == 2, "/t.test.ts").otherwise("/r.md")
    path = F.concat(F.lit("m"), text(k % 45), F.lit("/"), text(k % 60), tail)
    changed = _t(spark, sf_dir, "part").where("p_size > 25").groupBy(path.alias("path")).agg(F.min(F.when(n % 8 == 1, "add").otherwise("change")).alias("kind"))
    more = spark.createDataFrame([(x, "change") for x in ("ext/0.d.ts", "ext/9.d.ts", "package.json", "m3/shared.ts", "x/tsconfig.base.json", "docs/new.md")], "path string, kind string")
    found = impact.impacts(changed.unionByName(more).withColumn("ambiguous", F.lit(False)), specs, shared.unionByName(tests), uses)
    return found.select("path", F.nullif(F.regexp_extract("owner", r"^m\d+/(\d+)/", 1), F.lit("")).alias("owner"), "completeness")


# --- documents, modules, plans ------------------------------------------------------------------------


@query("""
WITH d AS (SELECT p_partkey AS k, p_size AS n FROM part), ids AS (SELECT 'id-' || (k // 2) AS i, count(*) AS c FROM d WHERE n % 5 NOT IN (0, 1) GROUP BY 1)
SELECT k::VARCHAR AS path, CASE WHEN n % 5 IN (0, 1) THEN NULL ELSE 'id-' || (k // 2) END AS id,
  CASE WHEN n % 5 = 0 THEN 'SCHEMA_NOT_OBJECT' WHEN n % 5 = 1 THEN 'SCHEMA_ID_MISSING' WHEN c > 1 THEN 'SCHEMA_ID_DUPLICATE' WHEN n % 3 = 0 AND 'id-' || (k // 2 + 1) NOT IN (SELECT i FROM ids) THEN 'SCHEMA_REFERENCE_MISSING' END AS code
FROM d LEFT JOIN ids ON i = 'id-' || (k // 2)
""")
def schema_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.expr("p_partkey div 2")
    ref = F.when(n % 3 == 0, F.concat(F.lit(',"$ref":"id-'), (k + 1).cast("string"), F.lit('"'))).otherwise("")
    text = F.when(n % 5 == 0, "[]").when(n % 5 == 1, '{"x":1}').otherwise(F.concat(F.lit('{"$id":"id-'), k.cast("string"), F.lit('"'), ref, F.lit("}")))
    return documents.schema_catalog(_t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")))


@query("""
WITH d AS (SELECT doc_id, '# ' || doc_id || chr(10) || regexp_replace(text, '[#`~]', '', 'g') || chr(10) || '## end ##' || chr(10) AS text, strlen(text) AS n FROM documents)
SELECT doc_id::VARCHAR AS path, doc_id::VARCHAR AS title, 2 AS headings, NULL::VARCHAR AS code FROM d
""")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("text", "[#`~]", ""), F.lit("\n```\n# not one\n```\n## end ##\n"))
    made = documents.markdown(_t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), whole.alias("text")))
    return made.select("path", "title", F.size("headings").alias("headings"), "code")


@query("""
WITH f AS (SELECT event_id AS s FROM events WHERE event_id % 97 <> 5 UNION ALL SELECT event_id FROM events WHERE event_id % 89 = 0 AND event_id % 97 <> 5), n AS (SELECT s, count(*) AS c FROM f GROUP BY s)
SELECT 'FRAME_REPEATED' AS code, s AS sequence FROM n WHERE c > 1
UNION ALL SELECT 'FRAME_MISSING', min(s) + 0 FROM (SELECT s + 1 AS s FROM n WHERE s + 1 NOT IN (SELECT s FROM n)) WHERE s <= (SELECT max(s) FROM n) HAVING min(s) IS NOT NULL
""")
def frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as lines of JSON, written and read back, with gaps and repetitions."""
    e = _t(spark, sf_dir, "events").where("event_id % 97 <> 5")
    rows = e.select("event_id").unionByName(e.where("event_id % 89 = 0").select("event_id"))
    at = Rounds(spark, "frames").root
    rows.select(F.to_json(F.struct(F.col("event_id").alias("sequence"), F.lit("fact").alias("kind"), F.lit("b").alias("body")))).write.text(at)
    return documents.frame_errors(documents.frames(spark, at))


@query("""
SELECT relation, count(*) AS n FROM (
  SELECT 'node' AS relation FROM part UNION ALL SELECT 'edge' FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey
  UNION ALL SELECT 'metric' FROM part WHERE p_size > 10 UNION ALL SELECT 'syntax' FROM orders UNION ALL SELECT 'block' FROM part UNION ALL SELECT 'block_edge' FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
  UNION ALL SELECT 'vertex' FROM part UNION ALL SELECT 'flow' FROM orders UNION ALL SELECT 'file' FROM nation) GROUP BY relation
""")
def code_graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code graph's relations as canonical lines, counted; ids of rows don't occur in them."""
    part, key = _t(spark, sf_dir, "part"), F.col("p_partkey")
    node = part.select(key.alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.expr("p_partkey div 2 - 1").alias("parent_id"))
    orders = _t(spark, sf_dir, "orders")
    lines = documents.code_graph({
        "node": node, "edge": _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.lit("call").alias("edge_kind")),
        "metric": part.where("p_size > 10").select(key.alias("node_id"), F.col("p_size").alias("fan_in")), "syntax": orders.select(F.col("o_orderkey").alias("at"), F.col("o_custkey").alias("parent_id")),
        "block": part.select(key.alias("id"), key.alias("function_id"), F.lit(0).alias("block_index")), "block_edge": part.select(key.alias("function_id"), key.alias("source_block_id"), (key + 1).alias("target_block_id")),
        "vertex": part.select(key.alias("id"), key.alias("function_id"), F.lit(None).cast("long").alias("node_id"), F.lit("parameter").alias("kind"), F.col("p_name").alias("name"), F.lit(0).alias("param_index")),
        "flow": orders.select(F.col("o_custkey").alias("source_id"), F.lit(None).cast("long").alias("target_id"), F.col("o_custkey").alias("source_vertex_id"), F.lit(None).cast("long").alias("target_vertex_id")), "file": _t(spark, sf_dir, "nation").select(F.col("n_name").alias("file")),
    })
    return lines.groupBy("relation").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT n, path, kind FROM (SELECT p_partkey AS n, 'm' || p_partkey || '/.spec/' || ['api.d.ts', 'code.ts', 'laws', 'odd.txt', '.history/x', 'schemas/a'][(p_size % 6)::INT + 1] AS path, CASE WHEN p_size % 7 = 0 THEN 'link' WHEN p_size % 6 = 2 AND p_size % 4 <> 0 THEN 'directory' ELSE 'file' END AS kind FROM part))
SELECT path, CASE WHEN kind = 'link' THEN 'ENTRY_LINK' WHEN n6 NOT IN (0, 1, 2) THEN 'ENTRY_UNKNOWN' ELSE 'ENTRY_KIND' END AS code
FROM (SELECT e.*, p_size % 6 AS n6 FROM e JOIN part ON p_partkey = n) WHERE n6 <> 4 AND (kind = 'link' OR n6 NOT IN (0, 1, 2) OR (n6 = 2 AND kind <> 'directory'))
""")
def folder_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    tails = F.array(*[F.lit(x) for x in ("api.d.ts", "code.ts", "laws", "odd.txt", ".history/x", "schemas/a")])
    kind = F.when(n % 7 == 0, "link").when((n % 6 == 2) & (n % 4 != 0), "directory").otherwise("file")
    entries = _t(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/.spec/"), F.get(tails, (n % 6).cast("int"))).alias("path"), kind.alias("kind"))
    grammar = spark.createDataFrame([("api.d.ts", "file"), ("code.ts", "file"), ("laws", "directory")], "pattern string, kind string")
    return modules.grammar_errors(entries, grammar, [".history"])


@query("SELECT o_orderstatus AS namespace, count(*) AS facts, 'complete' AS completion FROM orders GROUP BY 1 UNION ALL SELECT 'derived', count(*), 'complete' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'broken', 0, 'unavailable'")
def pass_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mandatory pass over one namespace, and an optional one that fails only while Spark runs it."""
    base = order_facts(_t(spark, sf_dir, "orders")).select(F.col("fact_id").cast("string").alias("fact_id"), "namespace")
    derive = passes.Pass("derive", lambda s: s.read("F").select(F.concat(F.lit("d"), "fact_id").alias("fact_id"), F.lit("derived").alias("namespace")), (passes.Need("F"),), (("derived", 1),), provides=("c",))
    fails = passes.Pass("fails", lambda s: s.read("derived").select(F.raise_error(F.col("fact_id")).cast("string").alias("fact_id"), F.lit("broken").alias("namespace")), (passes.Need("derived"),), (("broken", 1),), provides=("d",), optional=True)
    out = passes.run(passes.plan([fails, derive], ["c", "d"], schemas={"F": 1}), base)
    counted = out.facts.groupBy("namespace").agg(F.count("*").alias("facts"))
    told = spark.createDataFrame(sorted(out.completion.items()), "namespace string, completion string")
    met = counted.join(told, "namespace", "full_outer")
    return met.select("namespace", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("completion", F.lit("complete")).alias("completion"))


@query("""
SELECT 'big' AS rule, CASE WHEN bool_or(o_totalprice > 1000000) THEN 'fail' ELSE 'pass' END AS status FROM orders
UNION ALL SELECT 'open', CASE WHEN bool_or(o_orderstatus = 'O') THEN 'fail' ELSE 'pass' END FROM orders UNION ALL SELECT 'scoped', 'indeterminate'
""")
def policy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rules(facts_: DataFrame) -> DataFrame:
        judged = facts_.agg(F.max(F.when(F.col("payload") > 1000000, "fail").otherwise("pass")).alias("big"), F.max(F.col("namespace") == "O").alias("open"))
        low = F.when(F.col("big") == "fail", "fail").otherwise("pass")
        return judged.select(F.explode(F.array(F.struct(F.lit("big").alias("rule"), low.alias("status")), F.struct(F.lit("open").alias("rule"), F.when(F.col("open"), "fail").otherwise("pass").alias("status")), F.struct(F.lit("scoped").alias("rule"), F.lit("pass").alias("status")))).alias("r")).select("r.*")

    own = policy.Policy("p", ("big", "open", "scoped"), rules, ("orders",), {"scoped": ("lines",)})
    found = policy.run(own, order_facts(_t(spark, sf_dir, "orders")).withColumn("payload", F.col("payload").cast("double")), {"orders": "complete"})
    return spark.createDataFrame(found, "rule string, status string")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream applied batch by batch to a table, each user's row replaced by what came last."""
    rounds = Rounds(spark, "batches")
    _t(spark, sf_dir, "events").select("user_id", "event_id").repartitionByRange(6, "event_id").write.parquet(f"{rounds.root}/in")
    held = [rounds.put(spark.createDataFrame([], "user_id long, event_id long"))]

    def apply(batch: DataFrame, _: int) -> None:
        both = batch.unionByName(held[0].join(batch.select("user_id").distinct(), "user_id", "left_semi"))
        new = both.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
        held[0] = rounds.put(changes.delta(held[0], new, batch.select("user_id").limit(0), "user_id"))

    stream = changes.events(spark, f"{rounds.root}/in", "user_id long, event_id long", 2)
    changes.apply_each(stream, apply, f"{rounds.root}/checkpoint").awaitTermination()
    return held[0]


_CASED = "CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) WHEN p_partkey % 3 = 1 THEN p_type ELSE upper(p_type[1:1]) || lower(p_type[2:]) END"


@query(f"SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower({_CASED}), p_partkey)::BIGINT AS place FROM part")
def collated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by a collation that takes letters of either case as one, over types in three spellings."""
    k, kind = F.col("p_partkey") % 3, F.col("p_type")
    cased = F.when(k == 0, F.lower(kind)).when(k == 1, kind).otherwise(F.initcap(kind))
    order = Window.partitionBy("p_brand").orderBy(F.collate(cased, "UNICODE_CI"), "p_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey", F.row_number().over(order).cast("long").alias("place"))


@query("""
WITH d AS (SELECT DISTINCT p_brand, p_size % 10 AS r FROM part WHERE p_partkey % 2 = 0), o AS (SELECT DISTINCT p_brand, p_size % 10 AS r FROM part WHERE (p_partkey % 2 = 0) = (p_brand IN ('Brand#1', 'Brand#2')))
SELECT p_brand, bool_and(d.r IS NOT NULL AND o.r IS NOT NULL) AS same FROM (SELECT * FROM d UNION SELECT * FROM o) LEFT JOIN d USING (p_brand, r) LEFT JOIN o USING (p_brand, r) GROUP BY 1
""")
def rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rules that a brand's even parts declare are those that its odd ones return; of two brands the even ones do."""
    p = _t(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 10).alias("r"), "p_partkey")
    even = F.col("p_partkey") % 2 == 0
    declared = p.where(even).select("p_brand", "r")
    returned = p.where(even == F.col("p_brand").isin("Brand#1", "Brand#2")).select("p_brand", "r")
    return diffs.equal_sets_by(declared, returned, ["p_brand"])
