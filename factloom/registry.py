"""Every registered query of the engine, with the DuckDB SQL of those that SQL can express.

Each query binds an operator to the shared tables: orders play facts, line items their evidence,
documents repository files, events changes and occurrences, parts and nations graphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import classify, lines
from factloom.functions.identity import derive_id
from factloom.functions.text import normalized, parse_query
from factloom.operators import body, completeness, conformance, diffs, facts, graph, incremental, modules, ownership, search, states, statistics
from factloom.operators.facts import FactFilter
from factloom.sources.tables import Rounds, partitions_for
from factloom.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- fact queries -----------------------------------------------------------------------------------


def order_facts(orders: DataFrame) -> DataFrame:
    """Orders as facts: status is the namespace, priority the kind, the customer the subject."""
    return orders.select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_orderstatus").alias("namespace"), F.col("o_orderpriority").alias("kind"),
        F.col("o_custkey").cast("string").alias("subject"), F.struct(F.lit("complete").alias("kind")).alias("completeness"), F.col("o_totalprice").alias("payload"),
    )


PAGE = FactFilter(namespaces=("O", "F"), kinds=("1-URGENT", "2-HIGH", "5-LOW"), completeness=("complete",))


@query("""
WITH found AS (SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))
SELECT o_orderkey AS fact_id, o_orderstatus AS namespace, o_orderpriority AS kind, o_custkey::VARCHAR AS subject, (SELECT count(*) FROM found) AS total
FROM found WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100
""")
def fact_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.select(order_facts(_t(spark, sf_dir, "orders")), PAGE)
    total = found.agg(F.count("*").alias("total"))
    return facts.after(facts.headers(found), 1000, 100).drop("completeness").join(F.broadcast(total))  # total is one row


@query("""
SELECT o_orderkey AS fact_id, o_orderstatus AS namespace, o_orderpriority AS kind, o_custkey::VARCHAR AS subject
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09)
""")
def fact_headers_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _t(spark, sf_dir, "lineitem").where("l_quantity >= 49 AND l_discount >= 0.09").select("l_orderkey")
    return facts.by_id(facts.headers(order_facts(_t(spark, sf_dir, "orders"))), ids).drop("completeness")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey IN (1, 2, 3, 5, 8))")
def source_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _t(spark, sf_dir, "lineitem").where(facts.any_of(F.col("l_suppkey"), [1, 2, 3, 5, 8]))
    return facts.with_evidence(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), evidence, "o_orderkey", "l_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name").join(used, "p_partkey", "left_anti")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::BIGINT AS ordinal, l_partkey, l_suppkey
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def nested_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nested = facts.nested_evidence(_t(spark, sf_dir, "orders").select("o_orderkey"), items.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber", ["l_partkey", "l_suppkey"])
    return nested.select("o_orderkey", F.posexplode("evidence").alias("p", "e")).select("o_orderkey", (F.col("p") + 1).cast("long").alias("ordinal"), "e.l_partkey", "e.l_suppkey")


@query("SELECT o_orderkey AS fact_id, o_orderstatus AS namespace, o_orderpriority AS kind, o_custkey::VARCHAR AS subject FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')")
def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.headers(facts.export(order_facts(_t(spark, sf_dir, "orders")), PAGE)).drop("completeness")


@query("""
SELECT o_orderkey, 'fact:' || sha256('factloom.identity' || chr(0) || 'fact' || chr(0) || 'orders' || chr(0) || o_orderkey::VARCHAR) AS id FROM orders
""")
def ids_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", derive_id("fact", "orders", F.col("o_orderkey").cast("string")).alias("id"))


# --- versions ---------------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT o_custkey, o_orderkey::VARCHAR || '|' || o_orderstatus AS line, o_orderdate FROM orders),
a AS (SELECT o_custkey, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM o WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
b AS (SELECT o_custkey, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM o WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.d IS DISTINCT FROM b.d
""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    parts = ["o_orderkey", "o_orderstatus"]
    old = diffs.digest_by(orders.where("o_orderdate < TIMESTAMP_NTZ '1997-01-01'"), "o_custkey", parts)
    new = diffs.digest_by(orders.where("o_orderdate >= TIMESTAMP_NTZ '1994-01-01'"), "o_custkey", parts)
    return diffs.diff(old, new, "o_custkey", "digest")


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS r FROM documents WHERE lang <> 'es'),
b AS (SELECT doc_id, sha256(replace(text, '!!', '')) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.r IS NULL THEN 'added' WHEN b.r IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.r IS DISTINCT FROM b.r
""")
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    gone = _t(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    old = docs.where("lang <> 'es'").select("doc_id", F.sha2("text", 256).alias("revision"))
    new = docs.join(gone, "doc_id", "left_anti").select("doc_id", F.sha2(F.replace("text", F.lit("!!"), F.lit("")), 256).alias("revision"))
    return diffs.diff(old, new, "doc_id", "revision")


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::BIGINT AS rn FROM events) WHERE rn <= 2")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = [F.desc("ts"), F.desc("event_id")]
    kept = ownership.latest(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], order, 2)
    return kept.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long").alias("rn"))


@query("SELECT d.doc_id, f.first FROM documents d JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1) f ON d.text = f.text WHERE d.doc_id <> f.first")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are met by digest, so that no text is shuffled
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return facts.duplicates(rows, ["digest"], "doc_id")


# --- statistics -------------------------------------------------------------------------------------


@query(r"""
WITH c AS (SELECT doc_id, text, regexp_matches(text, '[\r\n]$') AS ended FROM documents),
l AS (SELECT doc_id, ended, text, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM c WHERE text <> ''),
n AS (SELECT doc_id, count(*) AS k, count(*) FILTER (regexp_full_match(line, '\s*')) AS blank, any_value(ended) AS ended FROM l GROUP BY doc_id)
SELECT c.doc_id, coalesce(k - n.ended::INT, 0)::BIGINT AS physical, coalesce(blank - n.ended::INT, 0)::BIGINT AS blank, coalesce(k - blank, 0)::BIGINT AS unclassified FROM c LEFT JOIN n USING (doc_id)
""")
def repo_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "documents").select("doc_id", lines.text_metrics(F.col("text")).alias("m"))
    return m.select("doc_id", "m.physical", "m.blank", "m.unclassified")


@query("""
WITH long AS (
  SELECT 'language' AS dimension, coalesce(lang, 'unassigned') AS key, n_chars, doc_id FROM documents
  UNION ALL SELECT 'source', coalesce(source, 'unassigned'), n_chars, doc_id FROM documents
  UNION ALL SELECT 'length', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END, n_chars, doc_id FROM documents
)
SELECT dimension, key, count(*) AS files, sum(n_chars)::BIGINT AS bytes, round(avg(n_chars), 2) AS average, quantile_disc(n_chars, 0.5) AS median,
  quantile_disc(n_chars, 0.95) AS p95, arg_min(doc_id, (-n_chars, doc_id)) AS largest
FROM long GROUP BY ALL
""")
def repo_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    length = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return statistics.grouped(docs, {"language": F.col("lang"), "source": F.col("source"), "length": length}, statistics.summary("n_chars", "n_chars", "doc_id"))


@query("SELECT source, arg_min(doc_id, (-n_chars, doc_id)) AS largest FROM documents GROUP BY source")
def largest_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy("source").agg(statistics.largest("n_chars", None, "doc_id").alias("largest"))


@query("""
WITH lab AS (SELECT d.source, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' END AS a, CASE WHEN l.toxic = 1 THEN 'toxic' END AS b, d.n_chars FROM documents d JOIN labels l USING (doc_id)),
long AS (SELECT a AS key, n_chars FROM lab WHERE a IS NOT NULL UNION ALL SELECT b, n_chars FROM lab WHERE b IS NOT NULL)
SELECT 'label' AS dimension, key, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM long GROUP BY ALL
""")
def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_t(spark, sf_dir, "labels"), "doc_id")
    keys = F.array_compact(F.array(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "toxic")))
    return statistics.grouped_many(docs, "label", keys, [F.count("*").alias("files"), F.sum("n_chars").alias("bytes")])


@query()
def incremental_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    inventory = docs.select(F.col("doc_id").alias("source"), F.sha2("text", 256).alias("revision"), "text")
    columns = ["physical", "blank"]

    def analyze(rows: DataFrame) -> DataFrame:
        return rows.withColumn("physical", lines.physical_lines(F.col("text"))).withColumn("blank", lines.blank_lines(F.col("text")))

    # before: Spanish texts were missing, and those with !! had another revision
    before = inventory.where(docs["lang"] != "es").withColumn("revision", F.when(F.col("text").contains("!!"), F.lit("old")).otherwise(F.col("revision")))
    previous = Rounds(spark, "statistics").put(analyze(before).select("source", "revision", *columns).withColumn("analyzer", F.lit("text/1")).withColumn("level", F.lit("complete")))
    return statistics.refresh(previous, inventory, analyze, "text/1", columns).select(F.col("source").alias("doc_id"), *columns)


ORACLE_SQL["incremental_stats"] = "SELECT doc_id, physical, blank FROM (" + ORACLE_SQL["repo_line_stats"] + ")"

_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1)"


def _page_paths(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.expr(_PATH.replace("'^", "r'^")).alias("path"))


@query(f"""
WITH p AS (SELECT page_id, lower({_PATH}) AS path FROM pages)
SELECT page_id,
  CASE WHEN regexp_matches(path, '(^|/)\\.spec/') THEN 'specification' WHEN regexp_matches(path, '(^|/)(fixtures?|testdata)(/|$)') THEN 'fixture'
    WHEN regexp_matches(path, '(^|/)(__tests__|tests?)(/|$)') THEN 'test' WHEN regexp_matches(path, '\\.(js|go|rs|py|java|c|h)$') THEN 'implementation' ELSE 'unknown' END AS purpose,
  CASE WHEN regexp_matches(path, '(^|/)(node_modules|vendor|third_party)(/|$)') THEN 'vendored' WHEN regexp_matches(path, '(^|/)(dist|build|coverage|generated|\\.cache)(/|$)') THEN 'generated' ELSE 'authored' END AS provenance,
  CASE WHEN regexp_matches(path, '(^|/)(docs?|website)(/|$)|\\.mdx?$') THEN 'documentation' WHEN regexp_matches(path, '(^|/)(scripts?|build|dist)(/|$)') THEN 'build' ELSE 'unknown' END AS delivery,
  CASE WHEN strpos(path, '/') > 1 THEN split_part(path, '/', 1) END AS area,
  CASE WHEN regexp_matches(path, '[^/]\\.json$') THEN 'json' WHEN regexp_matches(path, '[^/]\\.mdx?$') THEN 'markdown' ELSE 'unknown' END AS language
FROM p
""")
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _page_paths(_t(spark, sf_dir, "pages")), F.col("path")
    return rows.select("page_id", classify.purpose(p).alias("purpose"), classify.provenance(p).alias("provenance"), classify.delivery(p).alias("delivery"), classify.area(p).alias("area"), classify.language(p, F.lit("text")).alias("language"))


_OWNERS = [("all", ""), ("english", "en"), ("french", "fr"), ("seven", "en/7"), ("spanish", "es"), ("index", "es/1")]


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages),
o(owner, root) AS (VALUES {", ".join(str(o) for o in _OWNERS)}),
m AS (SELECT page_id, path, owner, rank() OVER (PARTITION BY page_id ORDER BY length(root) DESC) AS r FROM p JOIN o ON root = '' OR path = root OR starts_with(path, root || '/'))
SELECT page_id, owner FROM m WHERE r = 1
""")
def deepest_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = spark.createDataFrame(_OWNERS, "owner string, root string")
    return ownership.deepest(_page_paths(_t(spark, sf_dir, "pages")), owners, keys=["page_id"]).select("page_id", "owner")


# --- completeness and statuses ----------------------------------------------------------------------


@query("""
WITH f AS (
  SELECT d.source AS ns, CASE WHEN l.doc_id IS NULL THEN 3 WHEN l.quality = 0 THEN 2 ELSE 1 END AS lv,
    CASE WHEN l.doc_id IS NULL THEN 'unlabelled:' || d.lang WHEN l.quality = 0 THEN 'poor:' || d.lang END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.source IS NOT NULL
), shard AS (
  SELECT source AS ns, lang, CASE WHEN max(n_chars) > 15000 THEN 2 ELSE 1 END AS lv FROM documents WHERE source IS NOT NULL GROUP BY ALL
), reach AS (SELECT DISTINCT ns, ns AS c FROM shard UNION SELECT DISTINCT ns, 'lang:' || lang FROM shard),
x AS (
  SELECT 'lang:' || lang AS c, 1 AS lv, NULL AS reason FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'idle', 1, NULL
  UNION ALL SELECT ns, lv, CASE lv WHEN 2 THEN 'long:' || lang END FROM shard UNION ALL SELECT 'lang:' || lang, lv, CASE lv WHEN 2 THEN 'long:' || lang END FROM shard
  UNION ALL SELECT r.c, f.lv, f.reason FROM f JOIN reach r ON r.ns = f.ns WHERE f.lv = (SELECT max(lv) FROM f g WHERE g.ns = f.ns)
), t AS (SELECT c, max(lv) AS top FROM x GROUP BY c)
SELECT x.c AS capability, CASE any_value(t.top) WHEN 3 THEN 'unavailable' WHEN 2 THEN 'partial' ELSE 'complete' END AS level,
  coalesce(string_agg(DISTINCT x.reason, ',' ORDER BY x.reason) FILTER (x.lv = t.top AND x.lv > 1), '') AS reasons FROM x JOIN t ON x.c = t.c GROUP BY x.c
""")
def capability_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").where("source IS NOT NULL")
    met = docs.join(_t(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("has")), "doc_id", "left")
    level = F.when(F.col("has").isNull(), "unavailable").when(F.col("quality") == 0, "partial").otherwise("complete")
    why = F.when(F.col("has").isNull(), F.concat(F.lit("unlabelled:"), "lang")).when(F.col("quality") == 0, F.concat(F.lit("poor:"), "lang"))
    found = met.select(F.col("source").alias("namespace"), level.alias("level"), F.array_compact(F.array(why)).alias("reasons"))
    long = F.max("n_chars") > 15000
    shards = docs.groupBy("source", "lang").agg(F.when(long, "partial").otherwise("complete").alias("level"), F.when(long, F.array(F.concat(F.lit("long:"), "lang"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    shards = shards.select(F.col("source").alias("namespace"), F.array(F.concat(F.lit("lang:"), "lang")).alias("capabilities"), "level", "reasons")
    seeds = _t(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.concat(F.lit("lang:"), "lang").alias("capability")).distinct().unionByName(spark.createDataFrame([("idle",)], "capability string"))
    return completeness.capability_rollup(seeds, shards, found).select("capability", "level", F.array_join("reasons", ",").alias("reasons"))


_STATUS = {"view": "pass", "click": "pass", "signup": "indeterminate", "purchase": "fail", "error": "error"}


def _event_status(events: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])
    return events.select("user_id", F.element_at(names, F.col("event_type")).alias("status"), "ts")


_HOURS = "WITH e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'pass' WHEN 'signup' THEN 'indeterminate' WHEN 'purchase' THEN 'fail' ELSE 'error' END AS status, date_trunc('day', ts) AS day FROM events)"


@query(_HOURS + """
SELECT user_id, day, CASE max(list_position(['pass', 'fail', 'indeterminate', 'error'], status)) WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' WHEN 3 THEN 'indeterminate' ELSE 'error' END AS policy,
  CASE max(list_position(['pass', 'indeterminate', 'fail', 'error'], status)) WHEN 1 THEN 'pass' WHEN 2 THEN 'indeterminate' WHEN 3 THEN 'fail' ELSE 'error' END AS conformance
FROM e GROUP BY ALL
""")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    rows = _event_status(_t(spark, sf_dir, "events")).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return rows.groupBy("user_id", "day").agg(completeness.status(s, completeness.POLICY).alias("policy"), completeness.status(s, completeness.CONFORMANCE).alias("conformance"))


@query("""
WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'idle' WHEN 'signup' THEN 'idle' WHEN 'purchase' THEN 'fail' ELSE 'error' END AS s FROM events)
SELECT user_id, day, CASE min(list_position(['error', 'fail', 'idle', 'pass'], s)) WHEN 1 THEN 'error' WHEN 2 THEN 'fail' WHEN 3 THEN 'indeterminate' ELSE 'pass' END AS status FROM e GROUP BY ALL
""")
def obligation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"view": "pass", "click": "idle", "signup": "idle", "purchase": "fail", "error": "error"}.items() for x in kv])
    rows = _t(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.element_at(names, F.col("event_type")).alias("s"))
    return rows.groupBy("user_id", "day").agg(completeness.obligation(F.col("s")).alias("status"))


@query("""
WITH e AS (SELECT user_id, (CASE WHEN event_type IN ('click', 'error') THEN 'observed.' ELSE '' END) || event_type AS rule, value > 20 AS ok FROM events)
SELECT user_id, count(*) FILTER (NOT starts_with(rule, 'observed.') AND ok) AS forward_matched, count(*) FILTER (NOT starts_with(rule, 'observed.')) AS forward_total,
  count(*) FILTER (starts_with(rule, 'observed.') AND ok) AS inverse_matched, count(*) FILTER (starts_with(rule, 'observed.')) AS inverse_total
FROM e GROUP BY user_id
""")
def coverage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.concat(F.when(F.col("event_type").isin("click", "error"), "observed.").otherwise(""), F.col("event_type"))
    rows = _t(spark, sf_dir, "events").select("user_id", rule.alias("rule"), F.when(F.col("value") > 20, "pass").otherwise("fail").alias("status"))
    return statistics.coverage(rows, ["user_id"])


@query("""
WITH w AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS target FROM lineitem)
SELECT l_orderkey, CASE count(target) WHEN 1 THEN 'pass' WHEN 0 THEN 'indeterminate' ELSE 'fail' END AS status FROM w GROUP BY l_orderkey
""")
def target_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("target")).distinct()
    return conformance.target_rule(rows, ["l_orderkey"])


@query("""
WITH f AS (SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 3 WHEN l.quality = 0 THEN 2 ELSE 1 END AS lv, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang <> 'en' OR l.doc_id IS NOT NULL),
r AS (SELECT source || ':' || lang AS capability, max(lv) AS lv, lang FROM f GROUP BY ALL), req(rule) AS (VALUES ('strict'), ('lax'), ('french'))
SELECT rule, capability, lv = 1 OR (lv = 2 AND (rule = 'lax' OR (rule = 'french' AND lang = 'fr'))) AS admitted, CASE lv WHEN 3 THEN 'unavailable' WHEN 2 THEN 'partial' ELSE 'complete' END AS level FROM req, r
""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    met = docs.join(_t(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("has")), "doc_id", "left").where("lang <> 'en' OR has")
    level = F.when(F.col("has").isNull(), "unavailable").when(F.col("quality") == 0, "partial").otherwise("complete")
    capability = F.concat("source", F.lit(":"), "lang")
    rollup = completeness.fold(met.select(capability.alias("capability"), level.alias("level"), F.array(F.concat(F.lit("poor-"), "lang")).alias("reasons")), ["capability"])
    rule = lambda name, minimum, accepted: F.struct(F.lit(name).alias("rule"), F.lit(minimum).alias("minimum"), accepted.cast("array<string>").alias("accepted"))
    rules = F.explode(F.array(rule("strict", "complete", F.lit(None)), rule("lax", "partial", F.lit(None)), rule("french", "partial", F.array(F.lit("poor-fr")))))
    required = rollup.select("capability", rules.alias("r")).select("capability", "r.*")
    return completeness.evidence_gate(required, rollup)


# --- graphs -----------------------------------------------------------------------------------------


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts depend on their half, and on the one their size further on: a graph with cycles."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    tree = part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    on = part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst")).join(part.select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    return tree.unionByName(on.select("src", "dst"))


_EDGES = """
e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0
  UNION ALL SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size)
"""
_SEEDS = "seed AS (SELECT p_partkey AS node FROM part WHERE p_size >= 49 AND p_type = 'PROMO')"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").where("p_size >= 49 AND p_type = 'PROMO'").select(F.col("p_partkey").alias("node"))


@query(f"""
WITH RECURSIVE {_EDGES}, {_SEEDS}, c(node) AS (SELECT node FROM seed UNION SELECT e.src FROM c JOIN e ON e.dst = c.node)
SELECT node, CASE WHEN node IN (SELECT node FROM seed) THEN 'direct' ELSE 'dependent' END AS relation FROM c
""")
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(_part_edges(spark, sf_dir), _seeds(spark, sf_dir))


_TREE = "t AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0)"


@query(f"""
WITH RECURSIVE {_TREE}, {_SEEDS}, s(node) AS (SELECT node FROM seed UNION SELECT t.src FROM s JOIN t ON t.dst = s.node),
c(node) AS (SELECT node FROM s UNION SELECT t.dst FROM c JOIN t ON t.src = c.node)
SELECT node, CASE WHEN node IN (SELECT node FROM s) THEN 'selected' ELSE 'support' END AS role FROM c
""")
def selection_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    tree = part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return graph.selection(tree, _seeds(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_TREE}, {_SEEDS}, c(node) AS (SELECT node FROM seed UNION SELECT t.dst FROM c JOIN t ON t.src = c.node)
SELECT p_partkey AS node, p_partkey IN (SELECT node FROM c) AS reachable FROM part
""")
def reachable_detached(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    tree = part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return graph.reachability(part.select(F.col("p_partkey").alias("node")), tree, _seeds(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_TREE}, {_SEEDS}, c(node, path) AS (SELECT node, node::VARCHAR FROM seed UNION ALL SELECT t.dst, c.path || '>' || t.dst::VARCHAR FROM c JOIN t ON t.src = c.node),
r AS (SELECT node, path, row_number() OVER (PARTITION BY node ORDER BY len(string_split(path, '>')), list_transform(string_split(path, '>'), lambda x: x::BIGINT)) AS k FROM c)
SELECT node, path FROM r WHERE k = 1
""")
def type_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    tree = part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    found = graph.paths(tree, _seeds(spark, sf_dir))
    return found.select("node", F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("path"))


@query("""
SELECT s.s_nationkey AS src, c.c_nationkey AS dst, count(DISTINCT l_orderkey) AS declarations, sum(l_linenumber)::BIGINT AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL
""")
def topology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    n = partitions_for(spark, items.count(), 500_000)
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    who = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst").repartition(n, "o_orderkey")
    # dealt by order, so that the join and the distinct orders of an edge need no other shuffle
    sold = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "src").repartition(n, "l_orderkey")
    edges = sold.join(who, F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.topology(edges, ["src", "dst"], "l_orderkey", "l_linenumber")


@query("SELECT l_suppkey, l_returnflag, count(DISTINCT l_partkey) AS n, min(l_partkey) AS first FROM lineitem GROUP BY ALL")
def dependency_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.dedupe_edges(_t(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_partkey")
    return edges.select("l_suppkey", "l_returnflag", "n", F.get("occurrences", F.lit(0)).alias("first"))


@query(f"""
WITH {_EDGES}, x AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e)
SELECT node, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound FROM x GROUP BY node
""")
def degree_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_part_edges(spark, sf_dir))


def _nation_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations point to the next of their region, the last to the first; Asia's chain stays open."""
    from pyspark.sql import Window

    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    following = F.coalesce(F.lead("n_nationkey").over(w), F.when(F.col("n_regionkey") != 2, F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))))
    return n.select(F.col("n_nationkey").alias("src"), following.alias("dst")).where("dst IS NOT NULL")


_RING = """
n AS (SELECT n_nationkey AS src, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), CASE WHEN n_regionkey <> 2 THEN min(n_nationkey) OVER (PARTITION BY n_regionkey) END) AS dst FROM nation),
r AS (SELECT src, dst FROM n WHERE dst IS NOT NULL)
"""


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey + p_size - 25 AS dst FROM part WHERE p_partkey + p_size - 25 IN (SELECT p_partkey FROM part)),
c(a, b) AS (SELECT src, dst FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b)
SELECT x.a AS node, min(x.b) AS cycle FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a
""")
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    edges = part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") - 25).alias("dst"))
    return graph.cycles(edges.join(part.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "dst"))


@query(f"""
WITH RECURSIVE {_RING}, c(a, b, k) AS (SELECT src, dst, 1 FROM r UNION ALL SELECT c.a, r.dst, k + 1 FROM c JOIN r ON r.src = c.b WHERE k < 40)
SELECT src AS node, (SELECT CASE WHEN max(k) < 40 THEN max_by(b, k) ELSE least(src, min(b)) END FROM c WHERE a = src) AS target FROM r
""")
def alias_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = _nation_ring(spark, sf_dir)
    return graph.follow(ring.select(F.col("src").alias("node"), F.col("dst").alias("target")))


@query(f"""
WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages), q AS (SELECT DISTINCT regexp_replace(path, '/+$', '') AS path FROM p WHERE path <> '' UNION SELECT split_part(path, '/', 1) FROM p WHERE path <> '')
SELECT a.path, max_by(b.path, length(b.path)) AS parent FROM q a LEFT JOIN q b ON starts_with(a.path, b.path || '/') GROUP BY a.path
""")
def module_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _page_paths(_t(spark, sf_dir, "pages")).where("path <> ''")
    nodes = p.select(F.regexp_replace("path", "/+$", "").alias("path")).unionByName(p.select(F.get(F.split("path", "/"), F.lit(0)).alias("path"))).distinct()
    return ownership.tree_parent(nodes)


# --- bodies -----------------------------------------------------------------------------------------


@query("""
WITH w AS (SELECT user_id, event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
ok(state, next) AS (VALUES ('view', 'click'), ('click', 'purchase'), ('view', 'signup'), ('signup', 'purchase'), ('click', 'view'))
SELECT w.state, w.next, count(*) AS n, bool_or(ok.state IS NOT NULL) AS legal FROM w LEFT JOIN ok ON ok.state = w.state AND ok.next = w.next WHERE w.next IS NOT NULL GROUP BY ALL
""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = states.transitions(spark, {"view": {"press": "click", "join": "signup"}, "click": {"buy": "purchase", "back": "view"}, "signup": {"buy": "purchase"}})
    return states.judged(states.observed(_t(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]), relation)


@query("""
WITH ok(state, event, next) AS (VALUES ('view', 'press', 'click'), ('view', 'join', 'signup'), ('click', 'buy', 'purchase'), ('click', 'back', 'view'), ('signup', 'buy', 'purchase'))
SELECT s.state, e.event FROM (SELECT state FROM ok UNION SELECT next FROM ok) s, (SELECT DISTINCT event FROM ok) e WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.state = s.state AND ok.event = e.event)
""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.illegal(states.transitions(spark, {"view": {"press": "click", "join": "signup"}, "click": {"buy": "purchase", "back": "view"}, "signup": {"buy": "purchase"}}))


def _occurrences(events: DataFrame) -> DataFrame:
    """A user's day is a function, the hour a symbol; signups define it, other events use it."""
    kind = F.when(F.col("event_type") == "signup", "definition").otherwise("use")
    return events.select(F.col("event_id").alias("id"), F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("function"), F.hour("ts").alias("symbol"), kind.alias("kind"))


_OCC = "o AS (SELECT event_id AS id, user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS function, hour(ts)::INT AS symbol, event_type = 'signup' AS def FROM events)"


@query(f"WITH {_OCC} SELECT d.function, d.symbol, d.id AS definition, u.id AS use FROM o d JOIN o u ON u.function = d.function AND u.symbol = d.symbol WHERE d.def AND NOT u.def")
def def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.def_use(_occurrences(_t(spark, sf_dir, "events")))


@query(f"WITH {_OCC} SELECT DISTINCT u.function, u.symbol FROM o u WHERE NOT u.def AND NOT EXISTS (SELECT 1 FROM o d WHERE d.def AND d.function = u.function AND d.symbol = u.symbol)")
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.captures(_occurrences(_t(spark, sf_dir, "events")))


@query("""
WITH s AS (SELECT o_custkey AS source, o_orderkey AS id, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS a FROM orders),
i AS (SELECT o_custkey AS source, l_orderkey * 8 + l_linenumber AS id, date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT i.id AS inner_id, min(s.id) AS outer_id FROM i JOIN s ON s.source = i.source AND s.a <= i.a AND i.a + 3 <= s.a + 180 GROUP BY i.id HAVING count(*) = 1
""")
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    day = lambda c: F.datediff(c, F.lit("1990-01-01"))
    outer = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), F.lit("1").alias("revision"), day("o_orderdate").alias("start"), (day("o_orderdate") + 180).alias("end"))
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    inner = items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("source"), F.lit("1").alias("revision"), day("l_shipdate").alias("start"), (day("l_shipdate") + 3).alias("end"))
    return body.contained(inner, outer)


@query("""
WITH c AS (SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), x AS (SELECT o_orderkey, unnest(a) AS argument, generate_subscripts(a, 1) - 1 AS i FROM c)
SELECT o_orderkey AS call, argument, ['first', 'second', 'rest'][(least(i, 2) + 1)::INT] AS parameter, i::INT AS index, i >= 2 AS rest FROM x
""")
def bind_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    calls = items.groupBy(F.col("l_orderkey").alias("call")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("arguments"))
    calls = calls.select("call", "arguments", F.array(F.lit("first"), F.lit("second"), F.lit("rest")).alias("parameters"), F.lit(True).alias("has_rest"))
    return body.bind_arguments(calls)


@query("""
WITH RECURSIVE o AS (SELECT p_partkey AS id, CASE WHEN p_size <= 10 THEN p_brand END AS v FROM part),
h AS (SELECT p_partkey AS id, p_partkey // 2 AS f FROM part WHERE p_partkey > 1 AND p_size > 10 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 1 AND p_size > 10),
w(id, loc, d, k) AS (SELECT id, id, 0, 1::BIGINT FROM o UNION ALL (SELECT w.id, h.f, d + 1, sum(k)::BIGINT FROM w JOIN h ON h.id = w.loc WHERE d <= 12 GROUP BY w.id, h.f, d)),
x AS (SELECT w.id, o.v, d, k, o.v IS NULL AND w.loc NOT IN (SELECT id FROM h) AS stuck FROM w JOIN o ON o.id = w.loc),
y AS (SELECT id, list(DISTINCT v ORDER BY v) FILTER (v IS NOT NULL AND d <= 12) AS vs, bool_or(stuck AND d <= 12) AS stuck, bool_or(d > 12) AS deep, sum(k) FILTER (d <= 12) > 2000 AS many FROM x GROUP BY id)
SELECT id, CASE WHEN stuck OR deep OR many THEN 'unknown' WHEN len(vs) = 1 THEN 'known' ELSE 'ambiguous' END AS kind,
  CASE WHEN stuck OR deep OR many THEN '' ELSE array_to_string(vs, ',') END AS "values",
  CASE WHEN deep THEN 'VALUE_DEPTH_LIMIT' WHEN stuck THEN 'VALUE_NO_SEMANTIC_PATH' WHEN many THEN 'VALUE_STEP_LIMIT' WHEN len(vs) > 1 THEN 'VALUE_ALTERNATIVES' END AS reason FROM y
""")
def value_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 10, F.col("p_brand")).alias("value"))
    hop = part.where("id > 1").select("id", F.explode(F.array(F.expr("id div 2"), F.expr("id div 3"))).alias("from"))
    return body.propagate(part, hop).select("id", "kind", F.array_join("values", ",").alias("values"), "reason")


# --- search, contracts, names -----------------------------------------------------------------------


@query("""
WITH i AS (SELECT p_partkey AS source, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS title,
  trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS path FROM part WHERE p_type IN ('SMALL', 'LARGE', 'PROMO')),
r AS (SELECT source, name, CASE WHEN name = 'small ring' OR title = 'small ring' THEN 5 WHEN starts_with(path, 'small ring') THEN 4
    WHEN (starts_with(path, 'small') OR contains(path, ' small')) AND (starts_with(path, 'ring') OR contains(path, ' ring')) THEN 4 END AS tier,
  CASE WHEN name = 'small ring' OR title = 'small ring' THEN 10000 - least(length(title), 200) WHEN starts_with(path, 'small ring') THEN 8000 - least(length(path), 400) ELSE 2 * (800 - least(length(path), 200)) END AS score FROM i)
SELECT source, name, tier, score::INT AS score FROM r WHERE tier IS NOT NULL ORDER BY tier DESC, score DESC, name, source LIMIT 40
""")
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    index = part.select(
        F.col("p_partkey").alias("source"), normalized(F.col("p_name")).alias("name"), normalized(F.col("p_brand")).alias("title"),
        normalized(F.concat_ws(" ", "p_type", "p_name")).alias("path"), F.lit("").alias("alias"), normalized(F.col("p_brand")).alias("family"), F.lower("p_type").alias("status"),
    )
    found = search.ranked(index, parse_query("small ring status:small status:large status:promo"))
    return search.top(found.where("tier >= 3")).select("source", "name", "tier", "score")


@query("""
WITH e AS (SELECT p_name AS key, max(p_brand) AS v FROM part WHERE p_size < 20 AND p_type <> 'PROMO' GROUP BY 1), o AS (SELECT p_name AS key, max(p_brand) AS v FROM part WHERE p_size >= 20 AND p_type <> 'SMALL' GROUP BY 1)
SELECT coalesce(e.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'missing' WHEN e.key IS NULL THEN 'undeclared' WHEN e.v = o.v THEN 'matched' ELSE 'mismatch' END AS code FROM e FULL JOIN o ON e.key = o.key
""")
def contract_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").withColumnRenamed("p_name", "key")
    expected = part.where("p_size < 20 AND p_type <> 'PROMO'").groupBy("key").agg(F.max("p_brand").alias("v"))
    observed = part.where("p_size >= 20 AND p_type <> 'SMALL'").groupBy("key").agg(F.max("p_brand").alias("v"))
    return conformance.compare(expected, observed, "key", "v")


@query(f"""
WITH p AS (SELECT DISTINCT regexp_replace({_PATH}, '/+$', '') AS path, starts_with(url, 'https') AS s FROM pages), x AS (SELECT path, bool_or(s) AS sec, bool_or(NOT s) AS plain FROM p WHERE path <> '' GROUP BY path),
f AS (SELECT path, CASE WHEN sec AND plain THEN 'matched' WHEN sec THEN 'missing' ELSE 'additional' END AS code FROM x)
SELECT f.path, CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.code = 'missing' AND starts_with(f.path, g.path || '/')) THEN 'suppressed' ELSE f.code END AS code FROM f
""")
def layout_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select(F.regexp_replace(F.expr(_PATH.replace("'^", "r'^")), "/+$", "").alias("path"), F.col("url").startswith("https").alias("secure")).where("path <> ''")
    side = lambda yes: pages.where(F.col("secure") == yes).select("path", F.lit("file").alias("kind")).distinct()
    return conformance.layout(side(True), side(False)).select("path", "code")


@query("""
WITH d(pattern, dev) AS (VALUES ('Brand#1', true), ('Brand#2*', false), ('Brand#7', false)), o AS (SELECT DISTINCT p_brand AS package, p_name AS file FROM part)
SELECT package, file, CASE WHEN count(pattern) = 0 THEN 'undeclared' WHEN bool_and(dev) THEN 'development-only' ELSE 'declared' END AS code
FROM o LEFT JOIN d ON package = pattern OR (ends_with(pattern, '*') AND starts_with(package, rtrim(pattern, '*'))) GROUP BY ALL
""")
def package_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("Brand#1", True), ("Brand#2*", False), ("Brand#7", False)], "package string, dev boolean")
    observed = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_name").alias("file")).distinct()
    return conformance.packages(observed, declared)


@query(r"""
WITH d AS (SELECT doc_id, text || ' ' || replace(text, ' ', '.') || ' ' || replace(text, ' ', '() ') || ' ' || replace(text, ' ', ' \') AS text FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^\\0-9A-Za-z_.])([A-Za-z_$][0-9A-Za-z_$]*(\.[A-Za-z_$][0-9A-Za-z_$]*)*(\(\))?)', 2)) AS mention FROM d),
t AS (SELECT DISTINCT doc_id, mention FROM m),
s AS (SELECT * FROM (VALUES ('idiot', 'a', true), ('clown', 'b', true), ('clown', 'c', false), ('trash', 'd', false), ('of', 'e', true), ('that', 'f', true), ('that', 'g', true)) v(name, symbol, callable)),
u AS (SELECT name, count(*) AS n, min(symbol) AS one, count(*) FILTER (callable) AS nc, min(symbol) FILTER (callable) AS onec FROM s GROUP BY name)
SELECT t.doc_id, t.mention, CASE WHEN ends_with(t.mention, '()') THEN onec ELSE one END AS symbol FROM t JOIN u ON u.name = replace(t.mention, '()', '')
WHERE CASE WHEN ends_with(t.mention, '()') THEN nc = 1 ELSE n = 1 END
""")
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in texts as they are, as dotted names, as calls, and behind backslashes, where they don't count."""
    symbols = spark.createDataFrame([("idiot", "a", True), ("clown", "b", True), ("clown", "c", False), ("trash", "d", False), ("of", "e", True), ("that", "f", True), ("that", "g", True)], "name string, symbol string, callable boolean")
    t, blank = F.col("text"), F.lit(" ")
    whole = F.concat_ws(" ", t, F.replace(t, blank, F.lit(".")), F.replace(t, blank, F.lit("() ")), F.replace(t, blank, F.lit(" \\")))
    return search.references(_t(spark, sf_dir, "documents").select("doc_id", whole.alias("text")), symbols, "doc_id", "text")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, sent twice, through a stream that drops the second."""
    source = _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    rounds = Rounds(spark, "stream")
    source.unionByName(source).write.parquet(f"{rounds.root}/in")
    stream = changes.deduplicated(changes.events(spark, f"{rounds.root}/in", source.schema.simpleString()[7:-1].replace(":", " ")), ["event_id"], "ts", None)
    once = stream.select("event_id", "user_id", "event_type").writeStream.format("parquet").option("path", f"{rounds.root}/out").option("checkpointLocation", f"{rounds.root}/checkpoint")
    once.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{rounds.root}/out")


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "ts")
    return changes.windowed(e, ["user_id"], "ts", "1 day").select("user_id", "start", "n")


@query("""
WITH w AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM w)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k
""")
def burst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "ts")
    return changes.bursts(e, "user_id", "ts", "6 hours").select("user_id", "start", "n")


# --- incremental views and modules ------------------------------------------------------------------


@query(f"""
WITH RECURSIVE {_TREE}, ch AS (SELECT p_partkey AS node, p_size % 2 = 0 AS public FROM part WHERE p_size >= 45 AND p_type = 'PROMO'),
c(node) AS (SELECT node FROM ch WHERE public UNION SELECT t.src FROM c JOIN t ON t.dst = c.node)
SELECT node AS source, 'changed' AS reason FROM ch UNION ALL SELECT node, 'importer' FROM c WHERE node NOT IN (SELECT node FROM ch)
""")
def affected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    tree = part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    # an even size stands for a change of the declared shape
    shapes = part.select(F.col("p_partkey").alias("source"), F.col("p_name").alias("before"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("after"))
    changed = part.where("p_size >= 45 AND p_type = 'PROMO'").select(F.col("p_partkey").alias("source"))
    return incremental.affected(shapes, tree, changed)


@query("""
WITH e AS (SELECT l_orderkey AS module, l_partkey::VARCHAR AS name, l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 25 AS fit FROM lineitem),
p AS (SELECT module, count(*) FILTER (fit) AS n, min(name) FILTER (fit) AS port FROM e GROUP BY module), s AS (SELECT port, count(*) AS same FROM p WHERE n = 1 GROUP BY port)
SELECT module, CASE WHEN n = 1 THEN p.port END AS port, CASE WHEN n = 0 THEN 'PORT_MISSING' WHEN n > 1 THEN 'PORT_AMBIGUOUS' WHEN same > 1 THEN 'PORT_NAME_REPEATED' END AS code FROM p LEFT JOIN s ON s.port = p.port AND n = 1
""")
def port_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "interface").otherwise("const")
    local = (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25)
    return modules.ports(items.select(F.col("l_orderkey").alias("module"), F.col("l_partkey").cast("string").alias("name"), kind.alias("kind"), local.alias("local")))


@query(f"""
WITH p AS (SELECT page_id AS spec, {_PATH} AS path FROM pages), r(root) AS (VALUES ('en'), ('fr'), ('en/7'), ('es/12')),
m AS (SELECT spec, count(root) AS n, min(root) AS root FROM p LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY spec)
SELECT spec, CASE WHEN n = 1 THEN root END AS root, CASE WHEN n = 0 THEN 'BOUNDARY_MISSING' WHEN n > 1 THEN 'BOUNDARY_AMBIGUOUS' END AS code FROM m
""")
def boundary_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("en",), ("fr",), ("en/7",), ("es/12",)], "root string")
    return modules.boundaries(_page_paths(_t(spark, sf_dir, "pages")).withColumnRenamed("page_id", "spec"), roots)


@query(f"""
WITH p AS (SELECT DISTINCT regexp_extract({_PATH}, '^(.*)/[^/]*$', 1) AS directory, regexp_extract({_PATH}, '([^/]*)$', 1) AS name FROM pages)
SELECT directory, sha256(string_agg(name, chr(10) ORDER BY name)) AS fingerprint FROM p GROUP BY directory
""")
def topology_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.topology_fingerprint(_page_paths(_t(spark, sf_dir, "pages")))


from factloom import registry_operators  # noqa: E402, F401  registers its queries
from factloom import registry_conformance, registry_views  # noqa: E402, F401
