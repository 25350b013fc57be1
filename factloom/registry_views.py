"""Registered queries of incremental views: bursts of a stream, Merkle trees, statistics by deltas, pruned
families and the search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import classify
from factloom.functions.identity import canonical_column
from factloom.functions.text import normalized, parse_query
from factloom.operators import body, conformance, deltas, graph, ledger, merkle, postings
from factloom.registry import _t, query
from factloom.registry_operators import _order_shards
from factloom.sources import checkpoints, families, transactions
from factloom.sources.tables import Rounds
from factloom.streaming import changes, watch

_EVENT = "CASE event_type WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END"


@query(f"""
WITH e AS (SELECT 'u' || (user_id % 20) AS g, 'p' || (event_id % 5) AS p, {_EVENT} AS ev, ts, event_id AS i, CASE WHEN event_type = 'error' THEN 'missing' ELSE (floor(value / 20)::BIGINT % 2)::VARCHAR END AS told FROM events),
n AS (SELECT * FROM (SELECT *, lag(told) OVER (PARTITION BY g, p ORDER BY ts, i) AS was FROM e) WHERE told IS DISTINCT FROM was),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY g ORDER BY ts, i) >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM n),
k AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY ts, i) AS k FROM s),
b AS (SELECT g, k, p, first(ev ORDER BY ts, i) AS a, last(ev ORDER BY ts, i) AS z, min(ts) AS lo, max(ts) AS hi FROM k GROUP BY g, k, p),
w AS (SELECT *, min(lo) OVER (PARTITION BY g, k) AS start, max(hi) OVER (PARTITION BY g, k) AS "end" FROM b)
SELECT g AS "group", start, "end", p AS path, CASE WHEN a <> 'add' THEN CASE WHEN z <> 'unlink' THEN 'change' ELSE 'unlink' END ELSE 'add' END AS event
FROM w WHERE NOT (a = 'add' AND z = 'unlink') AND (epoch_us("end") + 3600000000) // 1000 < (SELECT epoch_us(max(ts)) // 1000 FROM events)
""")
def watch_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as notifications of a watched tree, through the stream in the order of their times. What the
    stream's clock hasn't passed by its end is still waiting."""
    event = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    mark = F.floor(F.col("value") / 20) % 2
    rows = _t(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("group"), F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")).alias("path"),
        event.alias("event"), mark.cast("string").alias("fingerprint"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"),
    )
    rounds = Rounds(spark, "watch")
    part = F.floor(F.unix_seconds("ts") / (15 * 86400))
    for (k,) in rows.select(part.alias("k")).distinct().orderBy("k").collect():  # half months, one after the other
        rows.where(part == k).repartition(4).write.mode("append").parquet(f"{rounds.root}/in/{k}")
    found = None
    stream = changes.events(spark, f"{rounds.root}/in/*", watch.WATCHED, 4)
    out = watch.folded(stream, 3_600_000).writeStream.format("parquet").option("path", f"{rounds.root}/out").option("checkpointLocation", f"{rounds.root}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(watch.BURSTS).parquet(f"{rounds.root}/out")
    return found.select("group", "start", "end", "path", "event")


_FILE = "p_brand || '/' || p_type || '/' || replace(p_name, ' ', '/') || '-' || p_partkey"


def _part_files(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Parts as files; the new tree lacks some, has some more, and others are changed."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    path = F.concat_ws("/", "p_brand", "p_type", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("-"), k.cast("string")))
    said = F.concat(F.col("p_size").cast("string"), F.when((k % 9 == 0) & F.lit(new), "+").otherwise(""))
    return p.where(k % (8 if new else 10) != 0).select(path.alias("path"), F.sha2(said, 256).alias("digest"), F.col("p_size").cast("long").alias("bytes"))


@query(f"""
WITH o AS (SELECT {_FILE} AS path, p_size::VARCHAR AS said FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT {_FILE} AS path, p_size || CASE WHEN p_partkey % 9 = 0 THEN '+' ELSE '' END AS said FROM part WHERE p_partkey % 8 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'unlink' ELSE 'change' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.said IS DISTINCT FROM n.said
""")
def merkle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two trees, found by going down from the root where digests differ."""
    rounds = Rounds(spark, "trees")
    old, new = (merkle.saved(merkle.tree(_part_files(spark, sf_dir, n)), f"{rounds.root}/{n}") for n in (False, True))
    return merkle.differences(old, new)[0]


def _level(depth: int) -> str:
    """SQL of the directories one level above those of `depth`."""
    below = f"SELECT * FROM d{depth}" if depth < 4 else "SELECT path, parent, 'file' AS kind, digest, 1 AS files, bytes FROM leaves"
    parent = "CASE WHEN parent = '' THEN NULL WHEN strpos(parent, '/') = 0 THEN '' ELSE regexp_replace(parent, '/[^/]*$', '') END"
    return f"""d{depth - 1} AS (
  SELECT parent AS path, {parent} AS parent, 'directory' AS kind, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b || ':' || d)) AS digest, sum(files) AS files, sum(bytes) AS bytes FROM (
    SELECT parent, sha256(split_part(path, '/', -1))[1:2] AS b, sha256(string_agg(kind || ':' || split_part(path, '/', -1) || ':' || digest, chr(10) ORDER BY kind || ':' || split_part(path, '/', -1) || ':' || digest)) AS d, sum(files) AS files, sum(bytes) AS bytes
    FROM ({below}) GROUP BY 1, 2) GROUP BY parent)"""


@query(f"""
WITH leaves AS (SELECT {_FILE} AS path, regexp_replace({_FILE}, '/[^/]*$', '') AS parent, sha256(p_size::VARCHAR) AS digest, p_size AS bytes FROM part WHERE p_partkey % 10 <> 0),
{", ".join(_level(k) for k in (4, 3, 2, 1))}
SELECT path, digest, files::BIGINT AS files, bytes::BIGINT AS bytes FROM (SELECT * FROM d3 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d0)
""")
def merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory's digest, files and bytes."""
    return merkle.tree(_part_files(spark, sf_dir, False)).where("kind = 'directory'").select("path", "digest", "files", "bytes")


@query("""
WITH f AS (
  SELECT lang, source, n_chars AS v, strlen(text) AS b FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 1
  UNION ALL SELECT lang, source, n_chars * 2, strlen(text) FROM documents WHERE doc_id % 10 = 0),
g AS (SELECT 'language' AS dimension, coalesce(lang, 'unassigned') AS key, v, b FROM f UNION ALL SELECT 'package', coalesce(source, 'unassigned'), v, b FROM f UNION ALL SELECT 'all', 'all', v, b FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension, key ORDER BY v) AS i, count(*) OVER (PARTITION BY dimension, key) AS n FROM g)
SELECT dimension, key, count(*) AS files, sum(b)::BIGINT AS bytes, sum(v)::BIGINT AS total, round(avg(v), 2) AS average, max(v) FILTER (i = ceil(0.5 * n)) AS median, max(v) FILTER (i = ceil(0.95 * n)) AS p95 FROM r GROUP BY 1, 2
""")
def delta_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lengths by language and source after three batches that take some away and add others."""
    d, k = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.octet_length("text").alias("size")), F.col("doc_id")
    rounds = Rounds(spark, "deltas")
    dimensions = {"language": F.col("lang"), "package": F.col("source"), "all": F.lit("all")}
    measure = lambda files, sign: deltas.signed(files, dimensions, F.col("n_chars"), F.col("size"), sign)
    none, longer = d.limit(0), d.where(k % 10 == 0).withColumn("n_chars", F.col("n_chars") * 2)
    batches = [(none, d.where(k % 5 == 0)), (longer, none), (none, d.where((k % 7 == 1) & (k % 5 != 0)))]
    return deltas.summaries(deltas.maintained(rounds.put(measure(d, 1)), batches, measure, rounds.put))


@query("""
SELECT 'symbols' AS family, 'part:' || p_partkey AS fact_id, p_name AS said FROM part WHERE p_size > 10
UNION ALL SELECT 'occurrences', 'line:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey, l_returnflag FROM lineitem
""")
def pruned_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for two capabilities of five families."""
    rounds = Rounds(spark, "families")
    p, l = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem")  # noqa: E741
    key = lambda kind, *c: F.concat_ws(":", F.lit(kind), *[F.col(x).cast("string") for x in c]).alias("fact_id")
    common = [F.lit("k").alias("kind"), F.lit("s").alias("subject")]
    tables = {
        "symbols": p.where("p_size > 10").select(key("part", "p_partkey"), *common, F.col("p_name").alias("name"), "p_size"), "occurrences": l.select(key("line", "l_orderkey", "l_linenumber", "l_partkey"), *common, F.col("l_returnflag").alias("role"), "l_quantity"),
        "sources": _t(spark, sf_dir, "documents").select(key("doc", "doc_id"), *common, "text"), "project": _t(spark, sf_dir, "nation").select(key("nation", "n_nationkey"), *common, "n_name"), "bodies": _t(spark, sf_dir, "pages").select(key("page", "page_id"), *common, "html"),
    }
    schema = families.write(tables, f"{rounds.root}/facts")
    wanted = families.plan(["calls", "names"], {"calls": "occurrences", "names": "symbols", "texts": "sources"})
    return families.read(spark, f"{rounds.root}/facts", schema, wanted).select("family", "fact_id", F.coalesce("symbols.name", "occurrences.role").alias("said"))


@query("""
WITH i AS (SELECT o_orderkey AS source, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS name FROM orders)
SELECT source, name, 4 AS tier, 800 - least(length(name || ' ' || source), 200)::INT AS score FROM i WHERE contains(name, ' urg') ORDER BY score DESC, name, source LIMIT 40
""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best orders for a beginning of a word, by the postings."""
    rounds = Rounds(spark, "postings")
    name, none = normalized(F.col("o_orderpriority")), F.lit("")
    index = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), name.alias("name"), F.lower("o_orderstatus").alias("title"), F.concat(name, F.lit(" "), F.col("o_orderkey").cast("string")).alias("path"), none.alias("alias"), none.alias("family"), none.alias("status"))
    schema = postings.built(index, f"{rounds.root}/index")
    return postings.top(spark, index, f"{rounds.root}/index", schema, parse_query("urg"))[0].select("source", "name", "tier", "score")


def _step(n: int) -> str:
    """SQL of the occurrences of level n from those below it."""
    return f"""l{n} AS (
  SELECT e.i AS i, min(construct) AS construct, list_sort(list_distinct(flatten(list(unknown)))) AS unknown, list_sort(list_distinct(flatten(list(vals)))) AS every, list_sort(list_distinct(flatten(list(limits)))) AS inherited
  FROM (SELECT p_partkey AS i, unnest([p_partkey - 1, p_partkey - 5, p_partkey - 9]) AS s FROM part WHERE p_partkey % 4 = {n}) e JOIN s{n - 1} ON s{n - 1}.i = e.s GROUP BY e.i),
s{n} AS (
  SELECT i, construct, CASE WHEN construct IS NULL THEN unknown ELSE [] END AS unknown, CASE WHEN construct IS NULL AND len(unknown) = 0 THEN every[1:2] ELSE [] END AS vals,
    CASE WHEN construct IS NULL AND len(unknown) = 0 AND len(every) > 1 THEN list_distinct(list_append(inherited, CASE WHEN len(every) > 2 THEN 'VALUE_ALTERNATIVE_LIMIT' ELSE 'VALUE_ALTERNATIVES' END)) ELSE [] END AS limits FROM l{n}
  UNION ALL SELECT p_partkey, NULL, ['VALUE_NO_SEMANTIC_PATH'], [], [] FROM part WHERE p_partkey % 4 = {n} AND p_partkey NOT IN (SELECT i FROM l{n}))"""


@query(f"""
WITH s0 AS (
  SELECT p_partkey AS i, CASE WHEN p_partkey // 4 % 11 = 1 THEN 'template' END AS construct, CASE WHEN p_partkey // 4 % 11 = 2 THEN ['VALUE_DYNAMIC_CALL'] WHEN p_partkey // 4 % 11 = 3 THEN ['VALUE_RECURSION'] ELSE [] END AS unknown,
    CASE WHEN p_partkey // 4 % 11 IN (1, 2, 3) THEN [] ELSE [CASE WHEN p_size < 25 THEN 'small' ELSE p_brand END] END AS vals, []::VARCHAR[] AS limits FROM part WHERE p_partkey % 4 = 0),
{", ".join(_step(n) for n in (1, 2, 3))},
a AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)
SELECT i AS id, CASE WHEN construct IS NOT NULL THEN 'unsupported' WHEN len(unknown) > 0 THEN 'unknown' WHEN len(vals) = 1 THEN 'known' ELSE 'ambiguous' END AS kind, array_to_string(vals, ',') AS "values",
  array_to_string(list_sort(CASE WHEN len(unknown) > 0 THEN unknown ELSE limits END), ',') AS reasons, construct FROM a
""")
def value_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as occurrences in four levels, each of three sources below: all four states, with what they inherit."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    way, low = F.expr("p_partkey div 4 % 11"), k % 4 == 0
    said = F.when(F.col("p_size") < 25, "small").otherwise(F.col("p_brand"))
    own = p.select(k.alias("id"), F.when(low & ~way.isin(1, 2, 3), said).alias("value"), F.when(low & (way == 1), "template").alias("construct"), F.when(low & (way == 2), "VALUE_DYNAMIC_CALL").when(low & (way == 3), "VALUE_RECURSION").alias("reason"))
    hop = p.where(k % 4 != 0).select(k.alias("id"), F.explode(F.array(k - 1, k - 5, k - 9)).alias("from"))
    hop = hop.join(p.select(k.alias("from")), "from", "left_semi")
    found = body.evaluate(own, hop, max_alternatives=2)
    return found.select("id", "kind", F.array_join("values", ",").alias("values"), F.array_join("reasons", ",").alias("reasons"), "construct")


@query("""
WITH d AS (SELECT doc_id AS id, '{"id":' || doc_id || ',"text":"' || replace(replace(replace(text, chr(92), ''), '"', ''), chr(10), ' ') || '"}' AS body, doc_id % 17 AS f FROM documents WHERE NOT regexp_matches(text, '[\x00-\x09\x0B-\x1F]'))
SELECT id, CASE f WHEN 1 THEN 'CHUNK_ORDER' WHEN 2 THEN 'DIGEST_INVALID' WHEN 3 THEN 'CHUNKS_MISSING' WHEN 4 THEN 'TRANSACTION_UNFINISHED' WHEN 5 THEN 'CHUNK_BEFORE_START' WHEN 6 THEN 'BODY_INVALID' WHEN 7 THEN 'END_MISMATCH' WHEN 8 THEN 'CHUNK_EMPTY'
    WHEN 9 THEN 'CHUNK_ENCODING' WHEN 10 THEN 'FRAME_UNEXPECTED' WHEN 11 THEN 'TRANSACTION_INTERRUPTED' WHEN 12 THEN 'TRANSACTION_ACTIVE' END AS code, CASE WHEN f IN (0, 13, 14, 15, 16) THEN md5(body) END AS body FROM d
""")
def framed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transactions of three chunks, cut between bytes, most of them spoilt in one of twelve ways."""
    d, i, f = _t(spark, sf_dir, "documents").where(~F.col("text").rlike("[\\x00-\\x09\\x0B-\\x1F]")), F.col("doc_id"), F.col("doc_id") % 17
    plain = F.translate(F.translate(F.col("text"), "\\\"", ""), "\n", " ")
    json = F.concat(F.lit('{"id":'), i.cast("string"), F.lit(',"text":"'), plain, F.lit('"}'))
    rows = d.select(i.alias("id"), f.alias("f"), F.when(f == 6, F.concat(F.lit("x"), json)).otherwise(json).cast("binary").alias("b"))
    n = F.octet_length("b")
    third = F.floor(n / 3).cast("int")
    cut = [F.substring("b", F.lit(1), third), F.substring("b", third + 1, third), F.substring("b", 2 * third + 1, n)]
    null = lambda kind: F.lit(None).cast(kind)
    digest = F.when(F.col("f") == 2, F.sha2(F.lit("another"), 256)).otherwise(F.sha2("b", 256))

    def frame(at: int, kind: str, when=None, sequence: int | None = None, data=None, bytes_=None):
        head = kind in ("start", "end")
        said = [F.lit("delta") if head else null("string"), (bytes_ if bytes_ is not None else n).cast("long") if head else null("long"), F.lit(3).cast("long") if head else null("long"), digest if head else null("string")]
        coded = null("string") if data is None else F.regexp_replace(F.base64(data), "[\r\n]", "")
        coded = F.when((F.col("f") == 9) & (F.lit(sequence) == 1), F.concat(coded, F.lit("*"))).otherwise(coded) if data is not None else coded
        made = F.struct(F.lit(at).cast("long").alias("at"), F.lit(kind).alias("kind"), *[c.alias(a) for c, a in zip(said, ("payload", "bytes", "chunks", "sha256"))], F.lit(sequence).cast("long").alias("sequence"), coded.alias("data"), F.lit(100).cast("long").alias("size"))
        return made if when is None else F.when(when, made)

    f = F.col("f")
    frames = [
        frame(0, "chunk", f == 5, 0, cut[0]), frame(1, "start"), frame(2, "chunk", f != 1, 0, cut[0]), frame(2, "chunk", f == 1, 1, cut[0]), frame(3, "start", f == 12), frame(4, "answer", f == 11), frame(5, "chunk", f != 8, 1, cut[1]), frame(5, "chunk", f == 8, 1, F.lit(b"")),
        frame(6, "chunk", f != 3, 2, cut[2]), frame(7, "end", (f != 4) & (f != 7)), frame(7, "end", f == 7, bytes_=n + 1), frame(8, "chunk", f == 10, 3, cut[0]),
    ]
    told = rows.select("id", F.explode(F.array_compact(F.array(*frames))).alias("x")).select("id", "x.*")
    return transactions.assembled(told).select("id", "code", F.md5(F.col("body").cast("binary")).alias("body"))


@query("SELECT p_partkey AS id FROM part WHERE p_type IN ('SMALL', 'PROMO') AND p_brand = 'Brand#1' UNION ALL SELECT p_partkey FROM part WHERE p_type = 'LARGE'")
def class_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files within lists over several axes; no list asks nothing, an empty one lets nothing through."""
    p, axes = _t(spark, sf_dir, "part"), {"purpose": F.col("p_type"), "delivery": F.col("p_brand")}
    scopes = [{"purpose": ["SMALL", "PROMO"], "delivery": ["Brand#1"]}, {"purpose": ["LARGE"], "delivery": None}, {"purpose": None, "delivery": []}]
    found = [p.where(classify.in_scope(axes, s)).select(F.col("p_partkey").alias("id")) for s in scopes]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""
WITH c AS (SELECT p_brand AS owner, CASE WHEN p_size % 9 = 0 THEN 'SCHEMA_MISSING' WHEN p_size % 10 = 1 THEN 'SCHEMA_ID_MISSING' WHEN p_size % 10 = 2 AND p_type = 'PROMO' THEN 'SCHEMA_NOT_OBJECT' END AS code FROM part WHERE p_partkey % 5 = 0)
SELECT owner, CASE WHEN count(code) = 0 THEN 'pass' ELSE 'fail' END AS status, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM c GROUP BY 1
""")
def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's parts as the schemas that it owns, some of them not in the catalog."""
    p, n = _t(spark, sf_dir, "part").where("p_partkey % 5 = 0").withColumn("path", F.col("p_partkey").cast("string")), F.col("p_size")
    catalog = p.where(n % 9 != 0).select("path", F.when(n % 10 == 1, "SCHEMA_ID_MISSING").when((n % 10 == 2) & (F.col("p_type") == "PROMO"), "SCHEMA_NOT_OBJECT").alias("code"))
    found = conformance.schema_rule(catalog, p.select(F.col("p_brand").alias("owner"), "path"))
    return found.select("owner", "status", F.array_join("codes", ",").alias("codes"))


@query("SELECT CASE l_linenumber WHEN 1 THEN 'active' WHEN 2 THEN 'skip' ELSE 'todo' END AS state, count(DISTINCT l_orderkey || ':' || l_linenumber) AS n FROM lineitem GROUP BY 1")
def test_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests by their state, each counted once."""
    n = F.col("l_linenumber")
    tests = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), n.alias("id"), F.when(n == 1, "active").when(n == 2, "skip").otherwise("todo").alias("state"))
    return conformance.test_counts(tests)


@query("""
SELECT l_partkey AS src, CASE WHEN n_name IS NOT NULL THEN n_name ELSE 'supplier:' || l_suppkey END AS dst, l_returnflag AS kind, n_name IS NOT NULL AS external, sum(l_quantity::BIGINT)::BIGINT AS weight
FROM lineitem LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <> 0) ON s_suppkey = l_suppkey GROUP BY ALL
""")
def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from parts to suppliers; suppliers abroad are drawn together by nation."""
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("weight"))
    abroad = _t(spark, sf_dir, "nation").where("n_regionkey <> 0")
    away = _t(spark, sf_dir, "supplier").join(abroad, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"), F.col("n_name").alias("family"))
    return graph.rolled_up(edges, away, "weight")


@query("""
SELECT 'old' AS universe, 1::BIGINT AS sequence, 'shard-' || (o_custkey % 8) AS shard_key, count(*) AS facts FROM orders GROUP BY 3
UNION ALL SELECT 'new', 2, 'shard-' || (o_custkey % 8), count(*) FROM orders WHERE o_custkey % 8 < 5 GROUP BY 3
""")
def ledger_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed configuration begins a universe of its own, and again when it was there: the old one stays as it is."""
    store = ledger.MemoryLedger(spark)
    whole = _order_shards(spark, sf_dir)
    first = store.commit("old", None, whole)
    store.rollover("old", "new", whole)
    second = store.rollover("old", "new", whole.where("shard_key < 'shard-5'"))
    told = [store.facts(g).groupBy("shard_key").agg(F.count("*").alias("facts")).select(F.lit(g.universe).alias("universe"), F.lit(g.sequence).cast("long").alias("sequence"), "shard_key", "facts") for g in (first, second)]
    return told[0].unionByName(told[1])


@query("""
SELECT 'restored' AS outcome, n_name AS said FROM nation WHERE n_regionkey = 1
UNION ALL SELECT * FROM (VALUES ('miss', 'absent'), ('miss', 'key'), ('miss', 'digest'), ('miss', 'rows'))
""")
def checkpoint_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint's table, and the reasons why others can't be used."""
    rounds = Rounds(spark, "checkpoints")
    store, rows = checkpoints.Checkpoints(spark, rounds.root), _t(spark, sf_dir, "nation")
    misses = []

    def missed(scope: str, key: dict) -> None:
        try:
            store.restore(scope, key)
        except checkpoints.Miss as e:
            misses.append(("miss", e.reason))

    missed("none", {})
    for scope in ("a", "b", "c"):
        store.save(scope, {"v": 1}, {"t": rows.where("n_regionkey = 1")})
    missed("a", {"v": 2})
    for scope, other in (("b", rows.where("n_regionkey = 1").withColumn("n_name", F.upper(F.reverse("n_name")))), ("c", rows.where("n_regionkey <> 1"))):
        other.write.mode("overwrite").parquet(f"{store._at(scope)}/{store.attempt(scope)}/t")
        missed(scope, {"v": 1})
    return store.restore("a", {"v": 1})["t"].select(F.lit("restored").alias("outcome"), F.col("n_name").alias("said")).unionByName(spark.createDataFrame(misses, "outcome string, said string"))


@query("""SELECT o_orderkey AS id, '{"a_status":"' || o_orderstatus || '","b_none":null,"z_key":' || o_orderkey || '}' AS json FROM orders""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with their keys in order and nulls kept."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("z_key"), F.lit(None).cast("string").alias("b_none"), F.col("o_orderstatus").alias("a_status"))
    return rows.select(F.col("z_key").alias("id"), canonical_column("z_key", "b_none", "a_status").alias("json"))
