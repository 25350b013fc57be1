"""Structured documents: schema catalogs, front matter, frames of line-delimited JSON, code graphs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.identity import set_digest

MAX_MARKDOWN_BYTES = 512 << 10


def schema_catalog(documents: DataFrame) -> DataFrame:
    """(path, id, code): JSON Schema documents (path, text) that aren't objects, lack an $id, share one,
    or refer to one that no document has. Rows without a fault have a null code."""
    d = documents.select("path", F.try_parse_json("text").alias("doc"), "text")
    ident = F.try_variant_get("doc", "$.$id", "string")
    rows = d.select("path", ident.alias("id"), (F.schema_of_variant("doc").startswith("OBJECT")).alias("object"), "text")
    n = rows.where("id IS NOT NULL").groupBy(F.col("id").alias("__i")).agg(F.count("*").alias("n"))
    refs = rows.select("path", F.explode(F.regexp_extract_all("text", F.lit(r'"\$ref"\s*:\s*"([^"#][^"#]*)'), F.lit(1))).alias("ref"))
    lost = refs.join(n, F.col("ref") == F.col("__i"), "left_anti").select(F.col("path").alias("__p")).distinct()
    met = rows.join(n, F.col("id") == F.col("__i"), "left").join(lost, F.col("path") == F.col("__p"), "left")
    code = F.when(~F.coalesce("object", F.lit(False)), "SCHEMA_NOT_OBJECT").when(F.col("id").isNull(), "SCHEMA_ID_MISSING").when(F.col("n") > 1, "SCHEMA_ID_DUPLICATE").when(F.col("__p").isNotNull(), "SCHEMA_REFERENCE_MISSING")
    return met.select("path", "id", code.alias("code"))


def markdown(documents: DataFrame) -> DataFrame:
    """(path, title, headings, code) of Markdown texts (path, text): the first heading, all headings
    outside of fences, and MARKDOWN_TOO_LARGE beyond the limit, where nothing is read."""
    large = F.octet_length("text") > MAX_MARKDOWN_BYTES
    bare = F.regexp_replace("text", r"(?ms)^(```|~~~).*?^\1[^\n]*$", "")
    headings = F.transform(F.regexp_extract_all(bare, F.lit(r"(?m)^#{1,6}[ \t]+(.*?)[ \t#]*$"), F.lit(1)), lambda h: F.trim(h))
    shown = F.when(~large, headings)
    return documents.select("path", F.get(shown, F.lit(0)).alias("title"), shown.alias("headings"), F.when(large, "MARKDOWN_TOO_LARGE").alias("code"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, kind, body) of a stream of JSON lines {"sequence", "kind", "body"}."""
    return spark.read.text(path).select(F.from_json("value", "sequence bigint, kind string, body string").alias("f")).select("f.*").where("kind IS NOT NULL")


def frame_errors(rows: DataFrame) -> DataFrame:
    """(code, sequence): sequences that repeat, and the first that is missing before the last."""
    n = rows.groupBy("sequence").count()
    twice = n.where("count > 1").select(F.lit("FRAME_REPEATED").alias("code"), "sequence")
    following = n.select((F.col("sequence") + 1).alias("sequence")).join(n, "sequence", "left_anti")
    gap = following.join(rows.agg(F.max("sequence").alias("__m"))).where("sequence <= __m").agg(F.min("sequence").alias("sequence")).where("sequence IS NOT NULL")
    return twice.unionByName(gap.select(F.lit("FRAME_MISSING").alias("code"), "sequence"))


#: A node's place, by which other relations name it.
PLACE = ("file", "qualified_name", "kind", "line")
#: Relation -> the columns that hold ids of nodes, with the prefix of the place that stands for each, and
#: whether a row without that node stays.
RELATIONS = {
    "node": [("parent_id", "parent_", True)],
    "edge": [("source_id", "source_", False), ("target_id", "target_", False)],
    "metric": [("node_id", "", False)],
    "complexity": [("node_id", "", False)],
    "syntax": [("parent_id", "parent_", True)],
    "block": [("function_id", "function_", False)],
    "block_edge": [("function_id", "function_", False)],
    "vertex": [("function_id", "function_", False), ("node_id", "node_", True)],
    "flow": [("source_id", "source_", True), ("target_id", "target_", True)],
    "file": [],
}


def code_graph(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, line): a code graph's tables as canonical lines, free of the ids that one run gave:
    every id of a node is replaced by the node's place. Rows whose node is missing go, or stay without
    one where the relation allows. Block and flow ends (source_block_id, source_vertex_id, ...) are
    replaced by the block's index and the vertex's name and place among parameters.

    tables: relation -> table; node has id, name, qualified_name, kind, file, line and more; block id,
    function_id, block_index; vertex id, kind, name, param_index. Absent relations are empty.
    """
    nodes = tables["node"].withColumn("qualified_name", F.coalesce("qualified_name", "name"))
    inner = {
        "block_edge": ("block", {"source_block_id": "source_block", "target_block_id": "target_block"}, ("block_index",), "inner"),
        "flow": ("vertex", {"source_vertex_id": "source_vertex", "target_vertex_id": "target_vertex"}, ("kind", "name", "param_index"), "left"),
    }
    out = None
    for relation, refs in RELATIONS.items():
        if relation not in tables:
            continue
        rows = (nodes if relation == "node" else tables[relation]).drop("id")
        for column, prefix, optional in refs:
            place = nodes.select(F.col("id").alias("__id"), *[F.col(c).alias(f"{prefix}{c}") for c in PLACE])
            rows = rows.join(place, F.col(column) == F.col("__id"), "left" if optional else "inner").drop("__id", column)
        if relation in inner and inner[relation][0] in tables:
            other, ends, keep, how = inner[relation]
            for column, prefix in ends.items():
                part = tables[other].select(F.col("id").alias("__id"), *[F.col(c).alias(f"{prefix}_{c}") for c in keep])
                rows = rows.join(part, F.col(column) == F.col("__id"), how).drop("__id", column)
        lines = rows.select(F.lit(relation).alias("relation"), F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


def graph_digest(lines: DataFrame) -> DataFrame:
    """One row (digest) over all lines."""
    return set_digest(lines, F.concat_ws("|", "relation", "line"))


def checkpoint_key(artifacts: dict[str, bytes]) -> str:
    """The manifest digest of a checkpoint's artifacts."""
    lines = sorted(f"{k}:{hashlib.sha256(v).hexdigest()}" for k, v in artifacts.items())
    return hashlib.sha256(json.dumps(lines).encode()).hexdigest()
