"""Domain views over the benchmark tables, and the same views as SQL for the oracle.

Every derivation is integer or string arithmetic, so both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import table

#: "Now" of every registered query: no compared query may read the clock.
NOW = 1_735_689_600
BASE_TIME = 1_704_067_200


def nodes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    kind = F.when(F.col("lang") == "en", "memory_project").when(F.col("lang") == "fr", "memory_feedback").when(F.col("lang") == "de", "plan_doc").otherwise("project_doc")
    return x.select(
        F.col("doc_id").alias("id"),
        kind.alias("type"),
        F.concat(F.lit("node_"), F.col("doc_id")).alias("name"),
        F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("project_key"),
        (F.col("doc_id") % 17 == 0).alias("base"),
        (F.col("doc_id") % 23 == 0).alias("local_only"),
        (F.lit(BASE_TIME) + F.col("doc_id") * 3600).alias("updated_at"),
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("source_path"),
        F.col("text").alias("body"),
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding"))


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """A call graph over parts: every part in a block of 50 calls one other of its block."""
    p = F.col("p_partkey")
    return table(spark, d, "part").where("p_size % 5 <> 0").select(p.alias("src"), (F.floor(p / 50) * 50 + (p % 50 * 3 + 1) % 50).cast("long").alias("dst"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Which module (supplier) defines which symbol (part)."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("symbol")).distinct()


def retrievals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as queries, their parts as retrieved nodes."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("node_id")).distinct()


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Line ranges of symbols in files: (file, symbol, a, b)."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol"), (F.col("l_linenumber") * 10).cast("long").alias("a"), (F.col("l_linenumber") * 10 + F.floor("l_quantity")).cast("long").alias("b")).distinct()


def hunks(spark: SparkSession, d: str) -> DataFrame:
    """Changed line ranges of commits: (commit_id, file, a, b); files are as many as suppliers at the smallest scale."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("commit_id"), (k % 10 + 1).alias("file"), (k % 61).alias("a"), (k % 61 + k % 13).alias("b"))


def query_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a query log: (id, ts, at_s, actor, kind, node_id)."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s"), F.col("user_id").alias("actor"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("node_id"))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Events as feedback on (actor's query, node)."""
    kinds = {"purchase": ("thumbs_up", 1.0), "error": ("thumbs_down", -1.0), "click": ("cite_copied", 0.5), "view": ("inferred_requery", -0.5)}
    pick = lambda k: F.create_map(*[F.lit(x) for a, b in kinds.items() for x in (a, b[k])])[F.col("kind")]
    return query_log(spark, d).where(F.col("kind") != "signup").select("id", F.col("actor").alias("query_id"), (F.col("node_id") % 20).alias("node_id"), pick(0).alias("reason"), pick(1).alias("signal"), F.col("at_s").alias("created_at"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Orders as usage by API key (customer) and UTC month."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("api_key_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("queries"), F.sum(F.floor("o_totalprice")).cast("long").alias("tokens"))


def quotas(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("api_key_id"), (F.col("c_custkey") % 4).alias("max_queries"), (F.greatest(F.floor("c_acctbal"), F.lit(0)) * 10).cast("long").alias("max_tokens"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: (path, content)."""
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), F.col("html").alias("content"))


SQL: dict[str, str] = {
    "nodes": """SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'memory_project' WHEN 'fr' THEN 'memory_feedback' WHEN 'de' THEN 'plan_doc' ELSE 'project_doc' END AS type,
        'node_' || doc_id AS name, CASE WHEN doc_id % 10 <> 0 THEN source END AS project_key, doc_id % 17 = 0 AS base, doc_id % 23 = 0 AS local_only,
        (1704067200 + doc_id * 3600)::BIGINT AS updated_at, 'docs/' || source || '/' || doc_id || '.md' AS source_path, text AS body FROM documents""",
    "chunks": "SELECT vec_id AS node_id, embedding FROM embeddings",
    "code_edges": "SELECT p_partkey AS src, ((p_partkey // 50) * 50 + (p_partkey % 50 * 3 + 1) % 50)::BIGINT AS dst FROM part WHERE p_size % 5 <> 0",
    "members": "SELECT DISTINCT l_suppkey AS module, l_partkey AS symbol FROM lineitem",
    "retrievals": "SELECT DISTINCT l_orderkey AS query_id, l_partkey AS node_id FROM lineitem",
    "spans": "SELECT DISTINCT l_suppkey AS file, l_partkey AS symbol, (l_linenumber * 10)::BIGINT AS a, (l_linenumber * 10 + floor(l_quantity))::BIGINT AS b FROM lineitem",
    "hunks": "SELECT o_orderkey AS commit_id, o_orderkey % 10 + 1 AS file, o_orderkey % 61 AS a, o_orderkey % 61 + o_orderkey % 13 AS b FROM orders",
    "query_log": "SELECT event_id AS id, ts, floor(epoch(ts))::BIGINT AS at_s, user_id AS actor, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS node_id FROM events",
    "feedback": """SELECT event_id AS id, user_id AS query_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS node_id,
        CASE event_type WHEN 'purchase' THEN 'thumbs_up' WHEN 'error' THEN 'thumbs_down' WHEN 'click' THEN 'cite_copied' WHEN 'view' THEN 'inferred_requery' END AS reason,
        CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'error' THEN -1.0::DOUBLE WHEN 'click' THEN 0.5::DOUBLE WHEN 'view' THEN -0.5::DOUBLE END AS signal,
        floor(epoch(ts))::BIGINT AS created_at FROM events WHERE event_type <> 'signup'""",
    "messages": "SELECT conv_id, turn AS seq, role, text AS content FROM conversations",
    "usage": "SELECT o_custkey AS api_key_id, strftime(o_orderdate, '%Y-%m') AS period, count(*)::BIGINT AS queries, sum(floor(o_totalprice))::BIGINT AS tokens FROM orders GROUP BY ALL",
    "quotas": "SELECT c_custkey AS api_key_id, c_custkey % 4 AS max_queries, (greatest(floor(c_acctbal), 0) * 10)::BIGINT AS max_tokens FROM customer WHERE c_custkey % 3 <> 0",
    "files": "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, html AS content FROM pages",
}


def oracle(views: str, body: str, recursive: bool = False) -> str:
    """A query over the named views (space separated), each prefixed v_."""
    made = ", ".join(f"v_{v} AS ({SQL[v]})" for v in views.split())
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:] if made else body
        return f"WITH {'RECURSIVE ' if recursive else ''}{made}{body}" if made else body
    return f"WITH {'RECURSIVE ' if recursive else ''}{made} {body}" if made else body
