"""Lookups, paging, keys and composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon import views as v
from quillon.catalog import query
from quillon.functions import text as t
from quillon.functions.chunks import chunked
from quillon.functions.embed import embedded
from quillon.session import table

o = v.oracle


@query("key_resolver_suffix", o("nodes", "SELECT k, arg_min(id, (length(source_path), id)) AS id FROM (SELECT '/' || (n.id % 7) || '.md' AS k, n.id, n.source_path FROM v_nodes n WHERE n.source_path LIKE '%/' || (n.id % 7) || '.md') GROUP BY k"))
def _(s, d):
    n = v.nodes(s, d).withColumn("k", F.concat(F.lit("/"), F.col("id") % 7, F.lit(".md"))).where(F.endswith("source_path", F.col("k")))
    return n.groupBy("k").agg(F.min_by("id", F.struct(F.length("source_path"), F.col("id"))).alias("id"))


@query("target_resolve", o("nodes", "SELECT t.target, coalesce(a.id, b.id) AS id FROM (SELECT CASE WHEN id % 2 = 0 THEN id::VARCHAR ELSE 'node_' || id END AS target FROM v_nodes WHERE id % 6 < 2 UNION ALL SELECT 'nowhere') t LEFT JOIN v_nodes a ON t.target = a.id::VARCHAR LEFT JOIN (SELECT name, min(id) AS id FROM v_nodes GROUP BY name) b ON t.target = b.name"))
def _(s, d):
    n = v.nodes(s, d)
    targets = n.where("id % 6 < 2").select(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit("node_"), "id")).alias("target")).unionByName(s.sql("SELECT 'nowhere' AS target"))
    by_id = n.select(F.col("id").cast("string").alias("target"), F.col("id").alias("a"))
    by_name = n.groupBy(F.col("name").alias("target")).agg(F.min("id").alias("b"))
    return targets.join(by_id, "target", "left").join(by_name, "target", "left").select("target", F.coalesce("a", "b").alias("id"))


@query("queries_with_feedback", o("feedback", "SELECT query_id, count(*)::BIGINT AS n, min(created_at) AS first_at FROM v_feedback GROUP BY query_id HAVING count(*) >= 3"))
def _(s, d):
    return v.feedback(s, d).groupBy("query_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at")).where("n >= 3")


@query("feedback_scan", o("feedback", "SELECT id, query_id, node_id, signal FROM v_feedback WHERE node_id = 3 ORDER BY created_at DESC, id DESC LIMIT 50"))
def _(s, d):
    return v.feedback(s, d).where("node_id = 3").orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "query_id", "node_id", "signal")


@query("recent_window", o("query_log", "SELECT id FROM v_query_log WHERE at_s >= (SELECT max(at_s) FROM v_query_log) - 86400"))
def _(s, d):
    q = v.query_log(s, d)
    last = q.agg(F.max("at_s").alias("last"))  # one row
    return q.join(F.broadcast(last), F.lit(True)).where("at_s >= last - 86400").select("id")


@query("edge_scan", o("code_edges", "SELECT src, dst FROM v_code_edges WHERE dst % 50 = 4 AND src % 2 = 1"))
def _(s, d):
    return v.code_edges(s, d).where("dst % 50 = 4 AND src % 2 = 1")


@query("scope_keys", o("nodes", "SELECT DISTINCT CASE WHEN base THEN 'base_only' WHEN project_key IS NULL THEN 'global' ELSE 'project:' || project_key END AS scope FROM v_nodes"))
def _(s, d):
    return v.nodes(s, d).select(F.when(F.col("base"), "base_only").when(F.col("project_key").isNull(), "global").otherwise(F.concat(F.lit("project:"), "project_key")).alias("scope")).distinct()


@query("common_path_prefix", o("nodes", "SELECT project_key, 'docs/' || project_key AS prefix FROM v_nodes WHERE project_key IS NOT NULL GROUP BY project_key HAVING count(*) > 1"))
def _(s, d):
    """The longest common folder of a project's paths: that of its first and last path in order."""
    p = v.nodes(s, d).where("project_key IS NOT NULL").groupBy("project_key").agg(F.split(F.min("source_path"), "/").alias("a"), F.split(F.max("source_path"), "/").alias("b"), F.count("*").alias("n")).where("n > 1")
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: F.when(x.eqNullSafe(y), x)), F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("p")), lambda acc, x: F.struct((acc["on"] & x.isNotNull()).alias("on"), F.when(acc["on"] & x.isNotNull(), F.concat(acc["p"], F.array(x))).otherwise(acc["p"]).alias("p")))
    return p.select("project_key", F.array_join(same["p"], "/").alias("prefix"))


@query("retrieval_blocks", o("messages", "SELECT conv_id, string_agg('- ' || role || ': ' || substr(content, 1, 40), chr(10) ORDER BY seq) AS block FROM v_messages GROUP BY conv_id"))
def _(s, d):
    rows = F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit("- "), "role", F.lit(": "), F.substring("content", 1, 40)).alias("x"))))
    return v.messages(s, d).groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("block"))


@query("dashboard_counts", o("nodes code_edges query_log", "SELECT 'nodes' AS what, count(*)::BIGINT AS n FROM v_nodes UNION ALL SELECT 'edges', count(*)::BIGINT FROM v_code_edges UNION ALL SELECT 'queries', count(*)::BIGINT FROM v_query_log"))
def _(s, d):
    c = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return c(v.nodes(s, d), "nodes").unionByName(c(v.code_edges(s, d), "edges")).unionByName(c(v.query_log(s, d), "queries"))


@query("nodes_recent_per_type", o("nodes", "SELECT type, id FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY updated_at DESC, id) AS k FROM v_nodes) WHERE k <= 3"))
def _(s, d):
    w = Window.partitionBy("type").orderBy(F.desc("updated_at"), "id")
    return v.nodes(s, d).withColumn("k", F.row_number().over(w)).where("k <= 3").select("type", "id")


@query("citation_precision", o("messages", "SELECT conv_id, round(avg((length(content) % 5 < 2)::INT), 6)::DOUBLE AS precision FROM v_messages WHERE role = 'assistant' GROUP BY conv_id"))
def _(s, d):
    m = v.messages(s, d).where("role = 'assistant'")
    return m.groupBy("conv_id").agg(F.round(F.avg((F.length("content") % 5 < 2).cast("int")), 6).alias("precision"))


@query("chunk_embeddings")
def _(s, d):
    return embedded(chunked(v.nodes(s, d).select("id", "body")))


@query("month_end_seconds", "SELECT o_orderkey AS k, (epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) - epoch(o_orderdate))::BIGINT AS left_s FROM orders")
def _(s, d):
    at = F.col("o_orderdate").cast("timestamp")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), (F.unix_timestamp(F.add_months(F.trunc(F.to_date(at), "month"), 1).cast("timestamp")) - F.unix_timestamp(at)).alias("left_s"))
