"""Scans, counts, paging, metering and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon import views as v
from quillon.catalog import query
from quillon.operators import writes
from quillon.session import table

o = v.oracle


@query("nodes_count_by_type", o("nodes", "SELECT type, count(*)::BIGINT AS n FROM v_nodes GROUP BY type"))
def _(s, d):
    return v.nodes(s, d).groupBy("type").agg(F.count("*").alias("n"))


@query("nodes_scope_count", o("nodes", "SELECT type, count(*)::BIGINT AS n FROM v_nodes WHERE project_key = 'src3' OR base GROUP BY type"))
def _(s, d):
    return v.nodes(s, d).where("project_key = 'src3' OR base").groupBy("type").agg(F.count("*").alias("n"))


@query("nodes_page", o("nodes", "SELECT id, name, updated_at FROM v_nodes WHERE type = 'memory_project' ORDER BY updated_at DESC, id LIMIT 20 OFFSET 40"))
def _(s, d):
    return v.nodes(s, d).where("type = 'memory_project'").select("id", "name", "updated_at").orderBy(F.desc("updated_at"), "id").offset(40).limit(20)


@query("node_by_source_path", o("nodes", "SELECT id, name FROM v_nodes WHERE source_path = 'docs/src7/7.md' ORDER BY id LIMIT 1"))
def _(s, d):
    return v.nodes(s, d).where("source_path = 'docs/src7/7.md'").select("id", "name").orderBy("id").limit(1)


@query("nodes_by_ids", o("nodes", "SELECT id, type, name FROM v_nodes WHERE id IN (SELECT node_id FROM (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS node_id FROM events))"))
def _(s, d):
    wanted = v.query_log(s, d).select(F.col("node_id").alias("id")).distinct()
    return v.nodes(s, d).join(wanted, "id", "left_semi").select("id", "type", "name")


@query("project_keys", o("nodes", "SELECT DISTINCT project_key FROM v_nodes WHERE project_key IS NOT NULL"))
def _(s, d):
    return v.nodes(s, d).where("project_key IS NOT NULL").select("project_key").distinct()


@query("known_projects", o("nodes", "SELECT coalesce(n.project_key, s.project_key) AS project_key, coalesce(n.n, 0)::BIGINT AS nodes, s.project_key IS NOT NULL AS registered FROM (SELECT project_key, count(*) AS n FROM v_nodes WHERE project_key IS NOT NULL GROUP BY 1) n FULL JOIN (SELECT DISTINCT 'src' || (s_suppkey % 30) AS project_key FROM supplier) s ON n.project_key = s.project_key"))
def _(s, d):
    n = v.nodes(s, d).where("project_key IS NOT NULL").groupBy("project_key").agg(F.count("*").alias("nodes"))
    src = table(s, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey") % 30).alias("project_key")).distinct().withColumn("registered", F.lit(True))
    return n.join(src, "project_key", "full_outer").select("project_key", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"), F.coalesce("registered", F.lit(False)).alias("registered"))


@query("type_facets_cube", o("nodes", "SELECT type, base, count(*)::BIGINT AS n FROM v_nodes GROUP BY CUBE (type, base)"))
def _(s, d):
    return v.nodes(s, d).cube("type", "base").agg(F.count("*").alias("n"))


@query("project_type_matrix", o("nodes", "SELECT coalesce(project_key, '-') AS project, count(*) FILTER (type = 'memory_project')::BIGINT AS memory_project, count(*) FILTER (type = 'memory_feedback')::BIGINT AS memory_feedback, count(*) FILTER (type = 'plan_doc')::BIGINT AS plan_doc, count(*) FILTER (type = 'project_doc')::BIGINT AS project_doc FROM v_nodes GROUP BY 1"))
def _(s, d):
    kinds = ["memory_project", "memory_feedback", "plan_doc", "project_doc"]
    return v.nodes(s, d).groupBy(F.coalesce("project_key", F.lit("-")).alias("project")).pivot("type", kinds).count().select("project", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds])


@query("workspace_node_count", o("nodes", "SELECT k AS project_key, count(*)::BIGINT AS n FROM v_nodes, (VALUES ('src1'), ('src2'), ('src5')) t(k) WHERE project_key = k OR base GROUP BY k"))
def _(s, d):
    keys = ["src1", "src2", "src5"]  # a workspace's own keys; BASE counts for each
    near = F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: (F.col("project_key") == k) | F.col("base"))
    return v.nodes(s, d).select(F.explode(near).alias("project_key")).groupBy("project_key").agg(F.count("*").alias("n"))


@query("audit_stats", o("query_log", "SELECT count(*)::BIGINT AS queries, sum(node_id)::BIGINT AS hits, min(node_id) AS lowest, max(node_id) AS highest FROM v_query_log"))
def _(s, d):
    return v.query_log(s, d).agg(F.count("*").alias("queries"), F.sum("node_id").alias("hits"), F.min("node_id").alias("lowest"), F.max("node_id").alias("highest"))


@query("audit_tag_histogram", o("query_log", "SELECT kind AS tag, count(*)::BIGINT AS n FROM v_query_log GROUP BY kind ORDER BY n DESC, tag"))
def _(s, d):
    return v.query_log(s, d).groupBy(F.col("kind").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


@query("recent_queries_page", o("query_log", "SELECT id, kind, node_id FROM v_query_log ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 25"))
def _(s, d):
    return v.query_log(s, d).orderBy(F.desc("ts"), F.desc("id")).offset(25).limit(25).select("id", "kind", "node_id")


@query("audit_hit_resolution", o("query_log nodes", "SELECT q.id, coalesce(n.name, '[removed]') AS name FROM v_query_log q LEFT JOIN v_nodes n ON q.node_id * 15 = n.id"))
def _(s, d):
    q = v.query_log(s, d).select("id", (F.col("node_id") * 15).alias("hit"))
    n = v.nodes(s, d).select(F.col("id").alias("hit"), "name")
    return q.join(n, "hit", "left").select("id", F.coalesce("name", F.lit("[removed]")).alias("name"))


@query("roi_summary", o("feedback", "SELECT count(*)::BIGINT AS queries, count(*) FILTER (reason = 'thumbs_up')::BIGINT AS up, count(*) FILTER (reason = 'thumbs_down')::BIGINT AS down, round(count(*) FILTER (reason = 'thumbs_up') / greatest(count(*) FILTER (reason IN ('thumbs_up', 'thumbs_down')), 1), 6)::DOUBLE AS ratio, (count(*) * 200)::BIGINT AS tokens_saved FROM v_feedback"))
def _(s, d):
    up, down = F.count_if(F.col("reason") == "thumbs_up"), F.count_if(F.col("reason") == "thumbs_down")
    return v.feedback(s, d).agg(F.count("*").alias("queries"), up.alias("up"), down.alias("down"), F.round(up / F.greatest(up + down, F.lit(1)), 6).alias("ratio"), (F.count("*") * 200).alias("tokens_saved"))


@query("billing_report", o("usage quotas", "SELECT c.c_name AS name, coalesce(u.queries, 0)::BIGINT AS queries, coalesce(u.tokens, 0)::BIGINT AS tokens, coalesce(q.max_queries, 0)::BIGINT AS max_queries, coalesce(q.max_tokens, 0)::BIGINT AS max_tokens, (coalesce(q.max_queries, 0) > 0 AND coalesce(u.queries, 0) > q.max_queries) OR (coalesce(q.max_tokens, 0) > 0 AND coalesce(u.tokens, 0) > q.max_tokens) AS over_quota FROM customer c LEFT JOIN (SELECT * FROM v_usage WHERE period = '1996-03') u ON c.c_custkey = u.api_key_id LEFT JOIN v_quotas q ON c.c_custkey = q.api_key_id"))
def _(s, d):
    return _billing(s, d, "1996-03")


def _billing(s, d, period):
    """All keys with a period's usage and their quota; over where a limit above 0 is exceeded."""
    keys = table(s, d, "customer").select(F.col("c_custkey").alias("api_key_id"), F.col("c_name").alias("name"))
    j = keys.join(v.usage(s, d).where(F.col("period") == period), "api_key_id", "left").join(v.quotas(s, d), "api_key_id", "left").na.fill(0, ["queries", "tokens", "max_queries", "max_tokens"])
    over = ((F.col("max_queries") > 0) & (F.col("queries") > F.col("max_queries"))) | ((F.col("max_tokens") > 0) & (F.col("tokens") > F.col("max_tokens")))
    return j.select("name", "queries", "tokens", "max_queries", "max_tokens", over.alias("over_quota"))


@query("quota_check", o("usage quotas", "SELECT u.api_key_id, u.period, CASE WHEN max_queries > 0 AND queries >= max_queries THEN 'queries' WHEN max_tokens > 0 AND tokens >= max_tokens THEN 'tokens' ELSE 'allowed' END AS verdict FROM v_usage u JOIN v_quotas q USING (api_key_id)"))
def _(s, d):
    q = F.when((F.col("max_queries") > 0) & (F.col("queries") >= F.col("max_queries")), "queries").when((F.col("max_tokens") > 0) & (F.col("tokens") >= F.col("max_tokens")), "tokens").otherwise("allowed")
    return v.usage(s, d).join(v.quotas(s, d), "api_key_id").select("api_key_id", "period", q.alias("verdict"))


@query("usage_by_month", o("usage", "SELECT period, count(*)::BIGINT AS keys, sum(queries)::BIGINT AS queries, sum(tokens)::BIGINT AS tokens FROM v_usage GROUP BY period"))
def _(s, d):
    return v.usage(s, d).groupBy("period").agg(F.count("*").alias("keys"), F.sum("queries").alias("queries"), F.sum("tokens").alias("tokens"))


@query("usage_additive_upsert", o("usage", "SELECT api_key_id, period, sum(queries)::BIGINT AS queries, sum(tokens)::BIGINT AS tokens FROM (SELECT api_key_id, period, queries, tokens FROM v_usage UNION ALL SELECT api_key_id, period, 1, 100 FROM v_usage WHERE api_key_id % 5 = 0) GROUP BY ALL"))
def _(s, d):
    u = v.usage(s, d)
    more = u.where("api_key_id % 5 = 0").select("api_key_id", "period", F.lit(1).cast("long").alias("queries"), F.lit(100).cast("long").alias("tokens"))
    return writes.add_up(u, more, ("api_key_id", "period"), ("queries", "tokens"))


@query("active_api_keys", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 11 <> 0 AND sha256('salt' || c_custkey) >= '8'")
def _(s, d):
    c = table(s, d, "customer").where("c_custkey % 11 <> 0")
    return c.where(F.sha2(F.concat(F.lit("salt"), F.col("c_custkey")).cast("binary"), 256) >= "8").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("node_upsert", o("nodes", "SELECT id, coalesce(f.name, n.name) AS name, n.updated_at AS first_at, coalesce(f.at, n.updated_at) AS updated_at FROM (SELECT id, name, updated_at FROM v_nodes WHERE id % 3 <> 0) n LEFT JOIN (SELECT id, name || '_v2' AS name, updated_at + 7 AS at FROM v_nodes WHERE id % 2 = 0) f USING (id) UNION ALL SELECT id, name || '_v2', updated_at + 7, updated_at + 7 FROM v_nodes WHERE id % 6 = 0"))
def _(s, d):
    n = v.nodes(s, d).select("id", "name", F.col("updated_at").alias("first_at"), "updated_at")
    fresh = n.where("id % 2 = 0").select("id", F.concat("name", F.lit("_v2")).alias("name"), (F.col("first_at") + 7).alias("first_at"), (F.col("updated_at") + 7).alias("updated_at"))
    return writes.upsert(n.where("id % 3 <> 0"), fresh, ("id",), keep=("first_at",))


@query("node_delete_cascade", o("nodes code_edges", "SELECT src, dst FROM v_code_edges WHERE src NOT IN (SELECT id FROM v_nodes WHERE local_only) AND dst NOT IN (SELECT id FROM v_nodes WHERE local_only)"))
def _(s, d):
    e = v.code_edges(s, d).select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"))
    out = writes.delete_nodes({"edges": e}, v.nodes(s, d).where("local_only").select("id"))
    return out["edges"].select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))


@query("feedback_upsert", o("feedback", "SELECT query_id, node_id, reason, max(created_at) AS created_at FROM v_feedback GROUP BY ALL"))
def _(s, d):
    f = v.feedback(s, d).select("query_id", "node_id", "reason", "created_at")
    return writes.upsert(f.limit(0), f, ("query_id", "node_id", "reason"), order="created_at")


@query("project_backfill", o("nodes", "SELECT id, coalesce(project_key, CASE WHEN split_part(source_path, '/', 2) IN ('src0', 'src10') THEN split_part(source_path, '/', 2) END) AS project_key FROM v_nodes"))
def _(s, d):
    sources = s.sql("SELECT * FROM VALUES ('docs/src0', 'src0'), ('docs/src10', 'src10') AS t(path, project_key)")
    return writes.backfill(v.nodes(s, d), sources).select("id", "project_key")


@query("messages_latest_window", o("messages", "SELECT conv_id, seq, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS k FROM v_messages) WHERE k <= 3"))
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    return v.messages(s, d).withColumn("k", F.row_number().over(w)).where("k <= 3").select("conv_id", "seq", "role")


@query("message_seq", o("messages", "SELECT conv_id, seq, (row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1)::BIGINT AS next_seq FROM v_messages"))
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("seq")
    return v.messages(s, d).select("conv_id", "seq", (F.row_number().over(w) - 1).cast("long").alias("next_seq"))


@query("keyset_page", o("messages", "SELECT conv_id, seq, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS k FROM v_messages WHERE seq < 4) WHERE k <= 2"))
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    return v.messages(s, d).where("seq < 4").withColumn("k", F.row_number().over(w)).where("k <= 2").select("conv_id", "seq", "role")


@query("conversation_tokens", o("messages", "SELECT conv_id, sum(length(content) // 4)::BIGINT AS tokens, sum(length(content) // 4) > 300 AS compact FROM v_messages GROUP BY conv_id"))
def _(s, d):
    t = F.sum(F.floor(F.length("content") / 4))
    return v.messages(s, d).groupBy("conv_id").agg(t.cast("long").alias("tokens"), (t > 300).alias("compact"))


@query("compaction_split", o("messages", "SELECT conv_id, count(*) FILTER (k > 6)::BIGINT AS summarised, count(*) FILTER (k <= 6)::BIGINT AS kept FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS k FROM v_messages) GROUP BY conv_id"))
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("seq"))
    return v.messages(s, d).withColumn("k", F.row_number().over(w)).groupBy("conv_id").agg(F.count_if(F.col("k") > 6).alias("summarised"), F.count_if(F.col("k") <= 6).alias("kept"))


@query("permission_check", o("messages", "SELECT DISTINCT m.conv_id FROM v_messages m JOIN (VALUES (NULL, 'assistant'), ('p1', 'system')) g(project, role) ON m.role = g.role AND (g.project IS NULL OR g.project = 'p' || (m.conv_id % 3))"))
def _(s, d):
    grants = s.sql("SELECT * FROM VALUES (CAST(NULL AS STRING), 'assistant'), ('p1', 'system') AS t(project, tool)")
    m = v.messages(s, d).withColumn("p", F.concat(F.lit("p"), F.col("conv_id") % 3))
    return m.join(grants, (m["role"] == grants["tool"]) & (grants["project"].isNull() | (grants["project"] == m["p"])), "left_semi").select("conv_id").distinct()


@query("queue_status_counts", o("query_log", "SELECT s.status, count(q.id)::BIGINT AS n FROM (VALUES ('open'), ('dismissed'), ('resolved')) s(status) LEFT JOIN (SELECT id, CASE kind WHEN 'click' THEN 'open' WHEN 'error' THEN 'dismissed' END AS status FROM v_query_log) q USING (status) GROUP BY s.status"))
def _(s, d):
    q = v.query_log(s, d).select(F.when(F.col("kind") == "click", "open").when(F.col("kind") == "error", "dismissed").alias("status")).where("status IS NOT NULL").groupBy("status").agg(F.count("*").alias("n"))
    all_ = s.sql("SELECT explode(array('open', 'dismissed', 'resolved')) AS status")
    return all_.join(q, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("corpus_fingerprint", o("nodes", "SELECT substr(sha1(string_agg(digest, chr(10) ORDER BY part)), 1, 12) AS fingerprint FROM (SELECT id // 10000 AS part, sha1(string_agg(id || ':' || sha256(coalesce(body, '')), chr(10) ORDER BY id)) AS digest FROM v_nodes GROUP BY 1)"))
def _(s, d):
    """A hash over all (id, hash) pairs in two levels, so that no row holds more than 10,000 of them."""
    n = v.nodes(s, d).select("id", F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256).alias("h"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", "h"))), lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["h"]))
    parts = n.groupBy(F.floor(F.col("id") / 10_000).alias("part")).agg(F.sha1(F.array_join(lines, "\n").cast("binary")).alias("digest"))
    return parts.agg(F.substring(F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda r: r["digest"]), "\n").cast("binary")), 1, 12).alias("fingerprint"))
