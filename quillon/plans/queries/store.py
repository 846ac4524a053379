"""Keyed writes and lookups of the single tables, and composite reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.functions import text as t
from quillon.operators import graph, store
from quillon.plans import analysis, feedback, tools
from quillon.session import table
from quillon.sources import settings

o = v.oracle
_SRC = "s AS (SELECT s_suppkey AS k, 'docs/src' || (s_suppkey % 40) || CASE WHEN s_suppkey >= 40 THEN '/p' || s_suppkey ELSE '' END AS path, CASE WHEN s_suppkey % 4 <> 0 THEN 'src' || (s_suppkey % 40) END AS project_key, s_suppkey % 5 <> 0 AS enabled FROM supplier)"
_E = "e AS (SELECT src, dst, CASE src % 5 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'defines' WHEN 3 THEN 'method_of' ELSE 'references_function' END AS relation FROM v_code_edges)"


def _sources(s, d):
    k = F.col("s_suppkey")
    path = F.concat(F.lit("docs/src"), k % 40, F.when(k >= 40, F.concat(F.lit("/p"), k)).otherwise(""))
    return table(s, d, "supplier").select(path.alias("path"), F.lit("docs_dir").alias("kind"), F.when(k % 4 != 0, F.concat(F.lit("src"), k % 40)).alias("project_key"), k.alias("last_indexed_at"), (k % 5 != 0).alias("enabled"), F.lit(None).cast("string").alias("include"), F.lit("*.log").alias("exclude"))


def _edges(s, d):
    k = F.col("src")
    kind = F.when(k % 5 == 0, "calls").when(k % 5 == 1, "imports").when(k % 5 == 2, "defines").when(k % 5 == 3, "method_of").otherwise("references_function")
    return v.code_edges(s, d).select("src", "dst", kind.alias("relation"))


def _stored_edges(s, d):
    return _edges(s, d).select(F.col("src").cast("string").alias("src_id"), F.col("dst").cast("string").alias("dst_id"), "relation", F.lit(0.5).alias("weight"), F.lit(5).cast("long").alias("created_at"), F.lit("ingest").alias("source"), F.lit(0.9).alias("confidence"))


@query("edge_upsert", o("code_edges", f"WITH {_E}, f AS (SELECT src, dst, relation FROM e WHERE src % 3 = 0 UNION ALL SELECT src, dst, 'mentions' FROM e WHERE src % 7 = 0) SELECT coalesce(e.src, f.src)::VARCHAR AS src_id, coalesce(e.dst, f.dst)::VARCHAR AS dst_id, coalesce(e.relation, f.relation) AS relation, CASE WHEN f.src IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, CASE WHEN e.src IS NULL THEN 77 ELSE 5 END::BIGINT AS created_at, CASE WHEN f.src IS NULL THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM e FULL JOIN f ON e.src = f.src AND e.dst = f.dst AND e.relation = f.relation"))
def _(s, d):
    """Weight and confidence count 1 where a fresh edge does not say them."""
    e = _stored_edges(s, d)
    k = F.col("src_id").cast("long")
    fresh = e.where(k % 3 == 0).select("src_id", "dst_id", "relation").unionByName(e.where(k % 7 == 0).select("src_id", "dst_id", F.lit("mentions").alias("relation")))
    return store.upsert_edges(e, fresh, 77).drop("source")


@query("co_occurrence_write", o("code_edges retrievals", "WITH p AS MATERIALIZED (SELECT a.node_id AS src, b.node_id AS dst, least(count(*) * 0.1, 5.0) AS w FROM v_retrievals a JOIN v_retrievals b ON a.query_id = b.query_id AND a.node_id <> b.node_id GROUP BY ALL), old AS (SELECT src, dst, 4.95::DOUBLE AS w FROM p WHERE src % 2 = 0) SELECT p.src::VARCHAR AS src_id, p.dst::VARCHAR AS dst_id, round(least(5.0, coalesce(old.w, 0) + p.w), 6)::DOUBLE AS weight FROM p LEFT JOIN old ON p.src = old.src AND p.dst = old.dst"))
def _(s, d):
    lines = table(s, d, "lineitem")
    p = graph.co_occurrence(lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("node_id")), rows=lines.count())
    old = p.where("src % 2 = 0").select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("co_occurs_with").alias("relation"), F.lit(4.95).alias("weight"), F.lit(1).cast("long").alias("created_at"), F.lit("x").alias("source"), F.lit(1.0).alias("confidence"))
    return store.add_co_occurrence(old, p, 9).select(F.col("src_id").cast("string"), F.col("dst_id").cast("string"), F.round("weight", 6).alias("weight"))


@query("declared_edges", o("nodes", "SELECT DISTINCT * FROM (SELECT id AS src_id, id + 1 AS dst_id, 'applies_to' AS relation FROM v_nodes WHERE id + 1 IN (SELECT id FROM v_nodes) UNION ALL SELECT id, id - 2, 'supersedes' FROM v_nodes WHERE id - 2 IN (SELECT id FROM v_nodes))"))
def _(s, d):
    """One target by id, one by name, one that is the node itself and one that nothing has."""
    k = F.col("id")
    header = F.concat(F.lit('{"appliesTo":["'), k + 1, F.lit('"," "],"supersedes":["node_'), k - 2, F.lit('","'), k, F.lit('"],"derivedFrom":["nowhere"],"x":1}'))
    return store.declared_edges(v.nodes(s, d).withColumn("frontmatter_json", header))


@query("source_register", f"WITH {_SRC} SELECT path, CASE WHEN k % 6 = 0 THEN 'new' ELSE project_key END AS project_key, k AS last_indexed_at, CASE WHEN k % 6 = 0 THEN true ELSE enabled END AS enabled FROM s UNION ALL SELECT 'more/x', 'new', NULL, true")
def _(s, d):
    old = _sources(s, d)
    fresh = old.where("last_indexed_at % 6 = 0").select("path", "kind").unionByName(s.sql("SELECT 'more/x' AS path, 'docs_dir' AS kind")).withColumn("project_key", F.lit("new"))
    return store.register_sources(old, fresh).select("path", "project_key", "last_indexed_at", "enabled")


@query("source_patch", f"WITH {_SRC} SELECT path, CASE WHEN k % 2 = 0 THEN NULL ELSE project_key END AS project_key, '*.log' AS exclude, CASE WHEN k % 2 = 0 THEN false ELSE enabled END AS enabled FROM s")
def _(s, d):
    """A named field is set, to null as well; one that is not named stays."""
    patches = _sources(s, d).where("last_indexed_at % 2 = 0").select("path", F.array(F.lit("project_key"), F.lit("enabled")).alias("fields"), F.lit(None).cast("string").alias("project_key"), F.lit("lost").alias("exclude"), F.lit(False).alias("enabled"))
    return store.patch_sources(_sources(s, d), patches).select("path", "project_key", "exclude", "enabled")


@query("source_remove", o("nodes", f"WITH {_SRC}, g AS (SELECT path FROM s WHERE k % 9 = 0) SELECT n.id FROM v_nodes n WHERE NOT EXISTS (SELECT 1 FROM g WHERE n.source_path = g.path OR starts_with(n.source_path, g.path || '/'))"))
def _(s, d):
    src = _sources(s, d)
    return store.remove_sources({"nodes": v.nodes(s, d), "sources": src}, src.where("last_indexed_at % 9 = 0").select("path"))["nodes"].select("id")


@query("enabled_sources", f"WITH {_SRC} SELECT path, project_key FROM s WHERE enabled")
def _(s, d):
    return _sources(s, d).where("enabled").select("path", "project_key")


@query("affected_sources", o("nodes", f"WITH {_SRC}, c AS (SELECT source_path AS p FROM v_nodes WHERE id % 10 = 3) SELECT DISTINCT path FROM s WHERE enabled AND EXISTS (SELECT 1 FROM c WHERE p = path OR starts_with(p, path || '/'))"))
def _(s, d):
    return store.affected_sources(v.nodes(s, d).where("id % 10 = 3").select(F.col("source_path").alias("path")), _sources(s, d)).select("path")


@query("query_log_append", o("query_log", "SELECT id, kind FROM v_query_log"))
def _(s, d):
    """Rows that come again are not logged twice."""
    q = v.query_log(s, d).select("id", "kind")
    return store.log_queries(q.where("id % 3 <> 0"), q.where("id % 2 = 0").unionByName(q.where("id % 3 = 0")))


@query("feedback_post", o("feedback nodes", "SELECT query_id, node_id, reason, max(signal) AS signal, max(created_at) AS created_at FROM v_feedback WHERE node_id IN (SELECT id FROM v_nodes WHERE id % 2 = 0) AND query_id % 3 <> 0 GROUP BY ALL"))
def _(s, d):
    f = v.feedback(s, d)
    queries = f.select(F.col("query_id").alias("id")).distinct().where("id % 3 <> 0")
    none = f.select("query_id", "node_id", "reason", "signal", "created_at").where("false")
    return store.post_feedback(none, f.drop("signal", "id"), queries, v.nodes(s, d).where("id % 2 = 0"))


@query("quota_set", o("quotas", "SELECT c_custkey AS api_key_id, 'monthly' AS period, CASE WHEN c_custkey % 5 = 0 THEN 9 ELSE max_queries END AS max_queries, CASE WHEN c_custkey % 5 = 0 THEN 90 ELSE max_tokens END AS max_tokens FROM customer LEFT JOIN v_quotas ON c_custkey = api_key_id WHERE c_custkey % 3 <> 0 OR c_custkey % 5 = 0"))
def _(s, d):
    keys = table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    old = v.quotas(s, d).select("api_key_id", F.lit("monthly").alias("period"), "max_queries", "max_tokens")
    fresh = keys.where("id % 5 = 0").select(F.col("id").alias("api_key_id"), F.lit(9).cast("long").alias("max_queries"), F.lit(90).cast("long").alias("max_tokens"))
    return store.set_quotas(old, fresh, keys)


def _keys(s, d):
    k = F.col("c_custkey")
    fresh = table(s, d, "customer").select(k.cast("string").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("salt"), k % 7).alias("salt"), F.concat(F.lit("raw"), k).alias("raw"))
    none = s.sql("SELECT '' AS id, '' AS name, '' AS key_hash, '' AS salt, CAST(0 AS BIGINT) AS created_at, CAST(0 AS BIGINT) AS revoked_at WHERE false")
    made = store.create_keys(none, fresh, 10)
    return store.revoke_keys(store.revoke_keys(made, made.where("CAST(id AS BIGINT) % 4 = 0"), 20), made.where("CAST(id AS BIGINT) % 2 = 0"), 30)


@query("api_keys_table", "SELECT c_custkey::VARCHAR AS id, sha256('salt' || (c_custkey % 7) || 'raw' || c_custkey) AS key_hash, CASE WHEN c_custkey % 4 = 0 THEN 20 WHEN c_custkey % 2 = 0 THEN 30 END::BIGINT AS revoked_at FROM customer")
def _(s, d):
    return _keys(s, d).select("id", "key_hash", "revoked_at")


@query("api_key_verify", "SELECT c_custkey AS attempt, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 5 <> 0")
def _(s, d):
    k = F.col("c_custkey")
    return store.verified_keys(_keys(s, d), table(s, d, "customer").select(k.alias("attempt"), F.concat(F.when(k % 5 == 0, "bad").otherwise("raw"), k).alias("raw")))


@query("ledger_writes", o("query_log", "SELECT actor::VARCHAR AS session_id, 'f' || node_id AS file_path, max(at_s)::DOUBLE AS touched_at FROM v_query_log GROUP BY ALL"))
def _(s, d):
    q = v.query_log(s, d).select(F.col("actor").cast("string").alias("session_id"), F.concat(F.lit("f"), "node_id").alias("file_path"), F.col("at_s").cast("double").alias("touched_at"), "id")
    return store.touch_files(q.where("id % 2 = 0").drop("id"), q.where("id % 2 = 1").drop("id"))


@query("ledger_stamps", o("query_log", "SELECT session_id, rule_id, arg_max(status, stamped_at) AS status FROM (SELECT actor::VARCHAR AS session_id, kind AS rule_id, 'ok' || id AS status, at_s * 1000000 + id AS stamped_at FROM v_query_log) GROUP BY ALL"))
def _(s, d):
    q = v.query_log(s, d).select(F.col("actor").cast("string").alias("session_id"), F.col("kind").alias("rule_id"), F.lit("verify").alias("step"), F.concat(F.lit("ok"), "id").alias("status"), (F.col("at_s") * 1_000_000 + F.col("id")).cast("double").alias("stamped_at"))
    return store.stamp_evidence(q.limit(0), q).select("session_id", "rule_id", "status")


@query("mtime_gate", "SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0")
def _(s, d):
    """Files that were never read, or changed since; then the index holds them all, so nothing is left."""
    f = table(s, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.col("page_id").cast("double").alias("mtime"), "page_id")
    index = f.where("page_id % 3 <> 0").select("path", (F.col("mtime") - F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).alias("mtime"), F.lit(1).cast("long").alias("indexed_at"))
    new = store.unread(f, index)
    after = store.set_mtimes(index, new.select("path", "mtime", F.lit(2).cast("long").alias("indexed_at")))
    return new.select("page_id").unionByName(store.unread(f, after).select("page_id"))


@query("layout_cache", o("code_edges", "SELECT 'project:p' || (src % 4) AS scope_key, 'f' || max(src) AS fingerprint FROM v_code_edges GROUP BY 1"))
def _(s, d):
    from quillon.operators import writes

    row = lambda c: v.code_edges(s, d).groupBy((F.col("src") % 4).alias("k")).agg(c.alias("m")).select(F.concat(F.lit("project:p"), "k").alias("scope_key"), F.concat(F.lit("f"), "m").alias("fingerprint"), F.array(F.lit(0.0)).alias("positions"))
    return writes.upsert(row(F.min("src")), row(F.max("src")), ("scope_key",)).select("scope_key", "fingerprint")


@query("active_project", "SELECT 'p' || count(*) AS project_key FROM region")
def _(s, d):
    from quillon.operators import writes

    held = s.sql("SELECT 'only' AS slot, 'old' AS project_key")
    fresh = table(s, d, "region").agg(F.count("*").alias("n")).select(F.lit("only").alias("slot"), F.concat(F.lit("p"), "n").alias("project_key"))
    return store.singleton(writes.upsert(held, fresh, ("slot",)).select("project_key"))


@query("bookmarks", o("messages", "SELECT conv_id, seq, 'b' || seq AS label FROM v_messages WHERE seq % 2 = 0 AND conv_id % 5 <> 0"))
def _(s, d):
    from quillon.operators import writes

    made = v.messages(s, d).where("seq % 2 = 0").select("conv_id", "seq", F.concat(F.lit("b"), "seq").alias("label"))
    return writes.delete(made, made.where("conv_id % 5 = 0").select(F.col("conv_id").alias("c"), F.col("seq").alias("q")), {"conv_id": "c", "seq": "q"})


@query("permission_writes", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN 'p' || (c_custkey // 2) END AS project_key, 't' || (c_custkey % 3) AS tool_name FROM customer),
h AS (SELECT project_key, tool_name, min(k) AS granted_ms FROM c WHERE k % 2 = 0 GROUP BY ALL), f AS (SELECT project_key, tool_name, min(k) + 1000000 AS granted_ms FROM c WHERE k % 3 <> 1 GROUP BY ALL),
g AS (SELECT project_key, tool_name, min(granted_ms) AS granted_ms FROM (SELECT * FROM h UNION ALL SELECT * FROM f) GROUP BY ALL), r AS (SELECT DISTINCT project_key, tool_name FROM c WHERE k % 5 = 0 AND tool_name = 't1')
SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.project_key IS NOT DISTINCT FROM g.project_key AND r.tool_name = g.tool_name)""")
def _(s, d):
    """A grant that comes again keeps its time, one that is revoked goes, null meets null."""
    k = F.col("c_custkey")
    c = table(s, d, "customer").select(k.alias("k"), F.when(k % 7 != 0, F.concat(F.lit("p"), F.floor(k / 2).cast("long"))).alias("project_key"), F.concat(F.lit("t"), k % 3).alias("tool_name"))
    first = lambda df, more: df.groupBy("project_key", "tool_name").agg((F.min("k") + more).alias("granted_ms"))
    held = store.grant(first(c.where("k % 2 = 0"), 0), first(c.where("k % 3 <> 1"), 1_000_000))
    return store.revoke(held, c.where("k % 5 = 0 AND tool_name = 't1'").select("project_key", "tool_name", F.lit(0).alias("granted_ms")).distinct())


@query("override_set", "SELECT 'f' || page_id AS source_path, CASE WHEN page_id % 4 = 0 THEN 'retry' WHEN page_id % 2 = 0 THEN 'always_skip' ELSE 'always_keep' END AS decision FROM pages")
def _(s, d):
    p = table(s, d, "pages").select(F.concat(F.lit("f"), "page_id").alias("source_path"), F.when(F.col("page_id") % 2 == 0, "always_skip").otherwise("always_keep").alias("decision"), F.lit("why").alias("reason"), F.col("page_id").alias("decided_ms"))
    fresh = p.where("decided_ms % 4 = 0").select("source_path", F.lit("retry").alias("decision"), "reason", (F.col("decided_ms") + 1).alias("decided_ms"))
    return store.set_overrides(p, fresh).select("source_path", "decision")


def _workspaces(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("src"), "n_regionkey"), F.lit("x")).alias("project_keys"), F.col("n_nationkey").cast("long").alias("created_ms"))


@query("workspace_writes", "SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'w' || n_nationkey ELSE n_name END AS name, n_nationkey::BIGINT AS created_ms, n_nationkey = 7 AS active FROM nation WHERE n_nationkey <> 3")
def _(s, d):
    w = _workspaces(s, d)
    fresh = w.where("created_ms % 5 = 0").withColumns({"name": F.concat(F.lit("w"), "id"), "created_ms": F.lit(99).cast("long")})
    left, state = store.delete_workspaces(store.save_workspaces(w, fresh), s.sql("SELECT '7' AS active_id"), s.sql("SELECT '3' AS id"))
    return store.active_workspace(left, state).select("id", "name", "created_ms", "active")


@query("workspace_delete_active", "SELECT count(*)::BIGINT AS n, 0::BIGINT AS active FROM nation WHERE n_nationkey <> 3")
def _(s, d):
    left, state = store.delete_workspaces(_workspaces(s, d), s.sql("SELECT '3' AS active_id"), s.sql("SELECT '3' AS id"))
    return store.active_workspace(left, state).agg(F.count("*").alias("n"), F.count_if("active").alias("active"))


@query("message_append", o("messages", "SELECT conv_id, seq, content FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS seq, content FROM v_messages)"))
def _(s, d):
    from pyspark.sql.window import Window

    m = v.messages(s, d).select(F.col("conv_id").alias("conversation_id"), F.col("seq").alias("at"), F.concat("conv_id", F.lit("-"), "seq").alias("id"), "content").withColumn("k", F.row_number().over(Window.partitionBy("conversation_id").orderBy("at")) - 1)
    held = m.where("k < 2").select("conversation_id", F.col("k").cast("long").alias("seq"), "id", "content")
    return store.append_messages(held, m.where("k >= 2").drop("k")).select(F.col("conversation_id").alias("conv_id"), "seq", "content")


@query("identity_report", o("nodes", "SELECT count(*) FILTER (id % 5 <> 0)::BIGINT AS before, count(*) FILTER (id % 7 <> 0)::BIGINT AS after, count(*) FILTER (id % 5 <> 0 AND id % 7 <> 0 AND id % 2 = 0)::BIGINT AS rekeyed, count(*) FILTER (id % 5 <> 0 AND id % 7 = 0)::BIGINT AS orphaned, count(*) FILTER (id % 5 = 0 AND id % 7 <> 0)::BIGINT AS \"new\" FROM v_nodes"))
def _(s, d):
    n = v.nodes(s, d).select("id", "source_path")
    return store.identity_report(n.where("id % 5 <> 0"), n.where("id % 7 <> 0").withColumn("source_path", F.when(F.col("id") % 2 == 0, F.concat("source_path", F.lit("::x"))).otherwise(F.col("source_path"))))


@query("keys_of_file", o("nodes", "SELECT 'docs/' || (id % 4) || '.md' AS file, 'docs/' || (id % 4) || '.md' || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '::f' || id ELSE ':' || id || '-' || (id + 4) END AS source_path FROM v_nodes WHERE id % 4 < 2 GROUP BY ALL"))
def _(s, d):
    return store.keys_of_file(_parts(s, d), s.sql("SELECT explode(array('docs/0.md', 'docs/1.md', 'docs/9.md')) AS file"))


def _parts(s, d):
    k = F.col("id")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("::f"), k)).otherwise(F.concat(F.lit(":"), k, F.lit("-"), k + 4))
    return v.nodes(s, d).withColumn("source_path", F.concat(F.lit("docs/"), k % 4, F.lit(".md"), tail))


@query("legacy_units", o("nodes", "SELECT id FROM v_nodes WHERE id % 4 = 1 AND id % 3 = 2 AND type = 'plan_doc' AND id % 2 = 1"))
def _(s, d):
    n = _parts(s, d).withColumn("name", F.when(F.col("id") % 2 == 1, "odd").otherwise("even"))
    return store.legacy_units(n, "docs/1.md", "plan_doc", "odd").select("id")


@query("chunk_fetch", o("chunks", "SELECT node_id, embedding[1]::DOUBLE AS first FROM v_chunks WHERE node_id % 3 = 0"))
def _(s, d):
    from quillon.operators import joins

    c = v.chunks(s, d).withColumn("chunk_idx", F.lit(0))
    wanted = c.where("node_id % 3 = 0").select("node_id", "chunk_idx")
    return joins.values_join(wanted.unionByName(wanted).unionByName(c.select("node_id", F.lit(4).alias("chunk_idx"))), c).select("node_id", F.col("embedding")[0].cast("double").alias("first"))


@query("finding_labels", o("nodes", "SELECT id::VARCHAR AS node_id, name, type FROM v_nodes WHERE id % 12 IN (1, 2)"))
def _(s, d):
    n = v.nodes(s, d)
    findings = n.where("id % 12 = 1").select(F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string"), F.lit("gone")).alias("node_ids"))
    return store.finding_labels(findings.unionByName(findings).unionByName(n.where("id % 12 = 2").select(F.array(F.col("id").cast("string")).alias("node_ids"))), n).drop("source_path")


@query("auto_scope", o("nodes", f"""WITH {_SRC}, c AS (SELECT id AS caller, CASE id % 3 WHEN 0 THEN 'docs/src' || (id % 40) WHEN 1 THEN 'docs' ELSE 'docs/src' || (id % 40) || '/p' || id || '/deep/' END AS cwd FROM v_nodes),
own AS (SELECT DISTINCT project_key FROM v_nodes WHERE project_key IS NOT NULL)
SELECT DISTINCT caller, project_key FROM c JOIN s ON rtrim(lower(cwd), '/') = lower(path) OR starts_with(lower(path), rtrim(lower(cwd), '/') || '/') OR starts_with(rtrim(lower(cwd), '/'), lower(path) || '/') WHERE project_key IN (SELECT project_key FROM own)"""))
def _(s, d):
    k = F.col("id")
    cwd = F.when(k % 3 == 0, F.concat(F.lit("docs/src"), k % 40)).when(k % 3 == 1, "docs").otherwise(F.concat(F.lit("docs/src"), k % 40, F.lit("/p"), k, F.lit("/deep/")))
    n = v.nodes(s, d)
    return store.scope_of(n.select(k.alias("caller"), cwd.alias("cwd")), _sources(s, d), n)


@query("effective_scope", o("nodes", f"""WITH {_SRC}, own AS (SELECT DISTINCT project_key FROM v_nodes WHERE project_key IS NOT NULL), f AS (SELECT list_sort(list(DISTINCT project_key)) AS keys FROM s WHERE path = 'docs/src2' OR starts_with(path, 'docs/src2/') AND project_key IS NOT NULL AND project_key IN (SELECT project_key FROM own)),
g AS (SELECT list_sort(list(DISTINCT project_key)) AS keys FROM s WHERE (path = 'docs/src2' OR starts_with(path, 'docs/src2/')) AND project_key IN (SELECT project_key FROM own))
SELECT id AS request, CASE id % 4 WHEN 0 THEN 'mine' WHEN 1 THEN 'older' WHEN 2 THEN array_to_string((SELECT keys FROM g), ',') ELSE 'src1' END AS project_keys FROM v_nodes"""))
def _(s, d):
    k = F.col("id")
    r = v.nodes(s, d).select(k.alias("request"), F.when(k % 4 == 0, "mine").alias("project_key"), F.when(k % 4 < 2, "older").alias("active_project"), F.when(k % 4 == 2, "docs/src2/").alias("cwd"))
    out = tools.effective_scope(r, _sources(s, d), v.nodes(s, d), _workspaces(s, d), s.sql("SELECT '1' AS active_id"), s.sql("SELECT 'last' AS project_key"))
    return out.select("request", F.array_join("project_keys", ",").alias("project_keys"))


@query("fix_preview", o("nodes", "SELECT id, CASE WHEN id % 3 = 0 THEN 'a [ref:1]c' ELSE 'a [ref:1] [ref:' || md5(id::VARCHAR) || ']c' END AS after, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'unsupported' ELSE 'no_longer_orphaned' END AS reason FROM v_nodes"))
def _(s, d):
    """Dead citations go with the blank before them; other kinds of findings, and targets that are there again, are left."""
    n, f = _cited(s, d)
    return store.fix_preview(f, n).select(F.col("fingerprint").cast("long").alias("id"), "after", "reason")


def _cited(s, d):
    k = F.col("id")
    dead = F.md5(k.cast("string").cast("binary"))
    n = v.nodes(s, d).select(k.cast("string").alias("id"), F.concat(F.lit("a [ref:1] [ref:"), dead, F.lit("]c")).alias("body"), F.lit(1).cast("long").alias("updated_at"))
    back = v.nodes(s, d).where("id % 3 = 2").select(dead.alias("id"), F.lit("").alias("body"), F.lit(1).cast("long").alias("updated_at"))
    kind = F.when(k % 3 == 1, "stale").otherwise("orphan_reference")
    return n.unionByName(back), v.nodes(s, d).select(k.cast("string").alias("fingerprint"), kind.alias("type"), F.array(k.cast("string")).alias("node_ids"), dead.alias("locus"), F.lit("open").alias("status"))


@query("fix_apply", o("nodes", "SELECT id, CASE WHEN id % 6 = 0 THEN 'a [ref:1]c' ELSE 'a [ref:1] [ref:' || md5(id::VARCHAR) || ']c' END AS body, CASE WHEN id % 6 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 3 = 0 THEN 'stale' WHEN id % 3 = 1 THEN 'unsupported' ELSE 'no_longer_orphaned' END AS reason FROM v_nodes"))
def _(s, d):
    """Only bodies that still are as they were in the preview are written."""
    n, f = _cited(s, d)
    seen = store.fix_preview(f, n).select("fingerprint", F.when(F.col("fingerprint").cast("long") % 2 == 0, F.col("body_hash")).otherwise("another").alias("body_hash"))
    made, queue, said = store.apply_fixes(seen, f, n, 50)
    return queue.join(said, "fingerprint").join(made.select(F.col("id").alias("fingerprint"), "body"), "fingerprint").select(F.col("fingerprint").cast("long").alias("id"), "body", "status", "reason")


def _audit_tables(s, d):
    k = F.col("id")
    kind = F.when(k % 4 == 0, "code_class").when(k % 4 == 1, "code_module").when(k % 4 == 2, "code_function").otherwise("code_method")
    name = F.concat(F.when(k % 5 == 0, "_f").otherwise("f"), k)
    body = F.concat(F.lit("uses known_concept_"), k % 6, F.lit("_name and lost_concept_"), k % 6, F.lit("_name [ref:"), k + 1, F.lit("]"), F.when(k % 13 == 0, " SUPERSEDED").otherwise(""))
    n = v.nodes(s, d).select("id", kind.alias("type"), name.alias("name"), F.concat(F.lit("has known_concept_"), k % 6, F.lit("_name")).alias("description"), body.alias("body"), "source_path", "project_key")
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return {"nodes": n, "edges": _edges(s, d), "vectors": vectors}


@query("audit_report", o("nodes code_edges", f"""WITH {_E} SELECT type, n, (SELECT count(*) FROM v_nodes)::BIGINT AS scanned FROM (SELECT 'stale' AS type, count(*)::BIGINT AS n FROM v_nodes WHERE id % 13 = 0
UNION ALL SELECT 'orphan_references', count(*)::BIGINT FROM v_nodes WHERE id + 1 NOT IN (SELECT id FROM v_nodes)) WHERE n > 0"""))
def _(s, d):
    """The suite without vectors and concepts."""
    tables = _audit_tables(s, d)
    return analysis.report(tables, analysis.analyze(tables, ("stale", "orphan_references", "dead_code")))


@query("audit_concepts", o("nodes", "SELECT id, 'lost_concept_' || (id % 6) || '_name' AS concept FROM v_nodes"))
def _(s, d):
    return analysis.analyze(_audit_tables(s, d), ("semantic_orphans",)).select(F.col("node_ids")[0].cast("long").alias("id"), F.col("locus").alias("concept"))


@query("audit_code_lens", o("nodes code_edges", f"""WITH {_E}, r(id, t) AS (SELECT src, dst FROM e WHERE relation = 'imports' UNION SELECT r.id, e.dst FROM r JOIN e ON r.t = e.src AND e.relation = 'imports'), c AS (SELECT a.id, min(a.t) AS cycle FROM r a JOIN r b ON a.id = b.t AND a.t = b.id GROUP BY a.id)
SELECT 'dead_code' AS type, id::VARCHAR AS ids FROM v_nodes WHERE id % 4 IN (2, 3) AND id % 5 = 0 AND id NOT IN (SELECT dst FROM e WHERE relation = 'calls')
UNION ALL SELECT 'cyclic_import', string_agg(id::VARCHAR, ',' ORDER BY id) FROM c GROUP BY cycle""", True))
def _(s, d):
    """The code lens in place of the suite; classes and modules here have too few members to be reported, and bodies are too short to count as copies."""
    return analysis.analyze(_audit_tables(s, d), lens="code").select("type", F.array_join("node_ids", ",").alias("ids"))


@query("audit_proactive", o("nodes", "SELECT change, count(*)::BIGINT AS n FROM (SELECT CASE WHEN id % 26 = 0 THEN 'unchanged' ELSE 'new' END AS change FROM v_nodes WHERE id % 13 = 0 UNION ALL SELECT 'new' FROM v_nodes WHERE id + 1 NOT IN (SELECT id FROM v_nodes) UNION ALL SELECT 'resolved') GROUP BY change"))
def _(s, d):
    tables = _audit_tables(s, d)
    found = analysis.analyze(tables, ("stale",))
    held = found.where("CAST(node_ids[0] AS BIGINT) % 26 = 0")
    gone = held.limit(1).withColumns({"fingerprint": F.lit("gone"), "node_ids": F.array(F.lit("x"))})
    queue = held.unionByName(gone).withColumns({"status": F.lit("open"), "first_seen": F.lit(1).cast("long"), "last_seen": F.lit(1).cast("long")})
    return analysis.proactive(tables, queue, 9).groupBy("change").agg(F.count("*").alias("n"))


@query("finding_status", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'dismissed' ELSE 'open' END AS status FROM supplier")
def _(s, d):
    q = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("f"), "s_suppkey").alias("fingerprint"), F.lit("open").alias("status"))
    return store.set_status(q, q.where("k % 3 = 0").select("fingerprint", F.lit("dismissed").alias("status"))).select("k", "status")


@query("tool_queue_page", "SELECT fingerprint, severity, n_open, n_dismissed, n_resolved FROM (SELECT 'f' || s_suppkey AS fingerprint, CASE s_suppkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'candidate' ELSE 'odd' END AS severity, s_suppkey % 5 AS r, s_suppkey % 3 AS st, s_suppkey % 4 AS seen FROM supplier), (SELECT count(*) FILTER (s_suppkey % 3 = 0)::BIGINT AS n_open, count(*) FILTER (s_suppkey % 3 = 1)::BIGINT AS n_dismissed, count(*) FILTER (s_suppkey % 3 = 2)::BIGINT AS n_resolved FROM supplier) WHERE st = 0 ORDER BY r, seen DESC, fingerprint LIMIT 12")
def _(s, d):
    k = F.col("s_suppkey")
    severity = F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").when(k % 5 == 2, "low").when(k % 5 == 3, "candidate").otherwise("odd")
    status = F.when(k % 3 == 0, "open").when(k % 3 == 1, "dismissed").otherwise("resolved")
    q = table(s, d, "supplier").select(F.concat(F.lit("f"), k).alias("fingerprint"), severity.alias("severity"), status.alias("status"), (k % 4).alias("last_seen"))
    return tools.queue_page(q, "open", 12).select("fingerprint", "severity", "n_open", "n_dismissed", "n_resolved")


@query("tool_get_node", o("nodes", "SELECT id, name FROM v_nodes WHERE id % 7 = 1"))
def _(s, d):
    n = v.nodes(s, d).drop("body")
    return tools.node_json(n, n.where("id % 7 = 1").select("id")).select("id", F.get_json_object("json", "$.name").alias("name"))


@query("tool_get_edges", o("code_edges", f"WITH {_E} SELECT src AS id, 'out' AS direction, dst AS other, relation FROM e WHERE src % 11 = 1 AND relation = 'calls' UNION ALL SELECT dst, 'in', src, relation FROM e WHERE dst % 11 = 1 AND relation = 'calls'"))
def _(s, d):
    e = _edges(s, d)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).where("id % 11 = 1")
    return tools.edges_of(e, ids, "both", "calls")


@query("tool_session_nodes", o("messages code_edges nodes", """WITH m AS (SELECT conv_id, seq, (conv_id * 3 + seq) % 150 AS a, (conv_id + seq) % 90 AS b FROM v_messages), own AS (SELECT DISTINCT conv_id, x::VARCHAR AS id FROM (SELECT conv_id, a AS x FROM m UNION SELECT conv_id, b FROM m) WHERE x IN (SELECT id FROM v_nodes)),
near AS (SELECT DISTINCT o.conv_id, u.t::VARCHAR AS id FROM own o JOIN (SELECT src AS f, dst AS t FROM v_code_edges UNION SELECT dst, src FROM v_code_edges) u ON o.id = u.f::VARCHAR WHERE u.t IN (SELECT id FROM v_nodes))
SELECT conv_id, id, 'cited' AS role FROM own UNION ALL SELECT conv_id, id, 'neighbour' FROM near WHERE (conv_id, id) NOT IN (SELECT conv_id, id FROM own)"""))
def _(s, d):
    """Citations in texts, and ids in the arguments of calls."""
    text = F.concat(F.lit("see [ref:"), (F.col("conv_id") * 3 + F.col("seq")) % 150, F.lit('] and {"node_id": "'), (F.col("conv_id") + F.col("seq")) % 90, F.lit('"}'))
    return tools.session_nodes(v.messages(s, d).select("conv_id", text.alias("content")), v.code_edges(s, d), v.nodes(s, d))


@query("tool_traverse", o("code_edges", f"WITH {_E}, u AS (SELECT src, dst FROM e WHERE relation <> 'defines' UNION SELECT dst, src FROM e WHERE relation <> 'defines'), b(id, hop) AS (SELECT 2::BIGINT, 0 UNION SELECT u.dst, b.hop + 1 FROM b JOIN u ON b.id = u.src WHERE b.hop < 3), h AS (SELECT id, min(hop) AS hop FROM b GROUP BY id) SELECT DISTINCT src, dst, relation FROM e WHERE relation <> 'defines' AND (src IN (SELECT id FROM h WHERE hop < 3) OR dst IN (SELECT id FROM h WHERE hop < 3))", True))
def _(s, d):
    """The edges that a walk of three hops goes over."""
    return graph.traverse(_edges(s, d), s.sql("SELECT CAST(2 AS BIGINT) AS id"), 3, ("calls", "imports", "method_of", "references_function"))[1]


@query("traverse_order", o("code_edges", "WITH u AS (SELECT src, dst FROM v_code_edges UNION SELECT dst, src FROM v_code_edges), b(id, hop) AS (SELECT 2::BIGINT, 0 UNION SELECT u.dst, b.hop + 1 FROM b JOIN u ON b.id = u.src WHERE b.hop < 4) SELECT id, min(hop)::INTEGER AS hop FROM b GROUP BY id ORDER BY hop, id LIMIT 12", True))
def _(s, d):
    return graph.traverse(_edges(s, d), s.sql("SELECT CAST(2 AS BIGINT) AS id"), 4)[0].limit(12)


@query("graph_scope_edges", o("nodes code_edges", "WITH i AS (SELECT id FROM v_nodes WHERE project_key IN ('src1', 'src2') OR base), t AS (SELECT id FROM v_nodes WHERE project_key IS NULL AND (id IN (SELECT src FROM v_code_edges WHERE dst IN (SELECT id FROM i)) OR id IN (SELECT dst FROM v_code_edges WHERE src IN (SELECT id FROM i)))), a AS (SELECT id FROM i UNION SELECT id FROM t) SELECT src, dst FROM v_code_edges WHERE src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a)"))
def _(s, d):
    return tools.graph_data(v.nodes(s, d), v.code_edges(s, d), F.col("project_key").isin("src1", "src2") | F.col("base"))[1]


@query("scope_filters", o("nodes", "SELECT 'all' AS scope, count(*)::BIGINT AS n FROM v_nodes UNION ALL SELECT 'base_only', count(*)::BIGINT FROM v_nodes WHERE base UNION ALL SELECT 'project', count(*)::BIGINT FROM v_nodes WHERE project_key = 'src3' OR base UNION ALL SELECT 'keys', count(*)::BIGINT FROM v_nodes WHERE project_key IN ('src1', 'src4') OR base"))
def _(s, d):
    cases = {"all": F.lit(True), "base_only": F.col("base"), "project": (F.col("project_key") == "src3") | F.col("base"), "keys": F.col("project_key").isin("src1", "src4") | F.col("base")}
    held = v.nodes(s, d).select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in cases.items()]))).alias("scope"))
    return held.groupBy("scope").agg(F.count("*").alias("n"))


@query("sitemap", "SELECT 'endpoint:' || m || ':/p' || k AS endpoint, m AS method, '/p' || k AS path, string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id::VARCHAR) AS routes, string_agg(DISTINCT h::VARCHAR, ',' ORDER BY h::VARCHAR) AS handlers FROM (SELECT s_suppkey % 6 AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS m, s_suppkey AS id, s_suppkey + 1000 AS h FROM supplier) GROUP BY k, m ORDER BY path, method")
def _(s, d):
    """Routes with their handlers, by path and method."""
    k = F.col("s_suppkey")
    routes = table(s, d, "supplier").select(k.alias("id"), F.when(k % 2 == 0, "get").otherwise("post").alias("method"), F.concat(F.lit("/p"), k % 6).alias("path"))
    return tools.sitemap(routes, routes.where("false"), routes.select(F.col("id").alias("src"), (F.col("id") + 1000).alias("dst"))).drop("components")


@query("project_modules", o("members", "SELECT 'p' || (module % 3) AS project_key, 'm' || module AS module, count(*)::BIGINT AS n, string_agg('f' || symbol, ',' ORDER BY 'f' || symbol) AS declarations FROM v_members WHERE symbol % 9 = 0 GROUP BY module"))
def _(s, d):
    m = v.members(s, d).where("symbol % 9 = 0").select(F.col("module").alias("src"), F.col("symbol").alias("dst"), F.concat(F.lit("f"), "symbol").alias("name"))
    modules = m.select(F.col("src").alias("id")).distinct().select("id", F.concat(F.lit("m"), "id").alias("name"), F.concat(F.lit("p"), F.col("id") % 3).alias("project_key"))
    return tools.project_modules(m, modules).select("project_key", "module", "n", F.array_join("declarations", ",").alias("declarations"))


@query("dashboard", o("nodes code_edges query_log feedback", "SELECT 'type' AS what, type AS key, count(*)::BIGINT AS n FROM v_nodes GROUP BY type UNION ALL SELECT 'degree', id::VARCHAR, n FROM (SELECT id, count(*)::BIGINT AS n FROM (SELECT src AS id FROM v_code_edges UNION ALL SELECT dst FROM v_code_edges) GROUP BY id ORDER BY n DESC, id LIMIT 6) UNION ALL SELECT 'total', 'edges', count(*)::BIGINT FROM v_code_edges UNION ALL SELECT 'total', 'queries', count(*)::BIGINT FROM v_query_log UNION ALL SELECT 'total', 'thumbs_up', count(*) FILTER (reason = 'thumbs_up')::BIGINT FROM v_feedback"))
def _(s, d):
    return tools.dashboard(v.nodes(s, d), v.code_edges(s, d), v.query_log(s, d), v.feedback(s, d))


@query("nodes_page_bounds", o("nodes", "SELECT id, (SELECT count(*) FROM v_nodes)::BIGINT AS total, false AS has_next FROM v_nodes ORDER BY updated_at DESC, id LIMIT 20 OFFSET (SELECT (ceil(count(*) / 20) - 1) * 20 FROM v_nodes)::BIGINT"))
def _(s, d):
    """A page that lies beyond the end is the last one."""
    n = v.nodes(s, d)
    total = n.count()
    p = tools.page_of(total, 10**9, 20)
    return n.orderBy(F.desc("updated_at"), "id").offset(p["offset"]).limit(p["limit"]).select("id", F.lit(total).cast("long").alias("total"), F.lit(p["has_next"]).alias("has_next"))


@query("path_suggest", o("nodes", "WITH a AS (SELECT DISTINCT 'docs/' || split_part(source_path, '/', 2) AS path FROM v_nodes) SELECT 'docs/SRC1' AS prefix, path FROM a WHERE starts_with(path, 'docs/src1') UNION ALL SELECT 'doc', 'docs'"))
def _(s, d):
    return tools.suggestions(v.nodes(s, d).select(F.col("source_path").alias("path")), s.sql("SELECT explode(array('docs/SRC1', 'doc')) AS prefix"))


@query("full_source", o("nodes", "SELECT id, CASE WHEN id % 4 < 3 THEN 'text ' || (id % 4) END AS text FROM v_nodes"))
def _(s, d):
    return tools.full_source(_parts(s, d), s.range(3).select(F.concat(F.lit("docs/"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("text "), "id").alias("text")))


@query("repo_keys", o("nodes", "SELECT id, CASE id % 3 WHEN 0 THEN 'src/a' || id || '.py::f' WHEN 1 THEN substr('abcdef0123456789' || id, 1, 13) ELSE 'n' || id END AS key, CASE id % 3 WHEN 0 THEN '/home/u/src/a' || id || '.py::f' WHEN 1 THEN 'repo@abcdef0123456789' || id ELSE 'docs/n' || id || '.md' END AS plain FROM v_nodes"))
def _(s, d):
    k = F.col("id")
    path = F.when(k % 3 == 0, F.concat(F.lit("\\home\\u\\src\\a"), k, F.lit(".py::f"))).when(k % 3 == 1, F.concat(F.lit("repo@abcdef0123456789"), k)).otherwise(F.concat(F.lit("docs/n"), k, F.lit(".md:3-9")))
    cut = F.regexp_replace(path, ":[0-9]+-[0-9]+$", "")
    return v.nodes(s, d).select("id", tools.repo_key(cut).alias("key"), tools.plain_path(path).alias("plain"))


@query("key_resolver", o("nodes", "SELECT k AS key, arg_min(id, (length(source_path), id)) AS id FROM (SELECT DISTINCT (id % 9) || '.MD' AS k FROM v_nodes) JOIN v_nodes ON lower(source_path) = lower(k) OR ends_with(lower(source_path), '/' || lower(k)) GROUP BY k"))
def _(s, d):
    n = v.nodes(s, d)
    return tools.resolved_keys(n.select(F.concat(F.col("id") % 9, F.lit(".MD")).alias("key")).distinct(), n)


@query("oracle_solver", o("nodes code_edges", f"WITH {_E} SELECT DISTINCT 's' || e.dst AS task, n.id::VARCHAR AS key FROM e JOIN v_nodes n ON n.id = e.src WHERE relation = 'calls' UNION ALL SELECT DISTINCT 'p' || dst, x::VARCHAR FROM (SELECT dst, src AS x FROM e WHERE relation = 'references_function' AND src IN (SELECT id FROM v_nodes) UNION SELECT dst, src + 1 FROM e WHERE relation = 'references_function' AND src + 1 IN (SELECT id FROM v_nodes))"))
def _(s, d):
    """Callers; and commits with the memories that moved them."""
    n = v.nodes(s, d)
    e = _edges(s, d)
    motivated = e.where("relation = 'references_function'").select("src", (F.col("src") + 1).alias("dst"), F.lit("motivated_by").alias("relation")).distinct()
    subjects = lambda cls, mark, relation: e.where(F.col("relation") == relation).select(F.concat(F.lit(mark), "dst").alias("task"), F.lit(cls).alias("cls"), F.col("dst").alias("subject")).distinct()
    tasks = subjects("structural", "s", "calls").unionByName(subjects("provenance", "p", "references_function"))
    return tools.solved(tasks, n, e.unionByName(motivated)).select("task", "key")


@query("query_types", "SELECT item_id, CASE WHEN item_id % 4 = 1 THEN 'conceptual' ELSE 'lexical' END AS query_type, item_id % 3 = 0 AS loopback FROM benchmark")
def _(s, d):
    k = F.col("item_id")
    said = F.when(k % 4 == 0, "Lexical").when(k % 4 == 1, " CONCEPTUAL").when(k % 4 == 2, "odd")
    host = F.when(k % 3 == 0, "LocalHost").when(k % 3 == 1, "10.0.0.1")
    return table(s, d, "benchmark").select("item_id", feedback.query_type(said).alias("query_type"), tools.is_loopback(host).alias("loopback"))


@query("reciprocal_lexical", o("nodes", "SELECT id, round(greatest((id % 4) / 4, CASE WHEN id % 3 > 0 THEN 1.0::DOUBLE / (1 + id % 5) ELSE 0 END), 6)::DOUBLE AS lexical FROM v_nodes"))
def _(s, d):
    from quillon.plans import retrieve

    k = F.col("id")
    return v.nodes(s, d).select("id", F.round(retrieve.reciprocal_rank((k % 4) / 4, F.when(k % 3 > 0, k % 5)), 6).alias("lexical"))


@query("billing_sorted", o("usage", "SELECT c_name AS name, coalesce(queries, 0)::BIGINT AS queries FROM customer LEFT JOIN (SELECT * FROM v_usage WHERE period = '1996-03') ON c_custkey = api_key_id ORDER BY c_name, c_custkey LIMIT 30"))
def _(s, d):
    """The first page of the billing table, by name and id."""
    keys = table(s, d, "customer").select(F.col("c_custkey").alias("api_key_id"), F.col("c_name").alias("name"))
    j = keys.join(v.usage(s, d).where("period = '1996-03'"), "api_key_id", "left")
    return j.orderBy("name", "api_key_id").limit(30).select("name", F.coalesce("queries", F.lit(0)).cast("long").alias("queries"))


@query("suite_types", """WITH a AS (SELECT c_custkey AS ask, CASE c_custkey % 4 WHEN 1 THEN 'code' WHEN 2 THEN 'law' END AS lens, CASE c_custkey % 3 WHEN 1 THEN ['stale', 'dead_code', 'none'] WHEN 2 THEN ['semantic_orphans', 'duplicates', 'duplicate_code'] END AS types FROM customer)
SELECT ask, array_to_string(list_filter(CASE WHEN lens IS NULL THEN ['stale', 'duplicates', 'orphan_references', 'contradictions', 'semantic_orphans'] WHEN lens = 'code' THEN ['dead_code', 'god_object', 'cyclic_imports', 'duplicate_code'] ELSE [] END, lambda x: types IS NULL OR list_contains(types, x)), ',') AS run FROM a""")
def _(s, d):
    """Requests of a lens and types; what each of them runs, in the suite's order."""
    k = F.col("c_custkey")
    types = F.when(k % 3 == 1, F.array(*map(F.lit, ("stale", "dead_code", "none")))).when(k % 3 == 2, F.array(*map(F.lit, ("semantic_orphans", "duplicates", "duplicate_code"))))
    asks = table(s, d, "customer").select(k.alias("ask"), F.when(k % 4 == 1, "code").when(k % 4 == 2, "law").alias("lens"), types.alias("types"))
    return asks.select("ask", F.array_join(analysis.chosen(F.col("lens"), F.col("types")), ",").alias("run"))


@query("source_proposals", o("files", "WITH c AS (SELECT count(*) FILTER (page_id % 3 = 0) AS docs, count(*) FILTER (page_id % 3 = 1) AS code FROM pages) SELECT 'docs_dir' AS kind, docs::BIGINT AS n, docs::BIGINT AS est_nodes, docs + code > 6000 AS large FROM c WHERE docs >= 3 UNION ALL SELECT 'code_repo', code::BIGINT, floor(code * 2.5)::BIGINT, docs + code > 6000 FROM c WHERE code >= 10"))
def _(s, d):
    from quillon.sources.files import LANGUAGES

    k = F.col("page_id")
    f = table(s, d, "pages").select(F.when(k % 3 == 0, F.concat(F.lit("a/"), k, F.lit(".md"))).when(k % 3 == 1, F.concat(F.lit("b/"), k, F.lit(".py"))).otherwise(F.concat(F.lit("node_modules/"), k, F.lit(".js"))).alias("path"))
    return settings.proposals(f, tuple(LANGUAGES))


@query("ignore_merge", """SELECT 'd' || page_id || '/s' AS folder, k::INTEGER AS k, line FROM pages, (VALUES (0), (1), (2)) x(k), LATERAL (SELECT CASE k WHEN 0 THEN 'd' || page_id || '/s/tmp' || page_id || '/' WHEN 1 THEN '!d' || page_id || '/s/keep' ELSE 'd' || page_id || '/s/x' END AS line) WHERE page_id % 5 <> 0
UNION ALL SELECT '', 0, '*.log' UNION ALL SELECT '', 1, '/build'""")
def _(s, d):
    """An ignore file in each page's folder, some of them in folders that are not read, and one at the root."""
    k = F.col("page_id")
    own = table(s, d, "pages").select(F.concat(F.when(k % 5 == 0, "node_modules/d").otherwise("d"), k, F.lit("/s/.gitignore")).alias("path"), F.concat(F.lit("tmp"), k, F.lit("/\n# note\n!keep\n\n /x \r\n")).alias("text"))
    return settings.ignore_lines(own.unionByName(s.createDataFrame([(".gitignore", "*.log\n# c\n\n/build\n"), ("d1/a.py", "x")], "path string, text string")))


@query("discovered_sources", "SELECT '/h/projects/p' || (page_id // 4) || '/memory' AS path, 'memory_dir' AS kind, 'p' || (page_id // 4) AS project_key FROM pages WHERE page_id % 3 = 0 GROUP BY ALL UNION ALL SELECT '/h/CLAUDE.md', 'claude_md', NULL")
def _(s, d):
    """Files of a home folder: notes of projects in and beside their memory folders."""
    k = F.col("page_id")
    own = F.concat(F.lit("/h/projects/p"), F.floor(k / 4).cast("long"), F.when(k % 3 == 0, "/memory/d/").otherwise("/other/"), k, F.lit(".md"))
    return settings.discovered(table(s, d, "pages").select(F.explode(F.array(own, F.concat(F.lit("/h/x"), k, F.lit("/CLAUDE.md")), F.lit("/h/CLAUDE.md"))).alias("path")), "/h/")


@query("session_counts", o("query_log", "SELECT actor::VARCHAR AS session_id, arg_max(id, at_s * 1000000 + id) AS n FROM v_query_log WHERE at_s > (SELECT max(at_s) FROM v_query_log) - 86400 GROUP BY actor"))
def _(s, d):
    q = v.query_log(s, d)
    now = q.agg(F.max("at_s")).first()[0]
    # A day is cut by the seconds: an id of a million or more reaches into the next ones.
    day = q.where(F.col("at_s") > now - 86_400)
    return settings.session_counts(day.select(F.col("actor").cast("string").alias("session_id"), F.col("id").alias("n"), (F.col("at_s") * 1_000_000 + F.col("id")).alias("at")), now * 1_000_000, 86_400_000_000)
