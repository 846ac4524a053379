"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.operators import joins
from quillon.session import table

o = v.oracle


@query("interval_overlap_refs", o("spans hunks", "SELECT h.commit_id, s.file, s.symbol, s.a, s.b, round(greatest(0.3, least(1.0, sum(least(s.b, h.b) - greatest(s.a, h.a) + 1) / greatest(1, s.b - s.a + 1))), 6)::DOUBLE AS confidence FROM v_spans s JOIN v_hunks h ON s.file = h.file AND s.a <= h.b AND h.a <= s.b GROUP BY h.commit_id, s.file, s.symbol, s.a, s.b"))
def _(s, d):
    return joins.references(v.spans(s, d), v.hunks(s, d), digits=6)


@query("prefix_ownership", o("nodes", "SELECT n.id, p.path FROM v_nodes n JOIN (VALUES ('docs/src1'), ('docs/src12'), ('docs')) p(path) ON starts_with(n.source_path, p.path || '/') OR n.source_path = p.path"))
def _(s, d):
    return joins.owned(v.nodes(s, d), s.sql("SELECT explode(array('docs/src1', 'docs/src12', 'docs')) AS path"))


@query("unowned_nodes", o("nodes", "SELECT id FROM v_nodes WHERE NOT starts_with(source_path, 'docs/src1/') AND NOT starts_with(source_path, 'docs/src2/')"))
def _(s, d):
    return joins.unowned(v.nodes(s, d), s.sql("SELECT explode(array('docs/src1', 'docs/src2')) AS path")).select("id")


@query("word_containment", o("nodes", r"WITH w AS (SELECT item_id::VARCHAR AS name_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '')[1:3], ' ') AS name FROM benchmark UNION ALL VALUES ('-1', 'the'), ('-2', 'inthe'), ('-3', 'Die'), ('-4', 'the'), ('-5', '')), m AS MATERIALIZED (SELECT n.id AS text_id, w.name_id, w.name, n.body FROM v_nodes n JOIN w ON w.name <> '' AND contains(n.body, w.name)) SELECT DISTINCT text_id, name_id FROM m WHERE regexp_matches(body, '(^|[^\p{L}\p{N}_])' || regexp_escape(name) || '($|[^\p{L}\p{N}_])')"))
def _(s, d):
    """The first three words of each benchmark item, and some names of one word, in all nodes."""
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda x: x != "")
    names = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("name_id"), F.array_join(F.slice(words, 1, 3), " ").alias("name"))
    more = s.sql("SELECT CAST(k AS string) AS name_id, name FROM VALUES (-1, 'the'), (-2, 'inthe'), (-3, 'Die'), (-4, 'the'), (-5, '') AS t(k, name)")
    return joins.named_in(v.nodes(s, d).select(F.col("id").alias("text_id"), F.col("body").alias("text")), names.unionByName(more))


@query("trailer_join", o("nodes", "SELECT c.id AS commit_id, m.id AS memory FROM v_nodes c JOIN v_nodes m ON m.name = 'node_' || (c.id % 50)"))
def _(s, d):
    from quillon.functions.text import trailers

    n = v.nodes(s, d)
    c = n.select(F.col("id").alias("commit_id"), F.explode(trailers(F.concat(F.lit("x\nCloses: node_"), F.col("id") % 50))).alias("name"))
    return c.join(n.select(F.col("id").alias("memory"), "name"), "name").select("commit_id", "memory")


@query("call_resolution", o("code_edges members", """SELECT e.src AS caller, e.dst AS callee, 0.95::DOUBLE AS confidence FROM v_code_edges e WHERE e.src <> e.dst AND e.src // 50 = e.dst // 50 AND (e.src % 2 = 0 OR e.src // 10 = e.dst // 10)"""))
def _(s, d):
    """Symbols are methods of classes of ten and functions of modules of fifty; odd callers call by self, so only their own class answers."""
    e = v.code_edges(s, d)
    block, class_ = lambda c: F.floor(F.col(c) / 50).cast("long"), lambda c: F.concat(F.lit("K"), F.floor(F.col(c) / 10).cast("long"))
    ids = table(s, d, "part").select(F.col("p_partkey").alias("symbol")).unionByName(e.select(F.col("dst").alias("symbol"))).distinct().select("symbol", block("symbol").alias("module"), F.concat(F.lit("s"), "symbol").alias("name"))
    symbols = ids.withColumn("class", F.lit(None).cast("string")).unionByName(ids.withColumn("class", class_("symbol")))
    own = F.col("src") % 2 == 1
    calls = e.select(F.col("src").alias("caller"), block("src").alias("module"), F.when(own, class_("src")).alias("class"), F.when(own, "self").alias("receiver"), F.concat(F.lit("s"), "dst").alias("name"))
    return joins.resolve_calls(calls, symbols, s.sql("SELECT CAST(0 AS BIGINT) module, 'a' alias, CAST(0 AS BIGINT) target WHERE false"))


@query("call_resolution_imports", o("code_edges", "SELECT src AS caller, dst AS callee, 0.8::DOUBLE AS confidence FROM v_code_edges WHERE src <> dst"))
def _(s, d):
    e = v.code_edges(s, d)
    block = lambda c: F.floor(F.col(c) / 50).cast("long")
    symbols = e.select(F.col("dst").alias("symbol")).distinct().select("symbol", (block("symbol") + 1_000_000).alias("module"), F.lit(None).cast("string").alias("class"), F.concat(F.lit("s"), "symbol").alias("name"))
    calls = e.select(F.col("src").alias("caller"), block("src").alias("module"), F.lit(None).cast("string").alias("class"), F.lit("lib").alias("receiver"), F.concat(F.lit("s"), "dst").alias("name"))
    imports = calls.select("module").distinct().select("module", F.lit("lib").alias("alias"), (F.col("module") + 1_000_000).alias("target"))
    return joins.resolve_calls(calls, symbols, imports)


@query("cross_stack_join", o("", "SELECT 'endpoint:GET:/p' || k AS endpoint, coalesce(string_agg(DISTINCT CASE WHEN side = 'r' THEN id::VARCHAR END, ',' ORDER BY CASE WHEN side = 'r' THEN id::VARCHAR END), '') AS routes, coalesce(string_agg(DISTINCT CASE WHEN side = 'c' THEN id::VARCHAR END, ',' ORDER BY CASE WHEN side = 'c' THEN id::VARCHAR END), '') AS components FROM (SELECT s_suppkey % 20 AS k, s_suppkey AS id, 'r' AS side FROM supplier UNION ALL SELECT page_id % 20, page_id, 'c' FROM pages) GROUP BY k"))
def _(s, d):
    routes = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("get").alias("method"), F.concat(F.lit("/p"), F.col("s_suppkey") % 20).alias("path"))
    comps = table(s, d, "pages").select(F.col("page_id").alias("id"), F.lit("GET").alias("method"), F.concat(F.lit("/p"), F.col("page_id") % 20).alias("path"))
    none = routes.select(F.col("id").alias("src"), F.col("id").alias("dst")).where("false")
    return joins.endpoints(routes, comps, none).drop("handlers")


@query("provenance_walk", o("spans hunks", "WITH r AS (SELECT DISTINCT h.commit_id, s.symbol FROM v_spans s JOIN v_hunks h ON s.file = h.file AND s.a <= h.b AND h.a <= s.b) SELECT DISTINCT symbol, memory, via FROM (SELECT symbol, commit_id % 100 AS memory, 'motivated_by' AS via FROM r WHERE commit_id % 2 = 0 UNION ALL SELECT symbol, commit_id % 90, 'closed_by' FROM r WHERE commit_id % 3 = 0)"))
def _(s, d):
    c = v.hunks(s, d).select("commit_id").distinct()
    return joins.provenance_of(v.spans(s, d), v.hunks(s, d), c.where("commit_id % 2 = 0").select("commit_id", (F.col("commit_id") % 100).alias("memory")), c.where("commit_id % 3 = 0").select("commit_id", (F.col("commit_id") % 90).alias("memory")))


@query("reverse_callers", o("code_edges", "SELECT dst AS symbol, count(*)::BIGINT AS callers, string_agg(src::VARCHAR, ',' ORDER BY src::VARCHAR) AS ids FROM (SELECT DISTINCT src, dst FROM v_code_edges) GROUP BY dst HAVING count(*) BETWEEN 1 AND 4"))
def _(s, d):
    return joins.callers(v.code_edges(s, d))


@query("asof_freshness", o("query_log", "WITH st AS (SELECT actor AS session, id AS rule, at_s AS stamped_at FROM v_query_log WHERE kind = 'purchase'), tt AS (SELECT actor AS session, max(at_s) AS last FROM v_query_log WHERE kind = 'error' GROUP BY 1) SELECT session, rule, stamped_at >= coalesce(last, 0) AS fresh FROM st LEFT JOIN tt USING (session)"))
def _(s, d):
    q = v.query_log(s, d)
    st = q.where("kind = 'purchase'").select(F.col("actor").alias("session"), F.col("id").alias("rule"), F.col("at_s").alias("stamped_at"))
    return joins.fresh_evidence(st, q.where("kind = 'error'").select(F.col("actor").alias("session"), F.col("at_s").alias("touched_at")))


@query("nearest_line", o("spans hunks", "SELECT id, symbol FROM (SELECT h.commit_id AS id, s.symbol, row_number() OVER (PARTITION BY h.commit_id ORDER BY abs(h.a - s.a), s.symbol) AS k FROM v_hunks h JOIN v_spans s ON h.file = s.file) WHERE k = 1"))
def _(s, d):
    return joins.nearest(v.hunks(s, d).select(F.col("commit_id").alias("id"), "file", "a"), v.spans(s, d).select("symbol", "file", "a"), ["file"], "a")


@query("anti_unembedded", o("nodes chunks", "SELECT id FROM v_nodes WHERE id NOT IN (SELECT node_id FROM v_chunks)"))
def _(s, d):
    return joins.missing(v.nodes(s, d).select("id"), v.chunks(s, d).select(F.col("node_id").alias("id")), "id")


@query("embedding_coverage", o("nodes chunks", "SELECT count(*)::BIGINT AS total, count(*) FILTER (c.node_id IS NULL)::BIGINT AS unembedded FROM v_nodes n LEFT JOIN (SELECT DISTINCT node_id FROM v_chunks) c ON n.id = c.node_id"))
def _(s, d):
    c = v.chunks(s, d).select(F.col("node_id").alias("id")).distinct().withColumn("has", F.lit(1))
    return v.nodes(s, d).join(c, "id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("has").isNull()).alias("unembedded"))


@query("deletion_sweep", o("nodes", "SELECT id FROM v_nodes WHERE id % 8 = 3"))
def _(s, d):
    n = v.nodes(s, d)
    return joins.missing(n.select("id", "source_path"), n.where("id % 8 <> 3").select("source_path"), "source_path").select("id")


@query("session_neighbours", o("code_edges nodes", "WITH s AS (SELECT id FROM v_nodes WHERE id % 40 = 1) SELECT id FROM v_nodes WHERE id IN (SELECT dst FROM v_code_edges WHERE src IN (SELECT id FROM s) UNION SELECT src FROM v_code_edges WHERE dst IN (SELECT id FROM s)) AND id NOT IN (SELECT id FROM s)"))
def _(s, d):
    n = v.nodes(s, d)
    return joins.neighbours(v.code_edges(s, d), n.where("id % 40 = 1").select("id"), n.select("id"))


@query("boundary_null_projects", o("code_edges nodes", "SELECT DISTINCT n.id FROM v_nodes n JOIN v_code_edges e ON n.id = e.src OR n.id = e.dst JOIN v_nodes m ON m.id = CASE WHEN n.id = e.src THEN e.dst ELSE e.src END WHERE n.project_key IS NULL AND m.project_key IN ('src1', 'src2', 'src4')"))
def _(s, d):
    n = v.nodes(s, d).select("id", "project_key")
    e = v.code_edges(s, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    inside = n.where(F.col("project_key").isin("src1", "src2", "src4")).select(F.col("id").alias("dst"))
    return n.where("project_key IS NULL").join(both.join(inside, "dst", "left_semi").select(F.col("src").alias("id")), "id", "left_semi").select("id")
