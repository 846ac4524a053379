"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.operators import graph as g
from quillon.session import table

o = v.oracle


@query("degree_top", o("code_edges", "SELECT id, degree FROM (SELECT id, count(*)::BIGINT AS degree FROM (SELECT src AS id FROM v_code_edges UNION ALL SELECT dst FROM v_code_edges) GROUP BY id) ORDER BY degree DESC, id LIMIT 25"))
def _(s, d):
    return g.degree(v.code_edges(s, d)).orderBy(F.desc("degree"), "id").limit(25)


@query("incident_edges", o("code_edges", "SELECT src, dst FROM v_code_edges WHERE src % 30 = 4 OR dst % 30 = 4"))
def _(s, d):
    e = v.code_edges(s, d)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).where("id % 30 = 4").distinct()
    return g.incident(e, ids)


@query("co_occurrence_weights", o("retrievals", "SELECT a.node_id AS src, b.node_id AS dst, round(least(count(*) * 0.1, 5.0), 6)::DOUBLE AS weight FROM v_retrievals a JOIN v_retrievals b ON a.query_id = b.query_id AND a.node_id <> b.node_id GROUP BY ALL"))
def _(s, d):
    lines = table(s, d, "lineitem")
    return g.co_occurrence(lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("node_id")), rows=lines.count()).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("bfs_hops", o("code_edges", "WITH u AS (SELECT src, dst FROM v_code_edges UNION SELECT dst, src FROM v_code_edges), b(id, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT u.dst, b.hop + 1 FROM b JOIN u ON b.id = u.src WHERE b.hop < 4) SELECT id, min(hop)::INTEGER AS hop FROM b GROUP BY id", True))
def _(s, d):
    return g.bfs(v.code_edges(s, d), s.sql("SELECT CAST(1 AS BIGINT) AS id"), 4)


@query("ego_network", o("code_edges", "WITH u AS (SELECT src, dst FROM v_code_edges UNION SELECT dst, src FROM v_code_edges), b(id, hop) AS (SELECT 7::BIGINT, 0 UNION SELECT u.dst, b.hop + 1 FROM b JOIN u ON b.id = u.src WHERE b.hop < 2) SELECT src, dst FROM v_code_edges WHERE src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b)", True))
def _(s, d):
    return g.ego(v.code_edges(s, d), 7, 2)


@query("connected_components", o("code_edges", "WITH u AS (SELECT src, dst FROM v_code_edges UNION SELECT dst, src FROM v_code_edges), r(id, t) AS (SELECT src, src FROM u UNION SELECT r.id, u.dst FROM r JOIN u ON r.t = u.src) SELECT id, min(t) AS label FROM r GROUP BY id", True))
def _(s, d):
    return g.components(v.code_edges(s, d))


@query("import_cycles", o("code_edges", "WITH r(id, t) AS (SELECT src, dst FROM v_code_edges UNION SELECT r.id, e.dst FROM r JOIN v_code_edges e ON r.t = e.src) SELECT a.id, min(a.t) AS cycle FROM r a JOIN r b ON a.id = b.t AND a.t = b.id GROUP BY a.id", True))
def _(s, d):
    return g.cycles(v.code_edges(s, d))


@query("clean_edges", o("code_edges", "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM v_code_edges WHERE src <> dst"))
def _(s, d):
    return g.clean_edges(v.code_edges(s, d))


@query("endpoint_fanout", "SELECT path, count(*)::BIGINT AS n FROM (SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]*/([a-z]+)/', 1) AS path FROM pages) GROUP BY path")
def _(s, d):
    return table(s, d, "pages").select(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "://[^/]*/([a-z]+)/", 1).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query("hierarchy_rollup", "SELECT r_name, n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(s, d):
    c = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at every scale
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


_SIX = """e AS (SELECT src, dst, 'calls' AS relation FROM v_code_edges UNION ALL SELECT module + 1000000, symbol, 'defines' FROM v_members UNION ALL SELECT src, src // 10 + 2000000, 'method_of' FROM v_code_edges UNION ALL SELECT symbol % 5 + 3000000, symbol, 'routes_to' FROM v_members UNION ALL SELECT commit_id + 4000000, commit_id % 200, 'references_function' FROM v_hunks)"""


def _six(s, d):
    """Edges of every relation that a symbol's detail shows."""
    e, h = v.code_edges(s, d), v.hunks(s, d)
    m = table(s, d, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("symbol"))  # repeated rows go with the details
    made = lambda df, a, b, relation: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"), F.lit(relation).alias("relation"))
    return (
        made(e, F.col("src"), F.col("dst"), "calls").unionByName(made(m, F.col("module") + 1_000_000, F.col("symbol"), "defines")).unionByName(made(e, F.col("src"), F.floor(F.col("src") / 10) + 2_000_000, "method_of"))
        .unionByName(made(m.select("symbol").distinct(), F.col("symbol") % 5 + 3_000_000, F.col("symbol"), "routes_to")).unionByName(made(h, F.col("commit_id") + 4_000_000, F.col("commit_id") % 200, "references_function"))
    )


@query("symbol_ego_detail", o("code_edges members hunks", f"""WITH {_SIX}, s AS (SELECT src AS id FROM v_code_edges)
SELECT DISTINCT id, CASE relation WHEN 'calls' THEN 'callee' ELSE 'method_of' END AS role, dst AS other FROM e JOIN s ON src = id WHERE relation IN ('calls', 'method_of')
UNION SELECT DISTINCT id, CASE relation WHEN 'calls' THEN 'caller' WHEN 'defines' THEN 'defines_in' WHEN 'routes_to' THEN 'served_by' ELSE 'commit' END, src FROM e JOIN s ON dst = id WHERE relation IN ('calls', 'defines', 'routes_to', 'references_function')"""))
def _(s, d):
    """Callers, callees, modules, classes, routes and commits of every symbol that calls."""
    rows = 3 * table(s, d, "part").count() + 2 * table(s, d, "lineitem").count() + table(s, d, "orders").count()
    return g.symbol_detail(_six(s, d), v.code_edges(s, d).select(F.col("src").alias("id")), rows)


_N = "n AS (SELECT id, CASE WHEN id % 3 <> 0 THEN 'p' || (id % 4) END AS project_key, id % 25 = 0 AS base FROM (SELECT src AS id FROM v_code_edges UNION SELECT dst FROM v_code_edges))"


@query("ego_network_scoped", o("code_edges", f"""WITH {_N}, u AS (SELECT src, dst FROM v_code_edges UNION SELECT dst, src FROM v_code_edges), w(id, hop) AS (SELECT id, 0 FROM n WHERE id % 500 = 1 UNION SELECT u.dst, hop + 1 FROM w JOIN u ON w.id = u.src WHERE hop < 3), m AS (SELECT id, min(hop) AS hop FROM w GROUP BY id),
t AS (SELECT m.id, hop, project_key IS NOT NULL AND project_key IN ('p1', 'p2') OR base AS strict, project_key IS NULL AND NOT base AS loose FROM m JOIN n ON m.id = n.id)
SELECT id, hop::INTEGER AS hop, CASE WHEN strict THEN 'strict' ELSE 'boundary' END AS why FROM t WHERE strict OR loose AND EXISTS (SELECT 1 FROM u JOIN t x ON u.src = x.id WHERE u.dst = t.id AND x.strict)""", recursive=True))
def _(s, d):
    e = v.code_edges(s, d)
    k = F.col("id")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.when(k % 3 != 0, F.concat(F.lit("p"), k % 4)).alias("project_key"), (k % 25 == 0).alias("base"))
    return g.scoped_ego(e, nodes, nodes.where("id % 500 = 1"), 3, ["p1", "p2"])[0]


@query("graph_layout")
def _(s, d):
    return g.layout(v.code_edges(s, d))


@query("graph_fingerprint", o("code_edges", "SELECT sha1(string_agg(digest, ',' ORDER BY part) || '|' || (SELECT count(*) FROM v_code_edges) || '|layout-3') AS fingerprint FROM (SELECT id // 10000 AS part, sha1(string_agg(id::VARCHAR, ',' ORDER BY id)) AS digest FROM (SELECT src AS id FROM v_code_edges UNION SELECT dst FROM v_code_edges) GROUP BY 1)"))
def _(s, d):
    """A hash over all nodes in two levels, the number of edges and the version of the layout's steps, so that a new layout is not taken for an old one."""
    e = v.code_edges(s, d)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = ids.groupBy(F.floor(F.col("id") / 10_000).alias("part")).agg(F.sha1(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").cast("binary")).alias("digest"))
    all_ = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda r: r["digest"]), ",").alias("ids"))
    return all_.join(F.broadcast(e.agg(F.count("*").alias("n"))), F.lit(True)).select(F.sha1(F.concat("ids", F.lit("|"), F.col("n").cast("string"), F.lit(f"|{g.LAYOUT}")).cast("binary")).alias("fingerprint"))
