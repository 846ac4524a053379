"""Audit detectors and the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.operators import audit as a
from quillon.operators import graph
from quillon.session import table

o = v.oracle
_DOT = "list_sum(list_transform(range(1, 65), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(x.embedding, lambda e: e::DOUBLE * e::DOUBLE))) * sqrt(list_sum(list_transform(y.embedding, lambda e: e::DOUBLE * e::DOUBLE))))"
_PAIRS = f"SELECT a, b, cosine FROM (SELECT x.vec_id AS a, y.vec_id AS b, {_DOT} AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND x.label = y.label)"


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("type"))


@query("dup_pairs", f"SELECT a, b, round(cosine, 5) AS cosine FROM ({_PAIRS}) WHERE cosine >= 0.3")
def _(s, d):
    return a.similar_pairs(_vectors(s, d), 0.3, bucket="type").select("a", "b", F.round("cosine", 5).alias("cosine"))


@query("duplicate_findings", f"SELECT a::VARCHAR || ',' || b::VARCHAR AS ids FROM ({_PAIRS}) WHERE cosine >= 0.4")
def _(s, d):
    return a.duplicates(_vectors(s, d), 0.4).select(F.array_join("node_ids", ",").alias("ids"))


@query("contradiction_pairs", o("nodes", f"SELECT a::VARCHAR || ',' || b::VARCHAR AS ids FROM ({_PAIRS}) p JOIN v_nodes m ON p.a = m.id JOIN v_nodes n ON p.b = n.id WHERE cosine BETWEEN 0.25 AND 0.45 AND (contains(lower(m.body), 'avoid') OR contains(lower(m.body), 'never') OR contains(lower(n.body), 'avoid') OR contains(lower(n.body), 'never') OR p.a % 4 = 0 OR p.b % 4 = 0)"))
def _(s, d):
    n = v.nodes(s, d).select("id", F.when(F.col("id") % 4 == 0, F.concat("body", F.lit(" never do"))).otherwise(F.col("body")).alias("body"))
    return a.contradictions(_vectors(s, d), n, 0.25, 0.45).select(F.array_join("node_ids", ",").alias("ids"))


@query("exact_body_duplicates", o("nodes", "SELECT min(id) AS first_id, count(*)::BIGINT AS n FROM v_nodes GROUP BY sha256(body) HAVING count(*) > 1"))
def _(s, d):
    return v.nodes(s, d).groupBy(F.sha2(F.col("body").cast("binary"), 256).alias("h")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


@query("stale_nodes", o("nodes", "SELECT id::VARCHAR AS ids FROM v_nodes WHERE contains(lower(CASE WHEN id % 13 = 0 THEN body || ' SUPERSEDED by v2' ELSE body END), 'superseded')"))
def _(s, d):
    n = v.nodes(s, d).withColumn("body", F.when(F.col("id") % 13 == 0, F.concat("body", F.lit(" SUPERSEDED by v2"))).otherwise(F.col("body")))
    return a.stale(n).select(F.array_join("node_ids", ",").alias("ids"))


@query("anti_orphan_citation", o("nodes", "SELECT c.id, 'x' || (c.id % 90) AS target FROM v_nodes c WHERE c.id % 90 > 60"))
def _(s, d):
    cited = v.nodes(s, d).select("id", F.concat(F.lit("x"), F.col("id") % 90).alias("target"))
    have = s.range(61).select(F.concat(F.lit("x"), "id").alias("id"))
    return a.orphan_citations(cited, have).select(F.col("node_ids")[0].cast("long").alias("id"), F.col("locus").alias("target"))


@query("anti_dead_code", o("code_edges", "SELECT p_partkey::VARCHAR AS ids FROM part WHERE p_partkey % 3 = 0 AND p_partkey NOT IN (SELECT dst FROM v_code_edges)"))
def _(s, d):
    symbols = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_p"), "p_partkey")).otherwise(F.concat(F.lit("p"), "p_partkey")).alias("name"))
    return a.dead_code(symbols, v.code_edges(s, d)).select(F.array_join("node_ids", ",").alias("ids"))


_OWNED = "SELECT s_suppkey AS owner, CASE WHEN s_suppkey % 3 = 0 THEN 'class' ELSE 'module' END AS kind, CASE WHEN s_suppkey % 7 = 0 THEN 'test_' ELSE 'm' END || s_suppkey AS name FROM supplier"
_GOD = f"SELECT owner, kind, name, n FROM ({_OWNED}) JOIN (SELECT module AS owner, count(*) AS n FROM v_members WHERE symbol % 16 < owner % 16 GROUP BY 1) USING (owner) WHERE (kind = 'class' AND n > 25) OR (kind = 'module' AND n > 30 AND NOT starts_with(name, 'test_'))"


def _god(s, d):
    k = F.col("s_suppkey")
    owners = table(s, d, "supplier").select(k.alias("owner"), F.when(k % 3 == 0, "class").otherwise("module").alias("kind"), F.concat(F.when(k % 7 == 0, "test_").otherwise("m"), k).alias("name"), F.lit("src/x.py").alias("source_path"))
    members = v.members(s, d).where("symbol % 16 < module % 16").select(F.col("module").alias("owner"), F.col("symbol").alias("member"))  # modules of different sizes
    return a.god_objects(members, owners)


@query("god_objects", o("members", f"SELECT owner::VARCHAR AS ids, 'candidate' AS severity, name || ': ' || n || CASE kind WHEN 'class' THEN ' methods' ELSE ' definitions' END AS description FROM ({_GOD})"))
def _(s, d):
    return _god(s, d).select(F.array_join("node_ids", ",").alias("ids"), "severity", "description")


@query("semantic_orphans", o("nodes", "WITH c AS (SELECT id, 'Concept_' || (id % 37) || '_x' AS concept FROM v_nodes UNION ALL SELECT id, 'node_' || (id % 300) FROM v_nodes), t AS (SELECT id, lower(name) AS t FROM v_nodes UNION SELECT id, lower('The CONCEPT_' || (id % 20) || '_Xs') FROM v_nodes) SELECT DISTINCT id, concept FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id <> c.id AND contains(t.t, lower(c.concept)))"))
def _(s, d):
    n = v.nodes(s, d)
    c = n.select("id", F.concat(F.lit("Concept_"), F.col("id") % 37, F.lit("_x")).alias("concept")).unionByName(n.select("id", F.concat(F.lit("node_"), F.col("id") % 300).alias("concept")))
    defs = n.select("id", "name", F.concat(F.lit("The CONCEPT_"), F.col("id") % 20, F.lit("_Xs")).alias("description"))
    return a.undefined_concepts(c, defs).select(F.col("node_ids")[0].cast("long").alias("id"), F.col("locus").alias("concept"))


def _symbols(s, d):
    n = v.nodes(s, d)
    k = F.col("id")
    return n.select("id", F.when(k % 2 == 0, "code_function").when(k % 9 == 1, "code_class").otherwise("code_method").alias("type"), F.concat(F.when(k % 11 == 0, "test_").otherwise("f"), k).alias("name"), F.concat(F.lit("src/"), F.when(k % 13 == 0, "tests/").otherwise("lib/"), k, F.lit(".py")).alias("source_path"), F.concat(F.lit("p"), k % 3).alias("project_key"), F.when(k % 5 == 0, "one\n\nline").otherwise("a\nb\n\nc\nd\ne").alias("body"))


_SYMBOL = "SELECT vec_id AS id, embedding FROM embeddings JOIN documents ON vec_id = doc_id WHERE (vec_id % 2 = 0 OR vec_id % 9 <> 1) AND vec_id % 11 <> 0 AND vec_id % 13 <> 0 AND vec_id % 5 <> 0"


@query("duplicate_code", f"WITH x AS ({_SYMBOL}) SELECT x.id AS a, y.id AS b, 'f' || x.id || ' / f' || y.id AS locus FROM x JOIN x y ON x.id < y.id AND x.id % 3 = y.id % 3 WHERE {_DOT} >= 0.35")
def _(s, d):
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return a.duplicate_code(_symbols(s, d), vectors, 0.35).select(F.col("node_ids")[0].cast("long").alias("a"), F.col("node_ids")[1].cast("long").alias("b"), "locus")


@query("cyclic_import_findings", o("code_edges", "WITH r(id, t) AS (SELECT src, dst FROM v_code_edges UNION SELECT r.id, e.dst FROM r JOIN v_code_edges e ON r.t = e.src), c AS (SELECT a.id, min(a.t) AS cycle FROM r a JOIN r b ON a.id = b.t AND a.t = b.id GROUP BY a.id) SELECT string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM c GROUP BY cycle", True))
def _(s, d):
    return a.import_cycles(graph.cycles(v.code_edges(s, d))).select(F.array_join("node_ids", ",").alias("ids"))


@query("finding_fingerprint", o("members", f"SELECT sha1('god_object' || chr(10) || owner || chr(10) || name) AS fingerprint FROM ({_GOD})"))
def _(s, d):
    return a.fingerprint(_god(s, d)).select("fingerprint")


@query("findings_tally", o("members code_edges", f"SELECT 'god_object' AS type, count(*)::BIGINT AS n FROM ({_GOD}) HAVING count(*) > 0 UNION ALL SELECT 'dead_code', count(*)::BIGINT FROM part WHERE p_partkey NOT IN (SELECT dst FROM v_code_edges) UNION ALL SELECT 'semantic_orphans', count(*)::BIGINT FROM part"))
def _(s, d):
    symbols = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("_p"), "p_partkey").alias("name"))
    missing = a.undefined_concepts(symbols.select("id", F.concat(F.lit("Absent_"), "id").alias("concept")), symbols.select("id", "name", F.lit(None).cast("string").alias("description")))
    return a.tally(_god(s, d).unionByName(a.dead_code(symbols, v.code_edges(s, d))).unionByName(missing))


_QUEUE = "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'stale' ELSE 'duplicate' END AS type, 'f' || s_suppkey AS fingerprint, CASE s_suppkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'dismissed' ELSE 'resolved' END AS status FROM supplier WHERE s_suppkey % 5 <> 0"


@query("reconcile_queue", f"""WITH q AS ({_QUEUE}), f AS (SELECT 'f' || s_suppkey AS fingerprint FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(q.fingerprint, f.fingerprint) AS fingerprint,
  CASE WHEN q.fingerprint IS NULL OR (f.fingerprint IS NOT NULL AND q.status = 'resolved') THEN 'open' WHEN f.fingerprint IS NULL AND q.status = 'open' AND q.type = 'stale' THEN 'resolved' ELSE q.status END AS status,
  CASE WHEN q.fingerprint IS NULL THEN 'new' WHEN f.fingerprint IS NOT NULL AND q.status = 'resolved' THEN 'reopened' WHEN f.fingerprint IS NOT NULL THEN 'unchanged' WHEN q.status = 'open' AND q.type = 'stale' THEN 'resolved' ELSE 'kept' END AS change,
  CASE WHEN f.fingerprint IS NOT NULL OR (q.status = 'open' AND q.type = 'stale') THEN 200 ELSE 100 END::BIGINT AS last_seen
FROM q FULL JOIN f ON q.fingerprint = f.fingerprint""")
def _(s, d):
    x = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("f"), "s_suppkey").alias("fingerprint"))
    kind = F.when(F.col("k") % 4 == 0, "stale").otherwise("duplicate").alias("type")
    rest = [F.lit("low").alias("severity"), F.array(F.col("k").cast("string")).alias("node_ids"), F.lit("").alias("description"), F.lit(None).cast("string").alias("locus")]
    status = F.when(F.col("k") % 3 == 0, "open").when(F.col("k") % 3 == 1, "dismissed").otherwise("resolved").alias("status")
    queue = x.where("k % 5 <> 0").select("fingerprint", kind, *rest, status, F.lit(100).cast("long").alias("first_seen"), F.lit(100).cast("long").alias("last_seen"))
    fresh = x.where("k % 2 = 0").select("fingerprint", F.lit("stale").alias("type"), *rest)
    return a.reconcile(queue, fresh, ["stale"], 200).select("fingerprint", "status", "change", "last_seen")


@query("audit_queue_page", f"SELECT fingerprint, status FROM (SELECT *, CASE type WHEN 'stale' THEN 1 ELSE 2 END AS rank FROM ({_QUEUE})) WHERE status = 'open' ORDER BY rank, fingerprint LIMIT 10")
def _(s, d):
    x = table(s, d, "supplier").where("s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0").select(F.concat(F.lit("f"), "s_suppkey").alias("fingerprint"), F.lit("open").alias("status"), F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(2).alias("rank"))
    return x.orderBy("rank", "fingerprint").limit(10).select("fingerprint", "status")
