"""Queries over stored indexes and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.functions.chunks import embeddable
from quillon.operators.graph import work_dir
from quillon.operators.lexicon import ChunkStore, IndexedNodes
from quillon.plans import retrieve as r
from quillon.plans.queries import retrieval as rt

o = v.oracle
#: Every hundredth node's first 100 characters, as in the other searches.
_P = "p AS (SELECT doc_id AS qid, substr(coalesce(text, ''), 1, 100) AS prompt FROM documents WHERE doc_id % 100 = 0)"


def _bm(nodes: str) -> str:
    """Okapi over (id, name, description, body) of a table expression."""
    return f"""{_P}, pt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(prompt), '[a-z0-9_]{{3,}}')) AS term FROM p), n0 AS ({nodes}),
dt AS (SELECT id, list_concat(list_concat(regexp_extract_all(lower(coalesce(name, '')), '[a-z0-9_]{{3,}}'), regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9_]{{3,}}')), regexp_extract_all(lower(substr(coalesce(body, ''), 1, 32768)), '[a-z0-9_]{{3,}}')) AS w FROM n0),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dt), tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM dt) WHERE term IN (SELECT term FROM pt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT qid, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM tf JOIN df USING (term) JOIN pt USING (term), st GROUP BY qid, id),
br AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm)"""


def _described(s, d):
    return v.nodes(s, d).select("id", "name", F.concat(F.lit("about "), F.coalesce("project_key", F.lit("nothing"))).alias("description"), "body")


_DESCRIBED = "SELECT id, name, 'about ' || coalesce(project_key, 'nothing') AS description, body FROM v_nodes"
_COLUMNS = "id long, name string, description string, body string"


def _prompts(s, d):
    return v.nodes(s, d).where("id % 100 = 0").select(F.col("id").alias("qid"), F.substring(F.coalesce("body", F.lit("")), 1, 100).alias("prompt"))


def _ranked(index, s, d):
    return r.top(index.bm25(_prompts(s, d), 10), 10).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("index_build", o("nodes", f"WITH {_bm(_DESCRIBED)} SELECT qid, id, rank::BIGINT AS rank, round(score, 6) AS score FROM br WHERE rank < 10"))
def _(s, d):
    """All nodes indexed by name, description and body in one epoch, then ranked from postings."""
    index = IndexedNodes(s, work_dir(s), _COLUMNS)
    index.write(_described(s, d))
    return _ranked(index, s, d)


#: Nodes rewritten in the second epoch, removed in the third, written again in the fourth.
_NEW = "'rewritten ' || name"
_AFTER = f"""SELECT id, name, description, CASE WHEN id % 7 = 0 AND id % 22 <> 0 THEN {_NEW} || ' ' || substr(coalesce(body, ''), 1, 300) ELSE body END AS body FROM ({_DESCRIBED}) WHERE id % 11 <> 0 OR id % 22 = 0"""


@query("index_after_writes", o("nodes", f"WITH {_bm(_AFTER)} SELECT qid, id, rank::BIGINT AS rank, round(score, 6) AS score FROM br WHERE rank < 10"))
def _(s, d):
    """Four epochs of upserts and removals with a compaction between; each writes its own postings only."""
    n = _described(s, d)
    index = IndexedNodes(s, work_dir(s), _COLUMNS)
    index.write(n.where("id % 3 <> 0"))
    index.write(n.where("id % 3 = 0 AND id % 7 <> 0").unionByName(n.where("id % 7 = 0").withColumn("body", F.concat(F.lit("rewritten "), "name", F.lit(" "), F.substring(F.coalesce("body", F.lit("")), 1, 300)))))
    index.compact()
    index.write(n.limit(0), gone=n.where("id % 11 = 0").select("id"))
    index.write(n.where("id % 22 = 0"))
    return _ranked(index, s, d)


@query("retrieval_indexed", o("nodes chunks code_edges", rt.INDEXED_SQL.replace("{bm}", _bm("SELECT id, name, 'about ' || coalesce(project_key, 'nothing') AS description, body FROM v_nodes"))))
def _(s, d):
    """Hybrid retrieval whose lexical ranker is the stored index over three fields."""
    index = IndexedNodes(s, work_dir(s), _COLUMNS)
    index.write(_described(s, d))
    made = rt.components(s, d, rt.S, index.bm25)
    return r.top(made, 5).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("chunk_replace", "WITH c AS (SELECT vec_id // 3 AS id, (vec_id % 3)::INTEGER AS chunk_idx, 'c' || vec_id AS chunk_text, embedding[1]::DOUBLE AS first FROM embeddings) SELECT id, chunk_idx, chunk_text, first FROM c WHERE id % 4 <> 0 AND id % 5 <> 0 UNION ALL SELECT id, chunk_idx, 'new ' || chunk_text, first FROM c WHERE id % 4 = 0 AND chunk_idx < 2")
def _(s, d):
    """All chunks written, then those of every fourth node replaced by fewer ones and those of every fifth removed."""
    v_ = F.col("vec_id")
    c = v.chunks(s, d).withColumnRenamed("node_id", "vec_id").select(F.floor(v_ / 3).cast("long").alias("id"), (v_ % 3).cast("int").alias("chunk_idx"), F.concat(F.lit("c"), v_).alias("chunk_text"), "embedding")
    store = ChunkStore(s, work_dir(s), 64)
    store.replace(c)
    store.replace(c.where("id % 4 = 0 AND chunk_idx < 2").withColumn("chunk_text", F.concat(F.lit("new "), "chunk_text")), c.where("id % 5 = 0 AND id % 4 <> 0").select("id"))
    return store.chunks().select("id", "chunk_idx", "chunk_text", F.element_at("embedding", 1).cast("double").alias("first"))


@query("embeddable_chunks", o("nodes", "SELECT id, CASE WHEN id % 2 = 0 THEN 'about ' || id ELSE name END AS chunk_text, 3 AS tokens FROM v_nodes WHERE id % 3 = 0 AND id % 2 = 0 UNION ALL SELECT id, name, 2 FROM v_nodes WHERE id % 3 = 0 AND id % 2 <> 0"))
def _(s, d):
    """Nodes whose body is blank are embedded by their description, or else their name."""
    k = F.col("id")
    n = v.nodes(s, d).select("id", "name", F.when(k % 2 == 0, F.concat(F.lit("about "), k)).alias("description"), F.when(k % 3 != 0, F.coalesce("body", F.lit(""))).otherwise(" \n ").alias("body"))
    return embeddable(n).join(n.where("id % 3 = 0").select("id"), "id").select("id", "chunk_text", "tokens")
