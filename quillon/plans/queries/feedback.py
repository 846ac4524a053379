"""Feedback, tuning and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import views as v
from quillon.catalog import query
from quillon.operators.graph import work_dir
from quillon.plans import feedback as f
from quillon.plans import retrieve as r
from quillon.plans.queries import retrieval as rt
from quillon.session import table
from quillon.streaming import requery

o = v.oracle
W = {"vector": 0.40, "graph": 0.15, "recency": 0.10, "type": 0.10, "project": 0.05, "lexical": 0.20}
_COMP = "SELECT DISTINCT user_id AS query_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS node_id FROM events"
_C6 = "SELECT query_id, node_id, ((query_id * 7 + node_id * 3) % 10) / 10.0::DOUBLE AS vector, ((query_id + node_id) % 7) / 7.0::DOUBLE AS graph, (node_id % 5) / 5.0::DOUBLE AS recency, (node_id % 3) / 3.0::DOUBLE AS type, (query_id % 2)::DOUBLE AS project, ((query_id * node_id) % 11) / 11.0::DOUBLE AS lexical FROM c"
_RANK = f"c AS ({_COMP}), x AS ({_C6}), sc AS (SELECT query_id, node_id, 0.4::DOUBLE * vector + 0.15::DOUBLE * graph + 0.1::DOUBLE * recency + 0.1::DOUBLE * type + 0.05::DOUBLE * project + 0.2::DOUBLE * lexical AS score FROM x), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM sc)"
_SIG = "sg AS (SELECT query_id, node_id, coalesce(arg_max(signal, (created_at, id)) FILTER (reason IN ('thumbs_up', 'thumbs_down')), max(signal)) AS signal FROM v_feedback GROUP BY ALL)"


def components(s, d):
    c = v.query_log(s, d).select(F.col("actor").alias("query_id"), (F.col("node_id") % 20).alias("node_id")).distinct()
    q, n = F.col("query_id"), F.col("node_id")
    return c.select("query_id", "node_id", ((q * 7 + n * 3) % 10 / 10.0).alias("vector"), ((q + n) % 7 / 7.0).alias("graph"), (n % 5 / 5.0).alias("recency"), (n % 3 / 3.0).alias("type"), (q % 2).cast("double").alias("project"), ((q * n) % 11 / 11.0).alias("lexical"))


@query("feedback_reduce", o("feedback", f"WITH {_SIG} SELECT query_id, node_id, signal FROM sg"))
def _(s, d):
    return f.reduced(v.feedback(s, d))


@query("rescore", o("", f"WITH {_RANK} SELECT query_id, node_id, round(score, 6) AS score, rank::INTEGER AS rank FROM rk WHERE rank <= 5"))
def _(s, d):
    return f.rescored(components(s, d), W).where("rank <= 5").select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query("mrr", o("feedback", f"WITH {_RANK}, {_SIG}, fr AS (SELECT query_id, min(rank) AS first FROM rk JOIN sg USING (query_id, node_id) WHERE signal > 0 GROUP BY query_id) SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (SELECT DISTINCT query_id FROM rk) LEFT JOIN fr USING (query_id)"))
def _(s, d):
    return f.mean_reciprocal_rank(f.rescored(components(s, d), W), f.reduced(v.feedback(s, d))).select(F.round("mrr", 6).alias("mrr"))


@query("train_val_split", o("query_log", "SELECT part, count(*)::BIGINT AS n, min(id) AS first_id FROM (SELECT id, CASE WHEN row_number() OVER (ORDER BY at_s, id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'val' END AS part FROM v_query_log) GROUP BY part"))
def _(s, d):
    q = v.query_log(s, d).select("id", F.col("at_s").alias("ts_s"))
    return f.split_by_time(q).groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_HIT = f"""WITH p AS (SELECT item_id AS qid, substr(text, 1, 100) AS prompt FROM benchmark), {rt.BM_SQL}, t AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT b.item_id, min(rank) AS rank FROM benchmark b LEFT JOIN (SELECT item_id, rank FROM t JOIN br ON br.qid = t.item_id AND br.id = t.doc_id WHERE rank < 10) USING (item_id) GROUP BY b.item_id)
SELECT CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'conceptual' END AS query_type, count(*)::BIGINT AS n, round(avg(coalesce(rank < 1, false)::INT), 6)::DOUBLE AS hit1, round(avg(coalesce(rank < 5, false)::INT), 6)::DOUBLE AS hit5, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1.0::DOUBLE / (rank + 1) END), 6)::DOUBLE AS mrr FROM h GROUP BY ROLLUP (CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'conceptual' END)"""


@query("hit_at_k", o("nodes", _HIT))
def _(s, d):
    """Truth: documents that hold a benchmark item; ranks: those of the lexical ranker for the item's first 100 characters."""
    items, docs = table(s, d, "benchmark").select("item_id", F.col("text").alias("item")), table(s, d, "documents").select("doc_id", "text")
    found = r.top(r.bm25(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("qid"), F.substring("item", 1, 100).alias("prompt"))), 10)
    # Of a document only the ten first items' ranks are looked at, so truth is tested on those pairs.
    right = found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"), "rank").join(items, "item_id").join(docs, "doc_id").where(F.contains("text", F.col("item"))).groupBy("item_id").agg(F.min("rank").alias("rank"))
    ranked = items.select("item_id").join(right, "item_id", "left")
    return f.hits(ranked.select(F.when(F.col("item_id") % 2 == 0, "lexical").otherwise("conceptual").alias("query_type"), "rank"))


@query("task_scores", o("members", "WITH a AS (SELECT module AS task, symbol AS key FROM v_members WHERE symbol % 10 = 0), f AS (SELECT module AS task, symbol AS key FROM v_members WHERE symbol % 15 = 0), x AS (SELECT a.task, count(*) AS want FROM a GROUP BY 1), y AS (SELECT task, count(*) AS got FROM f GROUP BY 1), z AS (SELECT task, count(*) AS good FROM a JOIN f USING (task, key) GROUP BY 1) SELECT x.task, round(coalesce(good, 0) / want, 6)::DOUBLE AS recall, round(CASE WHEN coalesce(got, 0) > 0 THEN coalesce(good, 0) / got ELSE 0 END, 6)::DOUBLE AS precision, coalesce(good, 0) >= want AND 1 <= x.task % 3 AS success FROM x LEFT JOIN y USING (task) LEFT JOIN z USING (task)"))
def _(s, d):
    m = v.members(s, d).select(F.col("module").alias("task"), F.col("symbol").alias("key"))
    out = f.task_scores(m.where("key % 15 = 0").withColumn("calls", F.lit(1)), m.where("key % 10 = 0").withColumn("budget", F.col("task") % 3))
    return out.select("task", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "success")


#: Each query's vector is that of one of five prompts, which are asked again and again.
_AGAIN = "l AS (SELECT q.*, embedding AS e FROM v_query_log q JOIN embeddings ON vec_id = node_id % 5), r AS (SELECT p.id AS query_id, p.node_id, min(n.at_s) AS created_at FROM l p JOIN l n ON p.actor = n.actor AND p.id <> n.id AND n.at_s > p.at_s AND n.at_s - p.at_s <= 300 WHERE list_sum(list_transform(range(1, 65), lambda i: p.e[i]::DOUBLE * n.e[i]::DOUBLE)) / (sqrt(list_sum(list_transform(p.e, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(n.e, lambda x: x::DOUBLE * x::DOUBLE)))) >= 0.85 GROUP BY ALL)"


def _asked_again(s, d):
    """The vectors of remainders by 5, which are nine ids at most."""
    return F.broadcast(table(s, d, "embeddings").where("vec_id BETWEEN -4 AND 4").select(F.col("vec_id").alias("v"), "embedding"))


@query("requery_feedback", o("query_log", f"WITH {_AGAIN} SELECT query_id, node_id FROM r"))
def _(s, d):
    log = v.query_log(s, d).join(_asked_again(s, d), F.col("node_id") % 5 == F.col("v")).select("id", "actor", F.col("at_s").alias("at"), "embedding", F.array("node_id").alias("hits"))
    return f.requeries(log)


@query("requery_stream", o("query_log", f"WITH {_AGAIN} SELECT query_id, node_id, 'inferred_requery' AS reason, -0.5::DOUBLE AS signal FROM r"))
def _(s, d):
    """The same of the events as a stream: state by actor, timers, and a keyed table that the stream upserts."""
    folder = work_dir(s)
    events = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("actor"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("node_id"))
    log = log.join(_asked_again(s, d), F.col("node_id") % 5 == F.col("v")).select("id", "actor", "ts", "embedding", F.array("node_id").alias("hits"))
    requery.upserted(requery.requeried(log), f"{folder}/feedback", f"{folder}/checkpoint").awaitTermination()
    return requery.feedback(s, f"{folder}/feedback").select("query_id", "node_id", "reason", "signal")


@query("retune")
def _(s, d):
    """Queries (actors) in order of their last event: the first four fifths train, the rest decide."""
    log = v.query_log(s, d).groupBy(F.col("actor").alias("id")).agg(F.max("at_s").alias("ts_s"))
    c = components(s, d).join(f.split_by_time(log).select(F.col("id").alias("query_id"), "part"), "query_id")
    made = f.tuned(c, f.reduced(v.feedback(s, d)), W)
    return s.createDataFrame([(k, float(x)) for k, x in sorted(made["weights"].items())], "component string, weight double")


@query("task_report", o("members", "WITH a AS (SELECT module AS task, symbol AS key FROM v_members WHERE symbol % 10 = 0), f AS (SELECT module AS task, symbol AS key FROM v_members WHERE symbol % 15 = 0), x AS (SELECT a.task, count(*) AS want FROM a GROUP BY 1), y AS (SELECT task, count(*) AS got FROM f GROUP BY 1), z AS (SELECT task, count(*) AS good FROM a JOIN f USING (task, key) GROUP BY 1), r AS (SELECT CASE x.task % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'provenance' ELSE 'memory_recall' END AS cls, coalesce(good, 0) / want AS recall, CASE WHEN coalesce(got, 0) > 0 THEN coalesce(good, 0) / got ELSE 0 END AS precision, (coalesce(good, 0) >= want AND 1 <= x.task % 3)::INT AS success FROM x LEFT JOIN y USING (task) LEFT JOIN z USING (task)) SELECT coalesce(cls, 'overall') AS cls, count(*)::BIGINT AS n, round(avg(recall), 6)::DOUBLE AS recall, round(avg(precision), 6)::DOUBLE AS precision, round(avg(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END), 6)::DOUBLE AS f1, round(avg(success), 6)::DOUBLE AS success FROM r GROUP BY ROLLUP (cls)"))
def _(s, d):
    m = v.members(s, d).select(F.col("module").alias("task"), F.col("symbol").alias("key"))
    scores = f.task_scores(m.where("key % 15 = 0").withColumn("calls", F.lit(1)), m.where("key % 10 = 0").withColumn("budget", F.col("task") % 3))
    kind = F.when(F.col("task") % 3 == 0, "structural").when(F.col("task") % 3 == 1, "provenance").otherwise("memory_recall")
    return f.task_report(scores.withColumn("cls", kind)).select("cls", "n", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1", "success")])


@query("bench_metrics", o("messages", "WITH t AS (SELECT conv_id, list(seq ORDER BY seq) AS cited, string_agg(content, ' ' ORDER BY seq) AS answer, sum(length(content) // 4)::BIGINT AS tokens FROM v_messages WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id AS prompt_id, tokens, round(len(list_filter(cited, lambda x: x IN (1, 5))) / len(cited), 6)::DOUBLE AS precision, round((contains(lower(answer), 'the')::INT + contains(lower(answer), 'zebra')::INT) / 2, 6)::DOUBLE AS keywords, conv_id % 4 = 0 AS rederived FROM t"))
def _(s, d):
    m = v.messages(s, d).where("role = 'assistant'")
    rows = F.sort_array(F.collect_list(F.struct("seq", "content")))
    turns = m.groupBy(F.col("conv_id").alias("prompt_id")).agg(rows.alias("r"), F.sum(F.floor(F.length("content") / 4)).alias("context_tokens")).select("prompt_id", F.transform("r", lambda x: x["seq"].cast("string")).alias("cited"), F.array_join(F.transform("r", lambda x: x["content"]), " ").alias("answer"), "context_tokens", (F.col("prompt_id") % 4 == 0).alias("asked_again"))
    expected = m.select(F.col("conv_id").alias("prompt_id")).distinct().select("prompt_id", F.array(F.lit("1"), F.lit("5")).alias("relevant"), F.array(F.lit("THE"), F.lit("zebra")).alias("keywords"))
    return f.bench_metrics(turns, expected).withColumns({"precision": F.round("precision", 6), "keywords": F.round("keywords", 6)})
