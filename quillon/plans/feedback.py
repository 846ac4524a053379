"""Feedback reduction, ranking quality, weight tuning and task scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.vectors import cosine
from quillon.schema import EXPLICIT

COMPONENTS = ("vector", "graph", "recency", "type", "project", "lexical")
#: Steps, least gain and passes of coordinate descent. Fixed values.
NUDGES, LEAST_GAIN, PASSES = (0.05, -0.05, 0.10, -0.10), 0.001, 4


def reduced(events: DataFrame) -> DataFrame:
    """(query_id, node_id, signal): the latest explicit signal, else the highest implicit one; ties in time go to the larger id."""
    explicit = F.col("reason").isin(*EXPLICIT)
    return events.groupBy("query_id", "node_id").agg(F.max(F.when(explicit, F.struct("created_at", "id", "signal"))).alias("e"), F.max("signal").alias("m")).select("query_id", "node_id", F.coalesce("e.signal", "m", F.lit(0.0)).alias("signal"))


def rescored(components: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Linear score and 1-based rank of each query's candidates."""
    score = sum((F.lit(weights[c]) * F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "node_id")
    return components.withColumn("score", score).withColumn("rank", F.row_number().over(w))


def mean_reciprocal_rank(ranked: DataFrame, signals: DataFrame) -> Column:
    """One row: mean over queries of 1 / rank of the first hit with a positive signal."""
    first = ranked.join(signals.where("signal > 0"), ["query_id", "node_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return ranked.select("query_id").distinct().join(first, "query_id", "left").agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def split_by_time(queries: DataFrame, share: float = 0.8) -> DataFrame:
    """Each query's part: the first `share` in time train, the rest val; at least one each.

    Ranks come from counts by day and a window inside each day, so no single task sorts all queries.
    """
    day = F.floor(F.col("ts_s") / 86400)
    by_day = queries.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    before = by_day.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    inside = queries.withColumn("_day", day).withColumn("_k", F.row_number().over(Window.partitionBy("_day").orderBy("ts_s", "id")))
    cut = F.greatest(F.lit(1), F.least(F.col("_all") - 1, F.floor(F.col("_all") * share)))
    return inside.join(before, "_day").withColumn("part", F.when(F.col("_before") + F.col("_k") <= cut, "train").otherwise("val")).drop("_day", "_k", "_before", "_n", "_all")


def requeries(log: DataFrame, window: int = 300, threshold: float = 0.85, top: int = 3) -> DataFrame:
    """(query_id, node_id): hits of queries that the same actor asked again, alike, within the window.

    log: (id, actor, at, embedding, hits). A range join on time as an equality of window buckets.
    """
    bucket = F.floor(F.col("at") / window)
    prior = log.select("actor", F.col("id").alias("query_id"), F.col("at").alias("then"), F.col("embedding").alias("old"), "hits", F.explode(F.array(bucket, bucket + 1)).alias("b"))
    again = log.select("actor", F.col("id").alias("again"), F.col("at").alias("now"), F.col("embedding").alias("new"), bucket.alias("b"))
    met = prior.join(again, ["actor", "b"]).where(f"query_id <> again AND now > then AND now - then <= {window}").where(cosine(F.col("old"), F.col("new")) >= threshold)
    return met.select("query_id", F.explode(F.slice("hits", 1, top)).alias("node_id")).distinct()


def tuned(components: DataFrame, signals: DataFrame, start: dict[str, float], least_queries: int = 30) -> dict:
    """Coordinate descent of the six weights: a nudge is kept where it lifts the mean reciprocal rank of validation queries by more than LEAST_GAIN.

    components: (query_id, part, node_id, the six). Nudges that leave [0, 1] are skipped. Every nudge that is still to be tried from
    the present weights is a column of one distributed aggregation, so a round of tries is one job whatever the log's size, and the
    driver holds 24 numbers.
    """
    good = signals.where("signal > 0").select("query_id", "node_id").distinct().withColumn("_good", F.lit(True))
    rows = components.join(good, ["query_id", "node_id"], "left").select("query_id", "part", "node_id", *COMPONENTS, F.coalesce("_good", F.lit(False)).alias("good"))
    n = rows.select("query_id").distinct().count()
    if n < least_queries:
        return {"status": "too_few", "weights": start, "queries": n}
    weights = {c: start[c] for c in COMPONENTS}
    best = first = _reciprocal(rows.where("part = 'val'"), [weights])[0]
    for _ in range(PASSES):
        moved, tries = False, [(c, step) for c in COMPONENTS for step in NUDGES]
        while tries:
            trials = [(k, {**weights, c: weights[c] + step}) for k, (c, step) in enumerate(tries) if 0.0 <= weights[c] + step <= 1.0]
            got = _reciprocal(rows.where("part = 'val'"), [w for _, w in trials]) if trials else []
            better = next((x for x, m in zip(trials, got, strict=True) if m > best + LEAST_GAIN), None)
            if better is None:
                break
            best, weights, moved = got[trials.index(better)], better[1], True
            tries = tries[better[0] + 1 :]
        if not moved:
            break
    return {"status": "improved" if best > first else "unchanged", "weights": weights, "before": first, "after": best, "train": _reciprocal(rows.where("part = 'train'"), [weights])[0], "queries": n}


def _reciprocal(rows: DataFrame, trials: list[dict[str, float]]) -> list[float]:
    """The mean reciprocal rank under each of some weights: the first good row's rank is one more than the rows before it."""
    own = Window.partitionBy("query_id")
    placed = rows.withColumn("_at", -F.row_number().over(own.orderBy("node_id")))  # ties go to the smaller node
    keys = [F.struct(F.round(sum((F.lit(w[c]) * F.coalesce(F.col(c), F.lit(0.0)) for c in COMPONENTS), F.lit(0.0)), 9).alias("s"), F.col("_at").alias("a")) for w in trials]
    scored = placed.select("query_id", "good", *[k.alias(f"k{j}") for j, k in enumerate(keys)])
    tops = scored.select("query_id", *[f"k{j}" for j in range(len(trials))], *[F.max(F.when(F.col("good"), F.col(f"k{j}"))).over(own).alias(f"t{j}") for j in range(len(trials))])
    ranks = tops.groupBy("query_id").agg(*[F.when(F.max(F.col(f"t{j}").isNotNull()), 1 / (1 + F.count_if(F.col(f"k{j}") > F.col(f"t{j}")))).otherwise(F.lit(0.0)).alias(f"r{j}") for j in range(len(trials))])
    made = ranks.agg(*[F.avg(f"r{j}") for j in range(len(trials))]).first()
    return [x or 0.0 for x in made]


QUERY_TYPES = ("lexical", "conceptual")


def query_type(said: Column) -> Column:
    """A query's type; anything unknown counts as lexical."""
    low = F.lower(F.trim(F.coalesce(said, F.lit(""))))
    return F.when(low.isin(*QUERY_TYPES), low).otherwise(QUERY_TYPES[0])


def hits(ranked: DataFrame) -> DataFrame:
    """(query_type, n, hit1, hit5, mrr) by type and over all (null) of (query_type, rank from 0 of the first right hit, or null)."""
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("rank") < k, F.lit(False)).cast("int")), 6)
    return ranked.rollup("query_type").agg(F.count("*").alias("n"), hit(1).alias("hit1"), hit(5).alias("hit5"), F.round(F.avg(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0))), 6).alias("mrr"))


def task_report(scores: DataFrame) -> DataFrame:
    """(cls, n, recall, precision, f1, success): means by class, and over all in a row whose class is `overall`; scores has a column cls."""
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    made = scores.withColumn("cls", F.coalesce("cls", F.lit(""))).rollup("cls").agg(F.count("*").alias("n"), mean("recall"), mean("precision"), mean("f1"), mean("success"), F.grouping("cls").alias("_all"))
    return made.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("cls")).alias("cls"), "n", "recall", "precision", "f1", "success")


def bench_metrics(turns: DataFrame, expected: DataFrame) -> DataFrame:
    """(prompt_id, tokens, precision, keywords, rederived) of answered prompts.

    turns: (prompt_id, cited array, answer, context_tokens, asked_again boolean); expected: (prompt_id, relevant array, keywords array).
    precision: share of distinct citations that are relevant, 0 without any; keywords: share that the answer holds, whatever the case, 1
    where none are asked for; rederived: whether the answer had to be worked out again.
    """
    j = turns.join(expected, "prompt_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("cited", "relevant", "keywords")})
    distinct = F.array_distinct("cited")
    held = F.size(F.filter("keywords", lambda k: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(k))))
    return j.select(
        "prompt_id",
        F.coalesce("context_tokens", F.lit(0)).cast("long").alias("tokens"),
        F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, "relevant")) / F.size(distinct)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.size("keywords") > 0, held / F.size("keywords")).otherwise(F.lit(1.0)).alias("keywords"),
        F.coalesce("asked_again", F.lit(False)).alias("rederived"),
    )


def task_scores(found: DataFrame, answers: DataFrame) -> DataFrame:
    """(task, recall, precision, f1, success) of found (task, key, calls) against answers (task, key, budget)."""
    want = answers.groupBy("task").agg(F.countDistinct("key").alias("want"), F.max("budget").alias("budget"))
    got = found.groupBy("task").agg(F.countDistinct("key").alias("got"), F.max("calls").alias("calls"))
    right = found.select("task", "key").distinct().join(answers.select("task", "key").distinct(), ["task", "key"]).groupBy("task").agg(F.count("*").alias("right"))
    j = want.join(got, "task", "left").join(right, "task", "left").na.fill(0, ["got", "calls", "right"])
    recall, precision = F.col("right") / F.col("want"), F.when(F.col("got") > 0, F.col("right") / F.col("got")).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return j.select("task", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), ((recall >= 1) & (F.col("calls") <= F.col("budget"))).alias("success"))
