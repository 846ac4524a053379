"""Event-time queries; tests run the same plans as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.catalog import query
from quillon.session import table
from quillon.streaming import events as e


@query("tumbling_events", "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    return e.tumbling(table(s, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_events", "SELECT epoch(date_trunc('day', ts) - to_days(k))::BIGINT AS start, event_type, count(*)::BIGINT AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")
def _(s, d):
    """Two-day windows that start each day: epoch days, so the windows are aligned to the epoch."""
    return e.sliding(table(s, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("session_events", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*)::BIGINT AS n FROM k GROUP BY user_id, sid")
def _(s, d):
    return e.sessions(table(s, d, "events")).select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("usage_metering", "SELECT user_id AS api_key_id, strftime(ts, '%Y-%m') AS period, count(*)::BIGINT AS queries FROM events GROUP BY ALL")
def _(s, d):
    return e.metering(table(s, d, "events")).groupBy("api_key_id", "period").agg(F.sum("queries").alias("queries"))


@query("requery_pairs", "SELECT a.event_id AS first, b.event_id AS again, CAST(json_extract_string(a.props, '$.k') AS BIGINT) AS node_id FROM events a JOIN events b ON a.user_id = b.user_id AND json_extract_string(a.props, '$.k') = json_extract_string(b.props, '$.k') AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 864000 SECOND")
def _(s, d):
    return e.requeries(table(s, d, "events"), 864_000)


@query("evidence_freshness", "SELECT user_id AS session, max(ts) FILTER (event_type = 'purchase') IS NOT NULL AND (max(ts) FILTER (event_type = 'error') IS NULL OR max(ts) FILTER (event_type = 'purchase') >= max(ts) FILTER (event_type = 'error')) AS fresh FROM events GROUP BY user_id")
def _(s, d):
    return e.evidence(table(s, d, "events"))


@query("approx_distinct_users")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))
