"""Event-time windows, metering, re-queries and incremental ingestion as streams.

Each function takes a streaming or a static DataFrame, so batch and stream share one definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.lexicon import IndexedNodes


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn("ts", F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    e = timed(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    e = timed(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    e = timed(events).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def metering(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Queries of each key and UTC month."""
    e = timed(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 day"), F.col("user_id").alias("api_key_id")).agg(F.count("*").alias("queries")).select("api_key_id", F.date_format("window.start", "yyyy-MM").alias("period"), "queries")


def requeries(events: DataFrame, seconds: int = 300, late: str = "1 day") -> DataFrame:
    """Pairs of events of one user on one node within `seconds`: a stream-stream interval join with state bounded by watermarks."""
    e = timed(events).withWatermark("ts", late)
    k = F.get_json_object("props", "$.k").cast("long")
    a = e.select(F.col("event_id").alias("first"), F.col("ts").alias("ts_a"), F.col("user_id").alias("user_a"), k.alias("node_a"))
    b = e.select(F.col("event_id").alias("again"), F.col("ts").alias("ts_b"), F.col("user_id").alias("user_b"), k.alias("node_b"))
    return a.join(b, F.expr(f"user_a = user_b AND node_a = node_b AND ts_b > ts_a AND ts_b <= ts_a + INTERVAL {seconds} SECONDS")).select("first", "again", F.col("node_a").alias("node_id"))


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def ingest(files: DataFrame, index: IndexedNodes, parse: Callable[[DataFrame], DataFrame], checkpoint: str, report: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None, compact_every: int = 20):
    """Start incremental ingestion of a stream of files into an indexed node table.

    parse gives node rows with `id`, `hash` and `updated_at` (seconds); a row without a hash says that its file is gone. Of a batch only
    rows that are added or updated are written, as one epoch of nodes and index together, so bytes written follow the batch: rows
    with a known hash are unchanged, and rows older than what is known are late and change nothing. A batch that is run again finds
    its epoch committed. report gets (id, status) of every row: the event stream of a reindex run. A trigger of a processing time
    collects the changes of that time into one batch.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        rows = parse(batch)
        last = rows.groupBy("id").agg(F.max(F.struct("updated_at", F.col("hash").isNotNull().alias("held"), *[c for c in rows.columns if c not in ("id", "updated_at")])).alias("_r"))
        fresh = last.select("id", "_r.updated_at", *[F.col(f"_r.{c}").alias(c) for c in rows.columns if c not in ("id", "updated_at")]).persist()
        known = index.nodes().select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("updated_at").alias("_at"))
        told = fresh.join(known, F.col("id") == F.col("_id"), "left").withColumn("status", status(F.col("hash"), F.col("_hash"), F.col("updated_at"), F.col("_at"))).drop("_id", "_hash", "_at").persist()
        if report:
            report(told.select("id", "status"), epoch)
        index.write(told.where("status IN ('added', 'updated')").drop("status"), told.where("status = 'removed'").select("id"), epoch)
        if len(index.store.committed()) >= compact_every:
            index.compact()
        told.unpersist()
        fresh.unpersist()

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def status(new: Column, old: Column, at: Column, then: Column) -> Column:
    """What a file's row is to the known one: absent, added, late, removed, unchanged or updated."""
    return F.when(old.isNull() & new.isNull(), "absent").when(old.isNull(), "added").when(at < then, "late").when(new.isNull(), "removed").when(new == old, "unchanged").otherwise("updated")


def evidence(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Last touch and last stamp of each session, as a running aggregate (update mode): evidence is fresh while stamped >= touched."""
    e = timed(events).withWatermark("ts", late)
    return e.groupBy(F.col("user_id").alias("session")).agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("touched"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("stamped")).select("session", (F.col("stamped").isNotNull() & (F.col("touched").isNull() | (F.col("stamped") >= F.col("touched")))).alias("fresh"))
