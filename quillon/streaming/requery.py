"""Queries that are asked again, as a stateful stream: each actor's recent queries are its state, timers end them.

A query of the same actor within the look-back whose vector has a cosine of at least `threshold` to an earlier one
says that the earlier one's first hits did not help. State holds only the queries of the look-back, one list entry each; a timer of event
time removes them when it has passed, so an actor who leaves costs nothing. What the stream emits is keyed by (query, node, reason), and
`upserted` writes it by that key, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.epochs import Epochs
from quillon.schema import SIGNALS

REASON = "inferred_requery"
#: State of an actor: one entry for each query of the look-back.
HELD = "id long, at long, embedding array<double>, hits array<long>"
EMITTED = "query_id long, node_id long, reason string, signal double, created_at long"


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine; 0 where sizes differ or a norm is 0."""
    if len(a) != len(b):
        return 0.0
    n = float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    return float((a * b).sum()) / n if n else 0.0


class Recent(StatefulProcessor):
    """The look-back of one actor.

    Rows of a batch come in any order, so they are sorted by time and id, and a row that is late but within the
    watermark is compared both to what came before it and to what is held from after it. A row is compared to those of its look-back
    only, and what is held of a batch is what a row can meet that is `late` seconds behind the actor's newest: later ones are beyond the
    watermark of the batches that follow.
    """

    def __init__(self, seconds: int, threshold: float, top: int, late: int):
        self.seconds, self.threshold, self.top, self.late = seconds, threshold, top, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(k, at, np.asarray(e, float), list(hits or [])) for k, at, e, hits in self.held.get()] if self.held.exists() else []
        known, timed = {h[0] for h in held}, bool(held)
        fresh = [r for part in rows for r in zip(part["id"].tolist(), part["at"].tolist(), part["embedding"], part["hits"], strict=True) if r[2] is not None]
        both = [(h[1], h[0], h[2], h[3], False) for h in held]
        for k, at, e, hits in sorted(fresh, key=lambda h: (h[1], h[0])):
            if k not in known:
                known.add(k)
                both.append((at, k, np.asarray(e, float), [int(x) for x in hits], True))
        both.sort(key=lambda h: h[:2])
        times = np.array([h[0] for h in both], np.int64)
        begin, end = np.searchsorted(times, times - self.seconds, "left"), np.searchsorted(times, times, "left")
        out: set[tuple[int, int, int]] = set()
        for j in np.flatnonzero(begin < end):
            again = both[j]
            for first in both[begin[j] : end[j]]:
                if (again[4] or first[4]) and alike(first[2], again[2]) >= self.threshold:
                    out |= {(first[1], hit, again[0]) for hit in first[3][: self.top]}
        # What even a row at the watermark can't meet any more goes.
        edge = max([timerValues.getCurrentWatermarkInMs() // 1000, *(times[-1:] - self.late).tolist()]) - self.seconds
        self._keep([(k, at, e, hits) for at, k, e, hits, _ in both if at >= edge], timed)
        yield self._made(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs() // 1000 - self.seconds
        held = [(k, at, np.asarray(e, float), list(hits or [])) for k, at, e, hits in self.held.get()] if self.held.exists() else []
        self._keep([h for h in held if h[1] >= edge])
        yield self._made(set())

    def _keep(self, held: list[tuple], timed: bool = True) -> None:
        for timer in list(self.handle.listTimers()) if timed else ():  # who holds nothing has no timer
            self.handle.deleteTimer(timer)
        if not held:
            self.held.clear()
            return
        self.held.put([(k, at, e.tolist(), hits) for k, at, e, hits in held])
        self.handle.registerTimer((min(h[1] for h in held) + self.seconds + 1) * 1000)

    def _made(self, out: set) -> pd.DataFrame:
        rows = sorted(out)
        return pd.DataFrame({"query_id": pd.Series([r[0] for r in rows], dtype="int64"), "node_id": pd.Series([r[1] for r in rows], dtype="int64"), "reason": pd.Series([REASON] * len(rows), dtype="object"), "signal": pd.Series([SIGNALS[REASON]] * len(rows), dtype="float64"), "created_at": pd.Series([r[2] for r in rows], dtype="int64")})

    def close(self) -> None:
        pass


def requeried(log: DataFrame, seconds: int = 300, threshold: float = 0.85, top: int = 3, late_seconds: int = 600) -> DataFrame:
    """The stream of feedback on a stream of queries (id, actor, ts, embedding, hits); off where no pair can count."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if threshold > 1 or seconds <= 0 or top <= 0:
        log = log.where("false")
    floats = log.schema["embedding"].dataType.simpleString() == "array<float>"  # half the bytes, the same doubles in the task
    given = log.select("actor", "ts", F.col("id").cast("long").alias("id"), F.unix_timestamp("ts").alias("at"), F.col("embedding").cast("array<float>" if floats else "array<double>").alias("embedding"), F.coalesce(F.col("hits").cast("array<long>"), F.array().cast("array<long>")).alias("hits"))
    timed = given.where("id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", f"{late_seconds} seconds")
    return timed.groupBy("actor").transformWithStateInPandas(Recent(seconds, threshold, top, late_seconds), EMITTED, "append", "EventTime")


def upserted(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Start writing feedback by (query_id, node_id, reason) into the keyed table of `feedback`."""

    def apply(batch: DataFrame, epoch: int) -> None:
        once = batch.persist()  # two tables come from it, and its state must be computed once
        if not store(batch.sparkSession, folder).write(epoch, _tables(once)):
            once.write.format("noop").mode("overwrite").save()  # written before; the state still has to follow
        once.unpersist()

    return stream.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def store(spark, folder: str) -> Epochs:
    return Epochs(spark, folder, {"feedback": f"id string, {EMITTED}", "ids": "id string"})


def _tables(batch: DataFrame) -> dict[str, DataFrame]:
    rows = batch.withColumn("id", F.concat_ws("|", "query_id", "node_id", "reason")).groupBy("id").agg(F.min(F.struct("created_at", "query_id", "node_id", "reason", "signal")).alias("r"))
    return {"feedback": rows.select("id", "r.query_id", "r.node_id", "r.reason", "r.signal", "r.created_at"), "ids": rows.select("id")}


def feedback(spark, folder: str) -> DataFrame:
    """(query_id, node_id, reason, signal, created_at), one row for each key."""
    return store(spark, folder).current("feedback").drop("id", "epoch")
