"""The stateful stream of re-queries against the batch join, with late rows, replays and small batches."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillon.plans import feedback as batch
from quillon.streaming import requery

SCHEMA = "id long, actor long, ts timestamp, embedding array<double>, hits array<long>"


def log(rng, n):
    base = [np.array([rng.gauss(0, 1) for _ in range(8)]) for _ in range(4)]
    at, out = 1_700_000_000, []
    for k in range(n):
        at += rng.randint(0, 70)
        e = rng.choice(base) + np.array([rng.gauss(0, 0.15) for _ in range(8)])
        out.append((k, rng.randint(1, 4), at, None if rng.random() < 0.05 else e.tolist(), rng.sample(range(20), rng.randint(0, 5))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, actor long, at long, embedding array<double>, hits array<long>").select("id", "actor", F.timestamp_seconds("at").alias("ts"), "embedding", "hits")


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(51)
    rows = log(rng, 160)
    for k in range(0, 160, 40):
        part = rows[k : k + 40]
        rng.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # One row of each file's span comes late, but within the watermark.
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    requery.upserted(requery.requeried(stream, late_seconds=100_000), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = requery.feedback(spark, str(tmp_path / "out")).collect()
    want = batch.requeries(frame(spark, rows).where("embedding IS NOT NULL").withColumn("at", F.unix_timestamp("ts")))
    pairs = {(r["query_id"], r["node_id"]) for r in want.collect()}
    assert {(r["query_id"], r["node_id"]) for r in got} == pairs and len(got) == len(pairs) > 10
    assert all(r["signal"] == -0.5 and r["reason"] == "inferred_requery" for r in got)
    # The same files once more under a new checkpoint: epochs that were written stay as they are.
    requery.upserted(requery.requeried(stream, late_seconds=100_000), str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    assert {(r["query_id"], r["node_id"]) for r in requery.feedback(spark, str(tmp_path / "out")).collect()} == pairs


def test_state_ends_with_the_look_back(spark, tmp_path):
    e = [1.0, 0.0]
    for k, at in enumerate((0, 100, 10_000, 10_301, 10_302, 50_000)):
        frame(spark, [(k, 1, 1_700_000_000 + at, e, [7])]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = requery.upserted(requery.requeried(stream, late_seconds=1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r["query_id"], r["created_at"] - 1_700_000_000) for r in requery.feedback(spark, str(tmp_path / "out")).collect()}
    assert got == {(0, 100), (3, 10_302)}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_off_by_its_settings(spark, tmp_path):
    frame(spark, [(k, 1, 1_700_000_000 + k, [1.0], [7]) for k in range(3)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    requery.upserted(requery.requeried(stream, threshold=1.5), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert requery.feedback(spark, str(tmp_path / "out")).count() == 0


class Handle:
    """State and timers of one actor without a stream."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    exists = lambda self: bool(self.rows)
    get = lambda self: iter(self.rows)
    listTimers = lambda self: iter(self.timers)  # noqa: E731, N815
    getCurrentWatermarkInMs = lambda self: 0  # noqa: E731, N815

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_one_batch_holds_and_compares_the_look_back_only(monkeypatch):
    rng = random.Random(33)
    rows = log(rng, 3000)
    compared = []
    cosine = requery.alike
    monkeypatch.setattr(requery, "alike", lambda a, b: compared.append(1) or cosine(a, b))
    handle, recent = Handle(), requery.Recent(300, 0.85, 3, 600)
    recent.init(handle)
    out = set()
    # The ten rows before the last five come in a second batch: late, but by less than 600 seconds.
    for part in (rows[:-15] + rows[-5:], rows[-15:-5]):
        part = pd.DataFrame(rng.sample(part, len(part)), columns=["id", "actor", "at", "embedding", "hits"])
        for made in recent.handleInputRows((1,), iter([part[:700], part[700:]]), handle):
            out |= set(zip(made["query_id"], made["node_id"], made["created_at"], strict=True))
        assert len(handle.rows) < 100 and len(handle.timers) == 1
    asked = [r for r in rows if r[3] is not None]
    near = [(p, q) for k, p in enumerate(asked) for q in asked[k + 1 : k + 320] if 0 < q[2] - p[2] <= 300]
    assert out == {(p[0], hit, q[2]) for p, q in near if cosine(np.array(p[3]), np.array(q[3])) >= 0.85 for hit in p[4][:3]} and len(out) > 1000
    assert len(compared) <= 1.1 * len(near)
