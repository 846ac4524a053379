"""Streams give what batches give, late rows are dropped, ingestion is incremental."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators.lexicon import IndexedNodes
from quillon.sources import files
from quillon.streaming import events as e


@pytest.fixture
def folder(spark, sf, tmp_path):
    x = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    x.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    return str(tmp_path)


def run(spark, frame, folder, name, mode="append"):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_tumbling_stream_equals_batch(spark, folder):
    batch = spark.read.parquet(f"{folder}/in")
    stream = run(spark, e.tumbling(e.read(spark, f"{folder}/in", batch.schema, 10), late="400 days"), folder, "tumble", "complete")
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(stream) == key(e.tumbling(batch))


def test_requery_stream_equals_batch(spark, folder):
    batch = spark.read.parquet(f"{folder}/in")
    stream = run(spark, e.requeries(e.read(spark, f"{folder}/in", batch.schema, 10), 864_000, "400 days"), folder, "requery")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, e.requeries(batch, 864_000).collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [[("2024-01-10 00:00:00", 1)], [("2024-01-20 00:00:00", 2)], [("2024-01-01 00:00:00", 3)], [("2024-02-20 00:00:00", 4)]]
    for k, r in enumerate(rows):
        spark.createDataFrame([(i, ts, 1, "view", 1.0, "{}") for ts, i in r], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"d{k}"))
    import shutil
    import time

    (tmp_path / "all").mkdir()
    schema = spark.read.parquet(str(tmp_path / "d0")).schema
    q = e.tumbling(e.read(spark, str(tmp_path / "all"), schema), late="1 day").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).start()
    for k in range(4):
        for f in (tmp_path / f"d{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "all" / f"{k}-{f.name}")
        q.processAllAvailable()
        time.sleep(0.1)
    q.stop()
    days = {str(r["start"])[:10] for r in spark.table("late").collect()}
    assert "2024-01-10" in days and "2024-01-01" not in days


COLUMNS = "id string, type string, name string, description string, body string, source_path string, project_key string, base boolean, local_only boolean, hash string, frontmatter_json string, updated_at long"


def parse(batch):
    made = files.parsed(batch.select(F.regexp_extract("path", "[^/]*$", 0).alias("path"), "content"), "docs_dir")
    at = batch.select(F.sha1(F.regexp_extract("path", "[^/]*$", 0).cast("binary")).alias("id"), F.unix_timestamp("modificationTime").alias("updated_at"), (F.col("length") == 0).alias("gone"))
    return made.join(at, "id").withColumn("hash", F.when(~F.col("gone"), F.col("hash"))).drop("gone")


def test_incremental_ingest(spark, tmp_path):
    """Added, updated, unchanged, late and removed files; each epoch writes its batch only, and a new checkpoint replays without effect."""
    told = []
    index = IndexedNodes(spark, str(tmp_path / "state"), COLUMNS)
    schema = spark.read.format("binaryFile").load(str(tmp_path)).schema

    def go(batch, checkpoint="ck"):
        e.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / batch)), index, parse, str(tmp_path / checkpoint), lambda df, k: told.append({r["status"]: r["count"] for r in df.groupBy("status").count().collect()}), compact_every=4).awaitTermination()

    def put(name, rows):
        frame = spark.createDataFrame([(f"/x/{p}", at, len(c), bytearray(c.encode())) for p, at, c in rows], "path string, at long, length long, content binary")
        frame.select("path", F.timestamp_seconds("at").alias("modificationTime"), "length", "content").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    big = [(f"f{k}.md", 10, f"page {k} " + "tide level gauge " * 50 + f" word{k}") for k in range(300)]
    put("in", [*big, ("a.md", 10, "one harbor"), ("b.md", 10, "two crane")])
    go("in")
    put("in", [("a.md", 20, "one wind"), ("b.md", 20, "two crane"), ("f1.md", 5, "older"), ("f2.md", 30, ""), ("nowhere.md", 30, "")])
    go("in")
    assert told == [{"added": 302}, {"updated": 1, "unchanged": 1, "late": 1, "removed": 1, "absent": 1}]
    assert index.store.bytes_of(1) < index.store.bytes_of(0) / 4
    put("in", [("c.md", 40, "three harbor")])
    go("in")
    put("in", [("c.md", 50, "three harbor")])
    go("in")
    assert told[2:] == [{"added": 1}, {"unchanged": 1}] and index.store.committed() == [] and index.store.base() == 3
    assert index.nodes().count() == 302
    hits = index.bm25(spark.createDataFrame([(1, "harbor"), (2, "wind")], "qid long, prompt string")).join(index.nodes(), "id")
    assert sorted((r["qid"], r["source_path"]) for r in hits.collect()) == [(1, "c.md"), (2, "a.md")]
    before = sorted(r["hash"] for r in index.nodes().collect())
    go("in", "other")  # all files once more, as one late batch whose epoch is taken
    assert sorted(r["hash"] for r in index.nodes().collect()) == before
