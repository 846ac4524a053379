"""Joins and searches over cells against products of everything, and what the bounds skip."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import cells
from quillon.plans import retrieve

SCHEMA = "id long, embedding array<double>, type string"


def clustered(n, groups, spread, seed, size=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, size))
    x = middles[rng.integers(0, groups, n)] + rng.normal(scale=spread, size=(n, size))
    return x * rng.uniform(0.1, 5, size=(n, 1))


def brute(x, ids, kinds, low, high):
    u = cells.unit(x.tolist())
    c = u @ u.T
    out = set()
    for i in range(len(ids)):
        for j in range(len(ids)):
            if ids[i] < ids[j] and kinds[i] == kinds[j] and low <= c[i, j] <= high:
                out.add((ids[i], ids[j]))
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)


@pytest.mark.parametrize(("spread", "low", "high"), [(0.05, 0.95, 2.0), (0.3, 0.5, 0.85), (2.0, 0.6, 2.0), (0.1, -0.5, 2.0)])
def test_join_equals_brute_force(spark, small, spread, low, high):
    x = clustered(260, 8, spread, 61)
    x[7], x[8] = 0, x[9]  # a zero vector, and the same one twice
    kinds = [("a", "b")[k % 3 == 0] for k in range(260)]
    frame = spark.createDataFrame([(k, v.tolist(), t) for k, (v, t) in enumerate(zip(x, kinds, strict=True))], SCHEMA).repartition(5)
    got = cells.pairs(frame, low, high, "type").collect()
    assert {(r["a"], r["b"]) for r in got} == brute(x, list(range(260)), kinds, low, high)
    assert len(got) == len({(r["a"], r["b"]) for r in got})


def test_bounds_skip_what_is_far(spark, small):
    x = clustered(600, 12, 0.03, 62)
    frame = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(x)], SCHEMA)
    done, every = cells.compared(frame, 0.95)
    assert every == 600 * 599 // 2 and done < every / 4


def test_search_equals_brute_force_and_skips_cells(spark, small):
    x = clustered(500, 10, 0.1, 63)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 500, 25)] + [(1000, None), (1001, [0.0] * 12)], "qid long, vector array<double>")
    index = cells.VectorCells(frame)
    key = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["cosine"], 6) + 0.0) for r in df.collect())
    want = key(retrieve.knn(frame, queries.where("vector IS NOT NULL"), 7))
    got = key(retrieve.top(index.candidates(queries, 7), 7, "cosine"))
    assert set(got) ^ set(want) == set()
    left, every = index.cells_read(queries.where("qid < 1000"), 7)
    assert left < every / 2
    near = {(q, i) for q, _, i, _ in key(retrieve.top(index.probed(queries, 7, 2), 7, "cosine")) if q < 1000}
    assert len(near & {(q, i) for q, _, i, _ in want if q < 1000}) >= 0.9 * len([1 for q, *_ in want if q < 1000])


def test_few_rows_other_sizes_and_none(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0, 0.0], "a"), (4, None, "a"), (5, [], "a"), (6, [1.0, 0.0], None), (7, [3.0, 0.0], None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {(r["a"], r["b"]) for r in cells.pairs(frame, 0.9, bucket="type").collect()} == {(1, 2), (6, 7)}
    assert cells.pairs(frame.limit(0), 0.9, bucket="type").count() == 0


@pytest.mark.parametrize("parts", [4, 48])
def test_blocks_of_a_search_meet_without_merged_partitions(spark, parts, monkeypatch):
    """the keys of both sides must hash alike, which shows only where small partitions are not merged."""
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 5)
    x = clustered(150, 6, 0.2, 64)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    queries = frame.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r["qid"], r["rank"], r["id"]) for r in retrieve.knn(frame, queries, 3).collect()}
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)
    unit = x.astype(np.float32).astype(float)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    want = {(q, rank, int(i)) for q in range(0, 150, 10) for rank, i in enumerate(np.argsort(-np.round(unit @ unit[q], 9), kind="stable")[:3])}
    assert got == want
