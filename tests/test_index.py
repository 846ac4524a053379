"""Stored indexes after any sequence of writes, and what those writes cost."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.chunks import embeddable
from quillon.operators import graph
from quillon.operators.graph import work_dir
from quillon.operators.lexicon import ChunkStore, IndexedNodes
from quillon.plans import retrieve

COLUMNS = "id long, name string, description string, body string"
WORDS = "tide level gauge river harbor crane north south wind".split()


def ranks(frame):
    return sorted((r["qid"], r["id"], round(r["score"], 9)) for r in frame.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_any_sequence_of_writes_equals_a_full_build(spark):
    rng = random.Random(41)
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    prompts = spark.createDataFrame([(1, "tide gauge"), (2, "wind and crane"), (3, ""), (4, None), (5, "zebra")], "qid long, prompt string")
    index, held = IndexedNodes(spark, work_dir(spark), COLUMNS), {}
    for step in range(6):
        rows = {rng.randrange(12): (text(2), rng.choice([None, text(3)]), rng.choice([None, text(8)])) for _ in range(4)}
        gone = [rng.randrange(12) for _ in range(2)]
        assert index.write(frame(spark, [(k, *v) for k, v in rows.items()]), spark.createDataFrame([(k,) for k in gone], "id long"))
        for k in gone:
            held.pop(k, None)
        held |= rows
        if step in (2, 4):
            index.compact()
        assert sorted(map(tuple, index.nodes().collect())) == sorted((k, *v) for k, v in held.items())
    full = IndexedNodes(spark, work_dir(spark), COLUMNS)
    full.write(frame(spark, [(k, *v) for k, v in held.items()]))
    assert ranks(index.bm25(prompts)) == ranks(full.bm25(prompts)) != []
    docs = spark.createDataFrame([(k, " ".join(x or "" for x in v)) for k, v in held.items()], "id long, text string")
    assert ranks(full.bm25(prompts)) == ranks(retrieve.bm25(docs, prompts))


def test_a_term_of_the_name_only_is_found(spark):
    index = IndexedNodes(spark, work_dir(spark), COLUMNS)
    index.write(frame(spark, [(1, "harbor_crane", None, "nothing here"), (2, "x", "north wind", None), (None, "harbor_crane", None, None)]))
    prompts = spark.createDataFrame([(1, "the HARBOR_CRANE please"), (2, "wind")], "qid long, prompt string")
    assert [(q, i) for q, i, _ in ranks(index.bm25(prompts))] == [(1, 1), (2, 2)]


def test_replays_change_nothing_and_writes_follow_the_batch(spark):
    index = IndexedNodes(spark, work_dir(spark), COLUMNS)
    many = [(k, f"name{k}", None, " ".join(random.Random(k).choices(WORDS, k=60)) + f" w{k}") for k in range(3000)]
    assert index.write(frame(spark, many), epoch=0)
    assert index.write(frame(spark, [(1, "a", None, "b"), (1, "z", None, "b")]), epoch=1)
    assert not index.write(frame(spark, [(1, "other", None, "c")]), epoch=1)
    assert index.store.bytes_of(1) < index.store.bytes_of(0) / 5
    got = {r["id"]: r["name"] for r in index.nodes().collect()}
    assert got[1] == "z" and len(got) == 3000
    before = ranks(index.bm25(spark.createDataFrame([(1, "tide w7")], "qid long, prompt string")))
    index.compact()
    assert index.store.committed() == [] and index.store.base() == 1
    assert ranks(index.bm25(spark.createDataFrame([(1, "tide w7")], "qid long, prompt string"))) == before


def test_an_uncommitted_epoch_is_not_seen(spark):
    index = IndexedNodes(spark, work_dir(spark), COLUMNS)
    index.write(frame(spark, [(1, "a", None, "b")]))
    files, path = index.store._files, index.store._path
    index.write(frame(spark, [(2, "c", None, "d")]))
    files.delete(path(f"{index.store.folder}/e=1/_done"), False)
    assert [r["id"] for r in index.nodes().collect()] == [1] and index.store.last() == 0
    assert index.write(frame(spark, [(3, "e", None, "f")]), epoch=1)
    assert sorted(r["id"] for r in index.nodes().collect()) == [1, 3]


def test_empty_index(spark):
    index = IndexedNodes(spark, work_dir(spark), COLUMNS)
    prompts = spark.createDataFrame([(1, "tide")], "qid long, prompt string")
    assert index.bm25(prompts).count() == 0 and index.nodes().count() == 0
    with pytest.raises(StopIteration):
        IndexedNodes(spark, work_dir(spark), "name string")


def test_chunks_are_replaced_by_node_and_dimensions_are_checked(spark):
    store = ChunkStore(spark, work_dir(spark), 2)
    rows = lambda *x: spark.createDataFrame(list(x), "id long, chunk_idx int, chunk_text string, embedding array<float>")
    store.replace(rows((1, 0, "a", [1.0, 0.0]), (1, 1, "b", None), (2, 0, "c", [0.0, 1.0]), (2, 0, "d", [0.0, 1.0]), (None, 0, "x", None)))
    store.replace(rows((1, 0, "new", [1.0, 1.0])))
    got = lambda: sorted((r["id"], r["chunk_idx"], r["chunk_text"]) for r in store.chunks().collect())
    assert got() == [(1, 0, "new"), (2, 0, "d")]
    with pytest.raises(Exception, match="has not 2 dimensions but 3"):
        store.replace(rows((3, 0, "e", [1.0, 0.0, 0.0])))
    assert got() == [(1, 0, "new"), (2, 0, "d")] and store.store.last() == 1
    store.compact()
    store.replace(rows(), spark.createDataFrame([(2,)], "id long"))
    assert got() == [(1, 0, "new")]


def test_a_node_without_a_body_is_embedded_by_its_description_or_name(spark):
    rows = [(1, "n", "d", "text here"), (2, "n", "about", ""), (3, "n", "", None), (4, None, None, " "), (5, "", "", "")]
    got = {r["id"]: r["chunk_text"] for r in embeddable(frame(spark, rows)).collect()}
    assert got == {1: "text here", 2: "about", 3: "n"}


def test_block_for_a_prompt(spark):
    rows = [(1, 0, 7, "t", "name", "two\nlines ", "a\r\nb\x0bc\n\nd\n"), (1, 1, 8, None, "", None, "x" * 399 + " " + "y" * 5), (1, 2, 9, "t", None, "d", None)]
    hits = spark.createDataFrame(rows, "qid long, rank int, id long, type string, name string, description string, body string")
    from pyspark.sql import functions as F

    lines = ["- [ref:7] [t] name: two lines"]
    lines += [f"  {x}" for x in rows[0][-1].splitlines()] + ["- [ref:8]", "  " + "x" * 399 + "...", "- [ref:9] [t]: d"]
    want = "\n".join(["## Relevant memory", "", *lines, "", "intent: debug | tokens used: 12 | k: 3"])
    assert [r["block"] for r in retrieve.block(hits, F.lit("debug"), F.lit(12)).collect()] == [want]


def test_scopes_of_an_ego_network(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 1), (2, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(1, "p", False), (2, None, False), (3, "q", False), (4, "q", True), (5, "p", False), (6, None, None), (9, None, True)], "id long, project_key string, base boolean")
    start = spark.createDataFrame([(1,), (77,)], "id long")
    of = lambda **k: {(r["id"], r["hop"], r["why"]) for r in graph.scoped_ego(edges, nodes, start, **k)[0].collect()}
    assert of(hops=2, keys=["p"]) == {(1, 0, "strict"), (2, 1, "boundary"), (9, 1, "strict")}
    assert of(hops=9, keys=["p"]) == {(1, 0, "strict"), (2, 1, "boundary"), (9, 1, "strict"), (4, 3, "strict"), (5, 4, "strict")}
    assert of(hops=0) == {(1, 0, "strict"), (2, 1, "strict"), (9, 1, "strict")} and of(hops=2, base_only=True) == {(9, 1, "strict")}
    inner = graph.scoped_ego(edges, nodes, start, 2, ["p"])[1]
    assert {(r["src"], r["dst"]) for r in inner.collect()} == {(1, 2), (9, 1)}


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_of_blocks_equals_all_pairs(spark, tmp_path, monkeypatch, k):
    """With k the same ranks come without a row for each pair of a prompt and a document, and ties go to the smaller id."""
    from quillon.operators import ranking

    monkeypatch.setattr(ranking, "BLOCK", 7)
    rng = random.Random(8)
    bodies = [" ".join(rng.choices(["harbor", "tide", "Wind", "w7", "abc", "xyz_1", "ab"], k=rng.randint(0, 9))) for _ in range(60)]
    docs = [(k, b) for k, b in enumerate(bodies + bodies[:20] + [None, ""])]
    prompts = spark.createDataFrame([(q, " ".join(rng.choices(["harbor", "tide", "wind", "abc", "nowhere", "xyz_1"], k=3))) for q in range(12)] + [(90, ""), (91, None), (92, "nowhere at all")], "qid long, prompt string")
    frame = spark.createDataFrame(docs, "id long, text string").repartition(3)
    key = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in retrieve.top(df, k).collect())
    want = key(retrieve.bm25(frame, prompts))
    made = retrieve.bm25(frame, prompts, k)
    assert key(made) == want != [] and made.count() <= 12 * k * 3
    index = IndexedNodes(spark, str(tmp_path / "i"), "id long, name string, description string, body string")
    index.write(frame.select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.col("text").alias("body")))
    assert key(index.bm25(prompts, k)) == want == key(index.bm25(prompts))
    assert retrieve.bm25(frame, prompts.where("qid > 89"), k).count() == 0 == retrieve.bm25(frame.limit(0), prompts, k).count()
    monkeypatch.setattr(ranking, "MOST_WANTED", 3)
    assert key(retrieve.bm25(frame, prompts, k)) == want
