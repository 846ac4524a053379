"""Steps whose work must follow their input: what is shuffled, stored or held, by plans, counts and batches."""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions.chunks import chunked
from quillon.operators import audit, cells, lexicon, ranking, store
from quillon.operators.epochs import Epochs
from quillon.operators.graph import work_dir
from quillon.operators.lexicon import counted
from quillon.plans import retrieve


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_scope_gathers_keys_before_callers(spark):
    callers = spark.range(40).select(F.col("id").alias("caller"), F.lit("docs").alias("cwd"))
    sources = spark.range(60).select(F.concat(F.lit("docs/a/"), "id").alias("path"), F.concat(F.lit("k"), F.col("id") % 3).alias("project_key"))
    nodes = spark.sql("SELECT explode(array('k0', 'k1', 'other')) AS project_key")
    out = store.scope_of(callers, sources, nodes)
    assert sorted((r["caller"], r["project_key"]) for r in out.collect()) == sorted((c, k) for c in range(40) for k in ("k0", "k1"))
    assert re.search(r"Aggregate \[project_key#\d+, at#\d+\]", _plan(out))


def test_one_epoch_is_read_as_it_is(spark):
    e = Epochs(spark, work_dir(spark), {"t": "id long, x long", "ids": "id long"})
    rows = spark.range(5).withColumn("x", F.col("id") * 2)
    assert e.write(0, {"t": rows, "ids": lambda read: read("t").select("id")})
    assert "Join" not in _plan(e.current("t")) and e.current("ids").count() == 5
    e.write(1, {"t": rows.where("id = 1").withColumn("x", F.lit(9).cast("long")), "ids": rows.where("id IN (1, 2)").select("id")})
    e.write(2, {"t": rows.where("id = 3").withColumn("x", F.lit(8).cast("long")), "ids": rows.where("id = 3").select("id")})
    want = [(0, 0), (1, 9), (3, 8), (4, 8)]
    assert sorted((r["id"], r["x"]) for r in e.current("t").collect()) == want
    e.compact()
    assert sorted((r["id"], r["x"]) for r in e.current("t").collect()) == want


def test_terms_are_counted_where_they_stand(spark):
    texts = {1: ["b", "a", "b"], 2: [], 3: ["c"], 4: list("abcabca")}
    out = counted(spark.createDataFrame(list(texts.items()), "id long, w array<string>"))
    assert {(r["id"], r["term"], r["tf"]) for r in out.collect()} == {(k, t, n) for k, w in texts.items() for t, n in Counter(w).items()}
    assert "Exchange" not in _plan(out, "executedPlan")


def test_packing_needs_no_text(spark):
    hits = spark.createDataFrame([(1, k, "a b", "w " * (k + 1)) for k in range(4)], "qid long, rank int, line string, body string")
    whole = retrieve.pack(hits, 10, F.col("line"), F.col("body"))
    bare = hits.select("qid", "rank", "line", retrieve.token_estimate(F.col("body")).alias("body_tokens"))
    row = lambda df: sorted((r["rank"], r["used"], r["with_body"]) for r in df.collect())
    assert row(retrieve.pack(bare, 10, F.col("line"))) == row(whole)


def test_texts_of_hits_are_not_shuffled(spark, monkeypatch):
    hits = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (2, 0, 3)], "qid long, rank int, id long")
    texts = spark.createDataFrame([(k, None if k == 5 else "w" * k) for k in range(9)], "id long, body string")
    first = F.substring("body", 1, 2)
    out = retrieve.with_text(hits, 3, texts, "body", first)
    rows = lambda df: sorted(((r["qid"], r["rank"], r["id"], r["body"]) for r in df.collect()), key=str)
    assert rows(out) == [(1, 0, 3, "ww"), (1, 1, 5, None), (2, 0, 3, "ww")]
    assert "hashpartitioning" not in _plan(out, "executedPlan")
    monkeypatch.setattr(retrieve, "MOST_HITS", 2)
    assert rows(retrieve.with_text(hits, 3, texts, "body", first)) == rows(out)


def test_only_wanted_terms_are_counted(spark):
    docs = spark.createDataFrame([(3, ["a", "b", "a"]), (1, ["c"]), (0, []), (2, ["b", "d"])], "dl long, w array<string>")
    said = spark.createDataFrame([("",), ("a",), ("b",), ("z",)], "term string")
    out = retrieve.term_counts(docs, said)
    assert {(r["term"], r["df"], r["dl"]) for r in out.collect()} == {("", 4, 6), ("a", 1, 3), ("b", 2, 5)}
    plan = _plan(out)
    assert 0 <= plan.index("Aggregate") < plan.index("LeftSemi")  # the join is below the counts
    assert not {"c", "d"} & {r["term"] for r in out.collect()} and retrieve.term_counts(docs, None).count() == 5


def test_best_of_prompts_leave_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST_TASKS", 8)
    text = F.concat(F.lit("tide w"), (F.col("id") % 7).cast("string"), F.lit("x"))
    prompts = spark.createDataFrame([(1, "tide"), (2, "tide w3x")], "qid long, prompt string")
    made = [retrieve.bm25(spark.range(0, 300, numPartitions=n).select("id", text.alias("text")), prompts, 3) for n in (60, 2)]
    assert made[0].count() <= 2 * 3 * max(8, 2 * spark.sparkContext.defaultParallelism)  # a task leaves 3 rows for each prompt
    rows = [sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in retrieve.top(m, 3).collect()) for m in made]
    assert rows[0] == rows[1] and [(q, i) for q, _, i, _ in rows[0]] == [(1, 0), (1, 1), (1, 2), (2, 3), (2, 10), (2, 17)]


@pytest.fixture
def vectors(spark):
    x = np.random.default_rng(3).normal(size=(600, 16))
    return x, spark.createDataFrame([(k, v.tolist(), "t") for k, v in enumerate(x)], "id long, embedding array<double>, type string")


def test_random_vectors_are_not_copied_to_cells(spark, vectors, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    x, frame = vectors
    rows, _ = cells._placed(frame, 0.3, "type", cells.MOST_CENTRES)
    assert rows.count() == len(x)


def test_contradictions_shuffle_no_pairs(spark, vectors, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 8)
    x, frame = vectors
    nodes = frame.select("id", F.when(F.col("id") % 5 == 0, "never").when(F.col("id") % 7 != 0, "fine").alias("body"))
    out = audit.contradictions(frame, nodes, 0.3, 0.6)
    u = x / np.sqrt((x**2).sum(axis=1))[:, None]
    c = u @ u.T
    want = {(str(a), str(b)) for a, b in zip(*np.nonzero((c >= 0.3) & (c <= 0.6)), strict=True) if a < b and (a % 5 == 0 or b % 5 == 0)}
    assert {tuple(r["node_ids"]) for r in out.collect()} == want
    plan = _plan(out)
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_chunks_come_in_small_batches(spark):
    docs = spark.range(3000, numPartitions=1).select("id", F.lit("one two").alias("body"))

    def rows(parts):
        import pyarrow as pa

        for p in parts:
            yield pa.RecordBatch.from_arrays([pa.array([p.num_rows], pa.int64())], names=["n"])

    sizes = [r["n"] for r in chunked(docs).mapInArrow(rows, "n long").collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 1000


def test_co_occurrence_is_added_in_one_join(spark):
    columns = "src_id long, dst_id long, relation string, weight double, created_at long, source string, confidence double"
    edges = spark.createDataFrame([(1, 2, "co_occurs_with", 4.95, 1, "x", 0.5), (1, 2, "mentions", 0.5, 2, "y", 0.5), (3, 4, "co_occurs_with", 1.0, None, "x", 0.5)], columns)
    counted_ = spark.createDataFrame([(1, 2, 0.3), (3, 4, 0.2), (5, 6, 0.1)], "src long, dst long, weight double")
    out = store.add_co_occurrence(edges, counted_, 9)
    new = "co_occurrence"
    want = {(1, 2, "co_occurs_with", 5.0, 1, new, 1.0), (1, 2, "mentions", 0.5, 2, "y", 0.5), (3, 4, "co_occurs_with", 1.2, None, new, 1.0), (5, 6, "co_occurs_with", 0.1, 9, new, 1.0)}
    assert {tuple(r) for r in out.collect()} == want
    assert "Aggregate" not in _plan(out)


def test_shares_of_words_are_counted_by_bytes_and_rounded_once(spark, sf, monkeypatch):
    """no pair is rounded by Spark, a text is read once whatever the blocks of prompts, and repeated words count as in the scalar function."""
    from quillon import catalog

    assert "round(" not in _plan(catalog.queries()["lexical_score"](spark, sf))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieve, "PAIRS", 12)
    monkeypatch.setattr(retrieve, "PIECES", 2)
    many = [f"w{k:03d}" for k in range(300)]  # a count beyond a byte, and shares of 128 that end in half a millionth
    texts = spark.createDataFrame([(k, " ".join(many[: k * 60 + 1]) if k else None) for k in range(6)] + [(9, "(tide),W tide-gauge;")], "id long, text string").coalesce(1)
    words = [many, many[:128], ["tide", "tide", "xyz"], [], None, ["de", "tide-gauge", "a,b"], ["w"] * 3]
    p = spark.createDataFrame(list(enumerate(words)), "qid long, w array<string>")
    key = lambda df: sorted((r["qid"], r["id"], r["lexical"]) for r in df.collect())
    got = key(retrieve.all_lexical(texts, p, 6))
    assert len(got) == 49 and (2, 9, 0.666667) in got and (1, 1, 0.476563) in got
    monkeypatch.setattr(retrieve, "HELD", 1)
    assert got == key(retrieve.all_lexical(texts, p, 6))


class _Here:
    """As much of a DataFrame as the ranker asks for; its function runs in this process."""

    selectExpr = coalesce = lambda self, *_: self
    sparkSession = property(lambda self: self)
    sparkContext = property(lambda self: self)
    defaultParallelism = 1

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ranker_steps_follow_blocks_and_its_bounds_lose_nothing(monkeypatch, k):
    """no step for each prompt and block; documents that are passed over are not among the best, ties and odd rows included."""
    for name, n in {"WEIGHTS": 4000, "BLOCK": 64, "FIRST": 16, "READ": 100}.items():
        monkeypatch.setattr(ranking, name, n)
    rng = np.random.default_rng(3)
    words = [f"t{j}" for j in range(200)]
    pick = lambda n: [words[j] for j in np.minimum(rng.zipf(1.3, n) - 1, 199)]
    docs = [(1000 - i, pick(int(rng.integers(1, 60))) if i % 50 else []) for i in range(400)]
    docs += [(5000 + i, docs[i][1]) for i in range(40)]  # equal scores, the smaller id first
    prompts = {q: sorted(set(pick(12))) + ["nowhere"] * (q % 9 == 0) for q in range(400)} | {900: ["nowhere"], 901: [words[0]]}
    df = Counter(t for _, w in docs for t in set(w))
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    counts = pa.table({"term": pa.array(list(df)), "df": pa.array(list(df.values()), pa.int64())})
    batch = pa.record_batch({"id": pa.array([i for i, _ in docs]), "dl": pa.array([len(w) for _, w in docs]), "w": pa.array([w for _, w in docs], pa.list_(pa.string())), "tf": pa.array([[1] * len(w) for _, w in docs], pa.list_(pa.int64()))})

    def ranked(asked: dict) -> tuple[list, int]:
        wanted = pa.table({"qid": pa.array([q for q, w in asked.items() for _ in w], pa.int64()), "term": pa.array([t for w in asked.values() for t in w])})
        here, calls = _Here(), 0

        def count(frame, event, arg):
            nonlocal calls
            calls += event in ("call", "c_call")

        ranking.best(here, wanted, counts, n, mean, k)
        sys.setprofile(count)
        out = list(here.run(iter([batch.slice(0, 150), batch.slice(150)])))
        sys.setprofile(None)
        return [tuple(r.values()) for b in out for r in b.to_pylist()], calls

    got = ranked(prompts)[0]
    want = {}
    for q, terms in prompts.items():
        scored = []
        for i, w in docs:
            tf = Counter(w)
            s = sum(np.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in tf)
            scored += [(-round(s, 9), i)] if s else []
        want |= {(q, i): -s for s, i in sorted(scored)[:k]}
    assert {(q, i) for q, i, _ in got} == set(want) and all(abs(want[q, i] - s) < 2e-9 for q, i, s in got)
    monkeypatch.setattr(ranking, "WEIGHTS", 1 << 16)
    assert ranked(prompts)[1] < 2 * ranked({q: w for q, w in prompts.items() if q < 100})[1]


def test_terms_are_split_from_bytes_as_the_pattern_splits():
    """the ranker reads texts in one pass over their bytes, as the pattern of search_tokens does, slices included."""
    texts = ["", "a_b ab abc.", "tide gaugeétude naïve_9 \U0001f600x", None, "---", "abc", "x" * 300 + "-yz0"] * 3
    made = pa.array([(t or "").lower() + " " for t in texts])
    for part in (made, made.slice(2, 9), made.slice(3, 1), made.slice(0, 0)):
        words, ends = ranking.split(part)
        want = [re.findall("[a-z0-9_]{3,}", t) for t in part.to_pylist()]
        assert [words.to_pylist()[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_ranking_shuffles_no_word(spark, monkeypatch):
    """texts go to the ranker as they are; neither their words nor counts of other words are rows of a plan."""
    docs = spark.createDataFrame([(1, "Tide gauge TIDE"), (2, None), (3, "gauge of winds"), (4, "tide")], "id long, text string")
    prompts = spark.createDataFrame([(7, "tide, gauge?"), (8, "zebra")], "qid long, prompt string")
    out = retrieve.bm25(docs, prompts, 2)
    assert "regexp_extract_all" not in _plan(out)
    want = retrieve.top(retrieve.bm25(docs, prompts), 2)
    key = lambda df: sorted((r["qid"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert key(retrieve.top(out, 2)) == key(want) != []


@pytest.mark.parametrize("k", [1, 4, 40])
def test_only_values_that_reach_the_last_place_are_sorted(spark, k):
    """the k best of a block without sorting all of it; words are counted without a list of them."""
    rng = np.random.default_rng(6)
    value = np.round(rng.normal(size=(7, 30)), 1)
    value[2, 3:9], value[4] = np.nan, 0.0
    row, place = retrieve.best_places(value, k)
    want = np.argsort(-value, axis=1, kind="stable")[:, :k]
    assert [place[row == r].tolist() for r in range(7)] == want.tolist()
    texts = spark.createDataFrame([("",), (None,), (" a\t\x0bb\r\n",), (" x y\x1cz ",)], "t string").select(retrieve.token_estimate(F.col("t")).alias("n"))
    assert [r["n"] for r in texts.collect()] == [1, 1, 3, 3] and "split(" not in _plan(texts)


def test_postings_are_cut_from_bytes(spark, monkeypatch):
    """an index is written without lists of words as rows; fields stay apart, caps and nulls count as before."""
    monkeypatch.setattr(lexicon, "ROWS", 3)
    monkeypatch.setattr(ranking, "READ", 2)
    monkeypatch.setattr(lexicon, "BODY_CAP", 14)
    nodes = spark.createDataFrame([("a", "tide", "gauge", "TIDE été_x ends here"), ("b", None, None, None), ("c", "har", "bor", "xy"), ("d", "wind", None, "wind wind")], "id string, name string, description string, body string")
    out = lexicon.posted(nodes.select("id", lexicon.fields(nodes).alias("text")))
    want = [("a", "end", 1), ("a", "gauge", 1), ("a", "tide", 2), ("c", "bor", 1), ("c", "har", 1), ("d", "wind", 3)]
    assert sorted(map(tuple, out.collect())) == want
    assert "regexp_extract_all" not in _plan(out) and "Exchange" not in _plan(out, "executedPlan")
