"""Operators on small tables worked out by hand."""

from __future__ import annotations

import datetime
import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.functions.chunks import estimate, pack
from quillon.operators import cells, safeguards as sg
from quillon.operators import audit, graph, joins, writes
from quillon.plans import feedback, governance, retrieve
from quillon.sources import code, files, gitlog


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_mmr_prefers_relevance_at_one_and_diversity_below(spark):
    pool = spark.createDataFrame([(1, k, s, r, e) for k, s, r, e in [(10, 1.0, 0, [1.0, 0.0]), (11, 0.9, 1, [1.0, 0.01]), (12, 0.5, 2, [0.0, 1.0])]], "qid long, id long, score double, rank int, embedding array<double>")
    assert [r.id for r in retrieve.mmr(pool, 2, 1.0).orderBy("pick").collect()] == [10, 11]
    assert [r.id for r in retrieve.mmr(pool, 2, 0.5).orderBy("pick").collect()] == [10, 12]


def test_mmr_without_vectors_keeps_order(spark):
    pool = spark.createDataFrame([(1, k, 1.0 - k / 10, k, None) for k in range(4)], "qid long, id long, score double, rank int, embedding array<double>")
    assert [r.id for r in retrieve.mmr(pool, 3, 0.5).orderBy("pick").collect()] == [0, 1, 2]


@pytest.mark.parametrize("fusion,expected", [("weighted_rrf", 0.6), ("bm25_lead", 0.6), ("weighted_sum", 0.4 + 0.2)])
def test_fusion_stays_in_band(spark, fusion, expected):
    s = retrieve.Scoring(fusion=fusion)
    got = one(spark, retrieve.relevance(s, F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(0)))
    assert got == pytest.approx(expected)
    assert one(spark, retrieve.relevance(s, F.lit(0.0), F.lit(0.0), F.lit(None).cast("int"), F.lit(None).cast("int"))) == 0


def test_packing_stops_at_first_overflow(spark):
    hits = spark.createDataFrame([(1, 0, "a b c", "x"), (1, 1, "a " * 50, "x"), (1, 2, "a", "x")], "qid long, rank int, line string, body string")
    out = retrieve.pack(hits, 10, F.col("line"), F.col("body")).orderBy("rank").collect()
    assert [r["rank"] for r in out] == [0] and out[0]["with_body"]


def brute_chunks(body, most, overlap=1):
    """Sections as they stand; in large ones paragraphs are packed, the last ones of a chunk opening the next."""
    out, cut, lines = [], [[]], body.strip().splitlines(keepends=True)
    for line in lines:
        if re.match(r"[ \t]*###? ", line) and cut[-1]:
            cut.append([])
        cut[-1].append(line)
    for section in ("".join(x).strip() for x in cut):
        if section and estimate(section) <= most:
            out.append(section)
        elif section:
            paragraphs, at = [p for p in section.split("\n\n") if p.strip()], 0
            held = []
            while at < len(paragraphs):
                if held and sum(map(estimate, held)) + estimate(paragraphs[at]) > most:
                    out.append("\n\n".join(held))
                    held = held[len(held) - overlap :] if overlap else []
                held.append(paragraphs[at])
                at += 1
            out.append("\n\n".join(held))
    return out


def test_chunks_keep_sections_and_overlap_inside_large_ones():
    assert pack("# A\n\none\n\n## B\n\ntwo\n\n### C\n\nthree") == ["# A\n\none", "## B\n\ntwo", "### C\n\nthree"]
    assert pack("") == [] and pack("one") == ["one"] and pack("#### deep\n\nx\n\n#### more") == ["#### deep\n\nx\n\n#### more"]
    rng = random.Random(3)
    for _ in range(200):
        body = "\n\n".join(rng.choice(["# t", "## s", "### u", "  ## v", "w " * rng.randint(1, 40), "x\ny", " "]) for _ in range(rng.randint(0, 14)))
        for overlap in (0, 1, 2):
            assert pack(body, 40, overlap) == brute_chunks(body, 40, overlap)


def test_upsert_keeps_first_and_null_keys_meet(spark):
    now = spark.createDataFrame([(1, "a", 5), (None, "b", 6)], "id long, v string, created long")
    new = spark.createDataFrame([(1, "c", 9), (None, "d", 9), (2, "e", 9)], "id long, v string, created long")
    out = {r["id"]: (r["v"], r["created"]) for r in writes.upsert(now, new, ("id",), keep=("created",)).collect()}
    assert out == {1: ("c", 5), None: ("d", 6), 2: ("e", 9)}
    again = writes.upsert(writes.upsert(now, new, ("id",), keep=("created",)), new, ("id",), keep=("created",))
    assert {r["id"]: (r["v"], r["created"]) for r in again.collect()} == out


def test_rekey_replace_and_delete(spark):
    n = spark.createDataFrame([(1, "p1"), (2, "p2")], "id long, source_path string")
    assert rows(writes.rekey(n, spark.createDataFrame([(2, "q")], "id long, source_path string"))) == [(1, "p1"), (2, "q")]
    assert rows(writes.replace_group(n, spark.createDataFrame([(2, "z"), (2, "y")], "id long, source_path string"), "id")) == [(1, "p1"), (2, "y"), (2, "z")]
    assert rows(writes.delete(n, spark.createDataFrame([(1,)], "k long"), {"id": "k"})) == [(2, "p2")]


def test_reconcile_is_idempotent_and_dismissed_sticks(spark):
    schema = "type string, severity string, node_ids array<string>, description string, locus string, fingerprint string"
    fresh = spark.createDataFrame([("stale", "low", ["1"], "", None, "f1"), ("stale", "low", ["2"], "", None, "f2")], schema)
    queue = spark.createDataFrame([("f2", "stale", "low", ["2"], "", None, "dismissed", 1, 1), ("f3", "stale", "low", ["3"], "", None, "open", 1, 1), ("f4", "dup", "low", ["4"], "", None, "open", 1, 1), ("f1", "stale", "low", ["1"], "", None, "resolved", 1, 1)], "fingerprint string, type string, severity string, node_ids array<string>, description string, locus string, status string, first_seen long, last_seen long")
    a = audit.reconcile(queue, fresh, ["stale"], 9)
    got = {r["fingerprint"]: (r["status"], r["change"]) for r in a.collect()}
    assert got == {"f1": ("open", "reopened"), "f2": ("dismissed", "unchanged"), "f3": ("resolved", "resolved"), "f4": ("open", "kept")}
    b = audit.reconcile(a.drop("change"), fresh, ["stale"], 9)
    assert {r["fingerprint"]: r["status"] for r in b.collect()} == {k: v[0] for k, v in got.items()}


def test_similar_pairs_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.9)
    got = audit.similar_pairs(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>"), 0.9)
    assert sorted((r.a, r.b) for r in got.collect()) == want and want


def test_overlap_join_equals_theta_join(spark):
    rng = np.random.default_rng(2)
    left = [(int(f), k, int(a), int(a + w)) for k, (f, a, w) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 500, 80), rng.integers(0, 200, 80), strict=True))]
    right = [(int(f), k, int(a), int(a + w)) for k, (f, a, w) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 500, 80), rng.integers(0, 200, 80), strict=True))]
    got = joins.overlaps(spark.createDataFrame(left, "f int, i int, a long, b long"), spark.createDataFrame(right, "f int, j int, c long, d long"), "f")
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for f, i, a, b in left for g, j, c, d in right if f == g and a <= d and c <= b)


def shuffled(spark) -> int:
    """Bytes that the session has shuffled so far."""
    known = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(known.apply(k).totalShuffleWrite() for k in range(known.size()))


@pytest.mark.parametrize("most", [2, 64])
def test_references_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "HUNKS", most)
    rng = random.Random(12)
    line = lambda wide: (lambda a: (a, a + rng.randint(0, wide)))(rng.randint(0, 300))
    spans = [(rng.randint(0, 2), k % 20, *line(90)) for k in range(40)]
    spans += spans[:3]
    hunks = [(rng.randint(0, 15), rng.randint(0, 3), *line(150)) for _ in range(90)] + [(3, None, 1, 5), (3, 1, 20, 10)]
    want = {}
    for f, s, a, b in spans:
        for c, g, x, y in hunks:
            if f == g and a <= y and x <= b and x <= y:
                want[c, f, s, a, b] = want.get((c, f, s, a, b), 0) + min(b, y) - max(a, x) + 1
    brute = sorted((*k, round(max(0.3, min(1.0, n / max(1, k[4] - k[3] + 1))), 9)) for k, n in want.items())
    real = [h for h in hunks if h[2] <= h[3]]
    got = joins.references(spark.createDataFrame(spans, "file long, symbol long, a long, b long"), spark.createDataFrame(real, "commit_id long, file long, a long, b long"))
    assert [(*r[:5], round(r[5], 9)) for r in rows(got.select("commit_id", "file", "symbol", "a", "b", "confidence"))] == brute


def test_references_do_not_shuffle_pairs(spark):
    """900,000 pairs of symbols and commits; only the two tables are shuffled."""
    spans = spark.range(300).select(F.lit(1).alias("file"), F.col("id").alias("symbol"), F.lit(10).cast("long").alias("a"), F.lit(30).cast("long").alias("b"))
    hunks = spark.range(3000).select(F.col("id").alias("commit_id"), F.lit(1).alias("file"), F.lit(5).cast("long").alias("a"), F.lit(20).cast("long").alias("b"))
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # hunks that don't fit a broadcast
    try:
        assert joins.references(spans, hunks).agg(F.count_if(F.col("confidence") > 0)).first()[0] == 900_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    time.sleep(1)  # the store is told of a task's bytes a little later
    assert shuffled(spark) - before < 2_000_000


@pytest.mark.parametrize("files", [100_000, 1])
def test_commits_of_one_range_come_apart_last(spark, monkeypatch, files):
    """a symbol meets a range once, whatever the number of its commits; lists, salts, deals and lines that are null lose no pair."""
    for name, n in {"LIST": 3, "SALT": 16, "DEAL": 4, "TASK_COMMITS": 8, "FILES": files, "HUNKS": 2}.items():
        monkeypatch.setattr(joins, name, n)
    rng = random.Random(14)
    spans = [(f"f{rng.randint(0, 4)}", k % 9 or None, a, a + rng.randint(0, 100)) for k in range(30) for a in [rng.randint(0, 200)]]
    hunks = [(k, f"f{k % 3}", 10 * (k % 4), 10 * (k % 4) + 100 * (k % 2)) for k in range(200)]
    hunks += [(k, f"f{k % 4}", a, a + 30) for k in range(20) for a in rng.sample(range(200), k % 4)]
    hunks += [(3, "f0", None, 5), (4, "f1", 7, None), (None, "f1", 7, 9), (5, None, 7, 9)]
    want = {}
    for f, s, a, b in set(spans):
        m = spans.count((f, s, a, b))
        for c, g, x, y in hunks:
            if f == g and None not in (c, x, y) and a <= y and x <= b:
                want[c, f, s, a, b] = want.get((c, f, s, a, b), 0) + (min(b, y) - max(a, x) + 1) * m
    frames = spark.createDataFrame(spans, "file string, symbol long, a long, b long"), spark.createDataFrame(hunks, "commit_id long, file string, a long, b long")
    got = joins.references(*frames, digits=6)
    brute = {k: round(max(0.3, min(1.0, n / (k[4] - k[3] + 1))), 6) for k, n in want.items()}
    made = got.collect()
    assert len(made) == len(brute) and all(abs(brute[tuple(r)[:5]] - r["confidence"]) < 2e-6 for r in made)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("explode(_all") < plan.index("round(") < plan.index("Join Inner")
    assert joins.references(frames[0], frames[1].limit(0)).count() == 0


def test_provenance_without_commits_equals_the_walk(spark):
    """memories meet symbols, not commits."""
    rng = random.Random(13)
    spans = spark.createDataFrame([(rng.randint(0, 3), k % 15, a, a + rng.randint(0, 60)) for k in range(40) for a in [rng.randint(0, 300)]], "file long, symbol long, a long, b long")
    hunks = spark.createDataFrame([(k % 40, rng.randint(0, 4), a, a + rng.randint(0, 20)) for k in range(80) for a in [rng.randint(0, 300)]], "commit_id long, file long, a long, b long")
    of = lambda n: spark.createDataFrame([(c, c % n) for c in range(0, 50, n)] + [(4, 1)], "commit_id long, memory long")
    refs = joins.references(spans, hunks).select("commit_id", "symbol").distinct()
    assert rows(joins.provenance_of(spans, hunks, of(2), of(3))) == rows(joins.provenance(refs, of(2), of(3))) != []


def test_cycles_and_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)], "src long, dst long")
    assert rows(graph.cycles(e)) == [(1, 1), (2, 1), (3, 1), (5, 5)]
    assert rows(graph.components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 6)]
    assert graph.cycles(e.where("src = 6")).count() == 0
    assert rows(graph.bfs(e, spark.createDataFrame([(1,)], "id long"), 2, directed=True)) == [(1, 0), (2, 1), (3, 2)]


def test_tasks_follow_rows(spark, monkeypatch):
    """More rows are more tasks, beyond the session's number, where a task's share would grow; the rows stay the same."""
    r = spark.createDataFrame([(k // 4, k * 7 % 50) for k in range(400)] * 2, "query_id long, node_id long")
    e = spark.createDataFrame([(k, k % 9, rel) for k in range(40) for rel in ("calls", "method_of", "routes_to")] * 2, "src long, dst long, relation string")
    made = lambda: (graph.co_occurrence(r), graph.symbol_detail(e, e.select(F.col("src").alias("id"))))
    few = [rows(df) for df in made()]
    monkeypatch.setattr(graph, "TASK_ROWS", 20)
    pairs, detail = made()
    assert [rows(pairs), rows(detail)] == few and len(set(few[1])) == len(few[1])
    assert pairs.rdd.getNumPartitions() == 80
    assert ", 12), REPARTITION_BY_NUM" in detail._jdf.queryExecution().executedPlan().toString()


def test_layout_is_deterministic(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (10, 11)], "src long, dst long")
    one_, two = (graph.layout(e).orderBy("id").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(one_, two)
    assert len(one_) == 6 and np.isfinite(one_[["x", "y"]].to_numpy()).all()


def test_feedback_latest_explicit_wins(spark):
    f = spark.createDataFrame([(1, 1, 1, "thumbs_up", 1.0, 5), (2, 1, 1, "thumbs_down", -1.0, 9), (3, 1, 1, "cite_copied", 0.5, 99), (4, 1, 2, "inferred_requery", -0.5, 1), (5, 1, 2, "cite_copied", 0.5, 1)], "id long, query_id long, node_id long, reason string, signal double, created_at long")
    assert rows(feedback.reduced(f)) == [(1, 1, -1.0), (1, 2, 0.5)]


def test_tuning_improves_and_guards(spark):
    c = [(q, "val" if q % 2 else "train", n, 1.0 if n == 0 else 0.0, 0.0, 0.0, 0.0, 0.0, 1.0 if n == 1 else 0.0) for q in range(40) for n in range(3)]
    comp = spark.createDataFrame(c, "query_id long, part string, node_id long, vector double, graph double, recency double, type double, project double, lexical double")
    good = spark.createDataFrame([(q, 1, 1.0) for q in range(40)], "query_id long, node_id long, signal double")
    start = dict(zip(feedback.COMPONENTS, (0.25, 0.15, 0.1, 0.1, 0.05, 0.2), strict=True))
    out = feedback.tuned(comp, good, start)
    assert out["status"] == "improved" and out["after"] == 1.0 and all(0 <= w <= 1 for w in out["weights"].values())
    assert feedback.tuned(comp.where("query_id < 5"), good, start)["status"] == "too_few"


def test_rules_fail_open(spark):
    r = governance.parse_rules(spark.createDataFrame([("not json",), ('{"id":"a","modality":"LOUD"}',)], "rule string"))
    assert {x["modality"] for x in r.collect()} == {"SHOULD"}


@pytest.mark.parametrize("text,expected", [("Fixes: a, b\ncloses: a\nRefs:c", ["a", "b", "c"]), ("fix: a", []), ("", [])])
def test_trailers(spark, text, expected):
    assert one(spark, t.trailers(F.lit(text))) == expected


def test_concepts(spark):
    body = "HarborGate opens tide_level_gauge and MIN_DEPTH; Plain Word __init__ one_long_joined_x waterline_marks"
    assert one(spark, t.concepts(F.lit(body))) == ["HarborGate", "tide_level_gauge", "one_long_joined_x", "waterline_marks", "MIN_DEPTH"]


@pytest.mark.parametrize("path,key", [("C:\\a\\b", "C--a-b"), ("/srv/x/", "srv-x"), ("a//b", "a--b")])
def test_project_key(spark, path, key):
    assert one(spark, t.project_key(F.lit(path))) == key


def test_intents(spark):
    assert one(spark, t.intent_tags(F.lit("Why is the build failing here"))) == ["debug", "project-context"]
    assert one(spark, t.intent_tags(F.lit("hello"))) == ["none"]


def test_compact_count(spark):
    assert [one(spark, t.compact_count(F.lit(n))) for n in (7, 17919, 2000, 3_450_000)] == ["7", "17.9k", "2k", "3.4M"]


def test_python_units():
    source = "import os\nfrom a.b import c\n\n@app.get('/x')\ndef f():\n    'Doc.\\n\\nMore.'\n    g()\n    os.path.join()\n\nclass K:\n    @property\n    def m(self):\n        self.n()\n\nurlpatterns = [path('a/', views.home)]\n"
    u = code.extract("p/mod.py", source, "python")
    kinds = {(x["kind"], x["name"]) for x in u}
    assert {("module", "mod"), ("function", "f"), ("class", "K"), ("method", "m"), ("route", "GET /x"), ("route", "* a/")} == kinds
    f = next(x for x in u if x["name"] == "f")
    assert f["doc"] == "Doc." and [(c["receiver"], c["name"]) for c in f["calls"]] == [(None, "g"), ("os", "join")]
    assert next(x for x in u if x["kind"] == "module")["imports"] == ["os", "a.b"]


def test_script_and_go_units():
    js = "import x from './lib'\nexport function List() {\n  fetch('/api/items')\n  return (<ul/>)\n}\nconst go = () => x.run(1)\nclass A {}\napp.get('/items', h)\n"
    u = {(x["kind"], x["name"]) for x in code.extract("a.jsx", js, "javascript")}
    assert {("module", "a"), ("component", "List"), ("endpoint", "GET /api/items"), ("function", "go"), ("class", "A"), ("route", "GET /items")} == u
    go = 'package m\nimport (\n  "fmt"\n)\ntype S struct {\n}\nfunc (s *S) Run() {\n}\nfunc main() {\n}\n'
    u = {(x["kind"], x["name"], x["parent"]) for x in code.extract("m.go", go, "go")}
    assert {("module", "m", None), ("class", "S", None), ("method", "Run", "S"), ("function", "main", None)} == u
    assert [x["kind"] for x in code.extract("bad.py", "def (", "python")] == ["module"]


def test_unit_keys_and_edges(spark):
    src = spark.createDataFrame([("a.py", "import b\ndef f(): pass\ndef f(): pass\n"), ("b.py", "class C:\n    def m(self): pass\n")], "path string, text string")
    k = code.keyed(code.units(src))
    assert {"a.py::f", "a.py::f#2", "b.py::C.m"} <= {r["key"] for r in k.collect()}
    assert {("a.py", "b.py", "imports"), ("b.py::C.m", "b.py::C", "method_of"), ("a.py", "a.py::f", "defines")} <= {(r["src"], r["dst"], r["relation"]) for r in code.edges(k).collect()}


def test_tree_reader_and_log(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in {"a.md": "---\ntype: plan_doc\n---\n# T\nx", "sub/b.md": "plain", "c.txt": "no", "MEMORY.md": "x", "sub/skip.md": "s"}.items():
        (tmp_path / name).write_text(body)
    got = files.read_tree(spark, str(tmp_path), "memory_dir", exclude="skip.*")
    assert sorted(r["path"] for r in got.collect()) == ["a.md", "c.txt", "sub/b.md"]
    n = {r["name"]: r for r in files.parsed(got, "memory_dir").collect()}
    assert n["a"]["type"] == "plan_doc" and n["a"]["description"] == "T" and n["b"]["type"] == "memory_project"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.txt").write_text("s1\x1fann\x1f5\x1ffirst\x1fbody\nFixes: x\x1e\ns2\x1fbo\x1f9\x1fnext\x1f\x1e\n")
    log = gitlog.read_log(spark, str(tmp_path / "log"))
    assert [(r["sha"], r["at"]) for r in log.collect()] == [("s2", 9), ("s1", 5)]


def test_schema_migration(spark):
    from quillon import schema

    old = spark.createDataFrame([("a",)], "id string")
    made = schema.conform(old, "nodes", {"base": F.lit(False)})
    assert made.columns[:3] == ["id", "type", "name"] and made.first()["base"] is False
    assert all(schema.empty(spark, t_).count() == 0 for t_ in ("edges", "queries"))


def test_tools_need_confirmation_and_known_arguments(spark):
    from quillon.plans import registry

    registry.TOOLS.clear()
    registry.register(registry.Tool("wipe", lambda n=1: spark.range(n), "danger", {"n": "int"}))
    with pytest.raises(PermissionError):
        registry.call("wipe", n=2)
    with pytest.raises(TypeError):
        registry.call("wipe", True, m=2)
    assert registry.call("wipe", True, n=2).count() == 2
    with pytest.raises(ValueError):
        registry.register(registry.Tool("wipe", spark.range))


def test_judge_confirms_and_rejects(spark):
    from quillon.plans.registry import judged, solved

    f = spark.createDataFrame([("a", "low"), ("b", "low"), ("c", "low")], "fingerprint string, severity string")
    out = judged(f, lambda x: spark.createDataFrame([("a", True), ("b", False)], "fingerprint string, confirmed boolean"))
    assert rows(out) == [("a", "high"), ("c", "low")] and rows(judged(f, None)) == rows(f)
    assert solved(spark.createDataFrame([("t",)], "task string"), lambda x: 1 / 0).count() == 0


def test_hash_embedder_is_unit_and_stable():
    from quillon.functions.embed import hashed

    a, b = hashed(pd.Series(["alpha beta", "alpha beta"]))
    assert a == b and np.linalg.norm(a) == pytest.approx(1, abs=1e-6)
    assert not any(hashed(pd.Series([""]))[0])


def test_whole_table_queries_see_every_id(spark, sf):
    from quillon import catalog, views

    q = catalog.queries()
    ids = lambda df, c: {r[0] for r in df.select(c).distinct().collect()}
    nodes = ids(views.nodes(spark, sf), "id")
    assert ids(q["nonempty_lines"](spark, sf), "id") == nodes == ids(q["trailer_join"](spark, sf), "commit_id")
    scored = q["lexical_score"](spark, sf).groupBy("qid").count().collect()  # all pairs: a cut to the best is no part of it
    assert {r["qid"] for r in scored} == {k for k in nodes if k % 100 == 0} and all(r["count"] == len(nodes) for r in scored)
    assert any(k % 7 for k in ids(q["nearest_line"](spark, sf), "id"))
    assert any(k % 7 for k in ids(q["interval_overlap_refs"](spark, sf), "commit_id"))
    made = q["chunk_embeddings"](spark, sf)
    assert ids(made, made.columns[0]) == ids(views.nodes(spark, sf).where("body <> ''"), "id")


def test_safeguards_count_bytes(spark):
    prose = "".join(chr(0x4E00 + k * 37 % 3000) for k in range(3000))
    noise = bytes(np.random.default_rng(3).integers(0, 256, 20_000, dtype=np.uint8))
    files_ = [("a.md", prose.encode()), ("b.md", noise), ("c.md", b"\x01\x02ab" * 100), ("d.md", b"same line\n" * 20_000), ("e.md", b""), (".env", b"A_B=1\nC_D=2\nEE=3\n"), ("f.exe", b"x"), ("g.md", ("é" * 600 + "DO NOT EDIT").encode())]
    df = spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in files_], "path string, content binary, size long")

    def bits(x):
        n = len(x[:16_384])
        return -sum(c / n * math.log2(c / n) for c in Counter(x[:16_384]).values())

    got = {r["path"]: r["e"] for r in df.select("path", sg.entropy(F.col("content")).alias("e")).collect()}
    for path, content in files_:
        if content:
            assert got[path] == pytest.approx(bits(content))
    assert 7.5 > got["a.md"] and len(set(prose)) > 2 ** 7.5
    made = {r["path"]: (r["verdict"], r["reason"]) for r in sg.classify(df, (".md", ".env")).collect()}
    assert made["a.md"] == made["e.md"] == made["g.md"] == ("ok", None)
    share = sum(b < 32 and b not in (9, 10, 13) or b == 127 for b in noise[:8192]) / 8192
    assert share <= 0.3 and made["b.md"] == ("suspicious", f"high_entropy:{bits(noise):.2f}")
    assert made["c.md"] == ("suspicious", "binary_masquerade:0.50") and made["d.md"] == ("suspicious", "repeated_line_bloat:1.00")
    assert made[".env"] == ("suspicious", "suspected_secret:dotenv") and made["f.exe"] == ("auto_skipped", "unsupported_ext:.exe")


def test_concepts_are_defined_by_containment(spark):
    c = spark.createDataFrame([(1, "Tide_Level_Gauge"), (2, "tide_level"), (3, "LostThing"), (4, "abc"), (5, "zzz"), (3, "LostThing")], "id long, concept string")
    d = spark.createDataFrame([(2, "the TIDE_level_gaugeX", None), (9, None, "an ABCdef"), (3, "Lost Thing", "LostThing of its own node")], "id long, name string, description string")
    got = {(r["node_ids"][0], r["locus"], r["severity"]) for r in audit.undefined_concepts(c, d).collect()}
    assert got == {("2", "tide_level", "candidate"), ("3", "LostThing", "candidate"), ("5", "zzz", "candidate")}
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abAB", k=n))
    names, asked = [text(rng.randint(0, 30)) for _ in range(40)], [text(rng.randint(1, 9)) for _ in range(120)]
    got = audit.undefined_concepts(spark.createDataFrame(list(enumerate(asked)), "id long, concept string"), spark.createDataFrame([(k * 3, n, None) for k, n in enumerate(names)], "id long, name string, description string"))
    assert sorted(int(r["node_ids"][0]) for r in got.collect()) == [k for k, x in enumerate(asked) if not any(j * 3 != k and x.lower() in n.lower() for j, n in enumerate(names))]


def test_god_objects_by_kind(spark):
    owners = spark.createDataFrame([(1, "class", "K", "a.py"), (2, "class", "L", "a.py"), (3, "module", "m", "a.py"), (4, "module", "n", "x/tests/n.py"), (5, "module", "o", "a.py")], "owner long, kind string, name string, source_path string")
    members = spark.createDataFrame([(o, k) for o, n in ((1, 26), (2, 25), (3, 31), (4, 99), (5, 30)) for k in range(n)], "owner long, member long")
    assert {(r["node_ids"][0], r["severity"]) for r in audit.god_objects(members, owners).collect()} == {("1", "candidate"), ("3", "candidate")}


@pytest.mark.parametrize(
    "lines,path,expected",
    [(["*.md"], "a/b.md", True), (["**/*.md"], "b.md", True), (["/x"], "a/x", False), (["/x"], "x/y", True), (["a/*.py"], "a/b/c.py", False), (["a/**"], "a/b/c.py", True), (["a/**/c.py"], "a/c.py", True), (["build/"], "build", False), (["build/"], "q/build/z", True), (["*.log", "!keep.log"], "d/keep.log", False), (["[ab].txt"], "b.txt", True), (["[!ab].txt"], "b.txt", False), (["# c", ""], "# c", False), (["a?c"], "abc", True), (["a.c"], "abc", False)],
)
def test_ignore_lines(spark, lines, path, expected):
    assert one(spark, t.ignored(F.lit(path), lines)) is expected


def test_includes_by_kind(spark):
    paths = ["a.md", "b.markdown", "c.txt", "d.pdf", "e.py", "f.rs", "g.yaml", "h.png", "node_modules/x.py", "MEMORY.md", "s/t.kt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    read = lambda kind, **o: [r["path"] for r in df.where(files.wanted(F.col("path"), kind, **o)).orderBy("path").collect()]
    assert read("memory_dir") == read("plan_dir") == read("transcripts") == ["a.md", "b.markdown", "c.txt", "d.pdf"] and read("docs_dir") == []
    assert read("code_repo") == ["a.md", "b.markdown", "e.py", "f.rs", "g.yaml", "s/t.kt"]
    assert read("docs_dir", include="*.txt, s/*", exclude="c.*") == ["s/t.kt"]


def test_headers_nest(spark):
    text = "---\ntype: plan_doc\nname: 'x: y'\napplies:\n  - a\n  - \"b c\"\ntags: [p, q]\ndeep:\n  one: 1\n  two:\n    - z\nbase: yes\nnone:\n---\nbody"
    assert files.header(text) == {"type": "plan_doc", "name": "x: y", "applies": ["a", "b c"], "tags": ["p", "q"], "deep": {"one": 1, "two": ["z"]}, "base": "yes", "none": None}
    assert files.header("no header") == {} and files.header("---\n- a\n---\n") == {}
    with pytest.raises(ValueError):
        files.parsed(spark.createDataFrame([("a.xyz", bytearray(b"x"))], "path string, content binary"), "memory_dir")
    bad = files.parsed(spark.createDataFrame([("a.md", bytearray(b"ok \xff"))], "path string, content binary"), "memory_dir").first()
    assert bad["body"] == "ok \ufffd" and json.loads(bad["frontmatter_json"]) == {}


def brute_tuning(rows, good, start, passes=4, gain=0.001):
    def mrr(w):
        total = []
        for q in sorted({r[0] for r in rows}):
            order = sorted((r for r in rows if r[0] == q), key=lambda r: (-round(sum(w[c] * x for c, x in zip(feedback.COMPONENTS, r[2:], strict=True)), 9), r[1]))
            total.append(next((1 / k for k, r in enumerate(order, 1) if (q, r[1]) in good), 0.0))
        return sum(total) / len(total)

    weights, best = dict(start), mrr(start)
    for _ in range(passes):
        moved = False
        for c in feedback.COMPONENTS:
            for step in (0.05, -0.05, 0.10, -0.10):
                w = {**weights, c: weights[c] + step}
                if 0 <= w[c] <= 1 and mrr(w) > best + gain:
                    weights, best, moved = w, mrr(w), True
        if not moved:
            break
    return weights, best


def test_tuning_equals_sequential_search(spark):
    rng = random.Random(17)
    rows_ = [(q, n, *[rng.randint(0, 4) / 4 for _ in range(6)]) for q in range(36) for n in range(4)]
    good = {(q, n) for q, n, *_ in rows_ if rng.random() < 0.3}
    start = dict(zip(feedback.COMPONENTS, (0.02, 0.15, 0.1, 0.98, 0.05, 0.2), strict=True))
    comp = spark.createDataFrame([(q, "val", n, *map(float, x)) for q, n, *x in rows_], "query_id long, part string, node_id long, " + ", ".join(f"{c} double" for c in feedback.COMPONENTS))
    out = feedback.tuned(comp, spark.createDataFrame([(*g, 1.0) for g in good], "query_id long, node_id long, signal double"), start)
    weights, best = brute_tuning(rows_, good, start)
    assert out["after"] == pytest.approx(best) and out["weights"] == pytest.approx(weights) and out["status"] == "improved"


def test_cycles_without_the_last_task_equal_one_task(spark):
    rng = random.Random(9)
    e = spark.createDataFrame([(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(38)] + [(50 + k, 51 + k) for k in range(12)], "src long, dst long")
    assert rows(graph.cycles(e, one_task=0)) == rows(graph.cycles(e)) and graph.cycles(e).count() > 2


def test_layout_places_each_shape_once(spark, tmp_path, monkeypatch):
    """Six rings and six stars are two shapes, the largest component stands for itself, and shared positions are those of a component alone."""
    pairs = [(20 * k + i, 20 * k + (i + 1) % 5) for k in range(6) for i in range(5)] + [(1000 + 20 * k, 1000 + 20 * k + i) for k in range(6) for i in range(1, 6)] + [(5000 + i, 5001 + i) for i in range(30)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    monkeypatch.setattr(graph, "SHAPED", 0)
    alone = graph.layout(e).orderBy("id").toPandas()
    monkeypatch.setattr(graph, "SHAPED", 256)
    monkeypatch.setattr(graph, "work_dir", lambda spark: str(tmp_path))
    pd.testing.assert_frame_equal(graph.layout(e).orderBy("id").toPandas(), alone, check_exact=True)
    assert spark.read.parquet(f"{tmp_path}/shapes").count() == 2 and len(alone) == 6 * 5 + 6 * 6 + 31


def test_layout_uses_edges_at_every_size(spark):
    n = 2600  # two dense halves, one bridge
    rng = random.Random(2)
    half = n // 2
    pairs = {(rng.randrange(k), k) for k in range(1, half)} | {(half + rng.randrange(k), half + k) for k in range(1, half)} | {(rng.randrange(half), rng.randrange(half)) for _ in range(4000)} | {(half + rng.randrange(half), half + rng.randrange(half)) for _ in range(4000)} | {(0, half)}
    x = graph.spectral(n, np.array(sorted((a, b) for a, b in pairs if a != b)))
    side = np.sign(x[:half, 0]).sum(), np.sign(x[half:, 0]).sum()
    assert side[0] * side[1] < 0 and min(map(abs, side)) > 0.9 * half
    e = spark.createDataFrame(sorted((a, b) for a, b in pairs if a != b), "src long, dst long")
    made = graph.layout(e).toPandas()
    assert len(made) == n and np.isfinite(made[["x", "y"]].to_numpy()).all() and made[["x", "y"]].drop_duplicates().shape[0] > 0.99 * n
    assert graph.placed(graph.layout(e.limit(50))).count() > 0


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(6)
    have = [(rng.randint(0, 3), rng.randint(0, 60), k) for k in range(60)]
    want = [(k, rng.randint(0, 4), rng.randint(-5, 70)) for k in range(80)]
    got = joins.nearest(spark.createDataFrame(want, "id long, file long, a long"), spark.createDataFrame(have, "file long, a long, symbol long"), ["file"], "a")
    brute = [(k, min((abs(a - b), s) for f2, b, s in have if f2 == f)[1]) for k, f, a in want if any(f2 == f for f2, _, _ in have)]
    assert rows(got) == sorted(brute)


def test_nearest_of_one_key_with_many_rows_takes_no_square(spark):
    """200,000 places of one file; a window that starts anew at each row takes minutes."""
    n = 200_000
    have = spark.range(n).select(F.lit(1).alias("file"), (F.col("id") * 2).alias("a"), F.col("id").alias("symbol"))
    want = spark.range(n).select("id", F.lit(1).alias("file"), (F.col("id") * 2 + 1).alias("a"))
    begun = time.monotonic()
    assert joins.nearest(want, have, ["file"], "a").where("id = symbol").count() == n
    assert time.monotonic() - begun < 60


def test_session_counts_cut_a_day_by_seconds(spark, tmp_path, duck):
    """ids of a million and more; the event that is just a day old is out."""
    from quillon import catalog

    at = lambda s: datetime.datetime(2024, 5, 2, tzinfo=datetime.UTC).replace(tzinfo=None) - datetime.timedelta(seconds=s)
    made = [(2_000_001, at(86_400), 1), (2_000_002, at(86_399), 2), (3, at(0), 3), (5_000_000, at(5), 3), (999_999, at(86_400), 4)]
    spark.createDataFrame([(i, t, u, "view", 1.0, '{"k": 1}') for i, t, u in made], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sql = "WITH events AS (SELECT * FROM read_parquet('%s/events.parquet/*.parquet')), x AS (%s) SELECT session_id, n FROM x"
    want = sorted(duck.execute(sql % (tmp_path, catalog.oracle_sql()["session_counts"])).fetchall())
    assert rows(catalog.queries()["session_counts"](spark, str(tmp_path))) == want and [r[0] for r in want] == ["2", "3"]


def test_all_pairs_by_blocks_equal_the_scalar_functions(spark, monkeypatch):
    """Every pair is there, from blocks as from the scalar functions; nulls, zeros and other sizes too."""
    from quillon import catalog

    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieve, "PAIRS", 20)
    rng = np.random.default_rng(5)
    vectors = [(k, rng.normal(size=4).tolist()) for k in range(30)] + [(30, None), (31, [0.0] * 4), (32, [1.0, 2.0]), (33, [])]
    v = spark.createDataFrame(vectors, "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k, [x / 3 for x in e] if e else e) for k, e in vectors[:30:4] + vectors[30:]], "qid long, vector array<double>")
    words = ["tide", "tid", "har-bor", "de", "xyz"]
    texts = spark.createDataFrame([(1, "the tide\u2003har-bor"), (2, None), (3, ""), (4, "xyztidexyz de"), (5, "har bor")], "id long, text string").repartition(2)
    p = spark.createDataFrame([(k, words[: k % 6]) for k in range(7)] + [(9, ["xyz", "nowhere"])], "qid long, w array<string>")
    chunks = v.select((F.col("id") % 30 / 3).cast("long").alias("node_id"), "embedding")
    key = lambda df: sorted(((r[0], r[1], None if r[2] is None else round(r[2], 9) + 0.0) for r in df.collect()), key=repr)
    made = [lambda: retrieve.all_l2(v, q), lambda: retrieve.all_best_chunks(chunks, q), lambda: retrieve.all_lexical(texts, p)]
    got = [key(f()) for f in made]
    assert [len(x) for x in got] == [34 * q.count(), 10 * q.count(), 5 * 8]
    monkeypatch.setattr(retrieve, "HELD", 1)
    assert got == [key(f()) for f in made]
    sql = catalog.oracle_sql()
    assert not any("rank" in sql[x] for x in ("lexical_score", "l2_and_cosine", "best_chunk_per_node"))


def test_rules_by_key_equal_every_pair(spark):
    rules = [("r1", ["*/src/*"], [], []), ("r2", ["*.py"], ["debug"], []), ("r3", ["*x*"], [], []), ("r4", [], [], ["edit"]), ("r5", [], [], []), ("r6", ["a?.md", "docs/*"], ["design"], ["edit"]), ("r7", ["src"], [], [])]
    r = spark.createDataFrame([(i, "MUST", "block", g, n, o, None, None, None, None, False) for i, g, n, o in rules], governance.RULE)
    ctx = [(k, p, o, [g], "1") for k, (p, o, g) in enumerate((p, o, g) for p in ("a/src/b.py", "src", "ab.md", "docs/q/x.txt", "box", None) for o in ("edit", "read") for g in ("debug", "none"))]
    c = spark.createDataFrame(ctx, "context_id long, path string, tool string, tags array<string>, arg string")
    every = c.join(r, governance.applies(), "inner").select("context_id", "rule_id")
    assert rows(governance.active(c, r).select("context_id", "rule_id")) == rows(every) == rows(governance.active(c, r, most_rules=1).select("context_id", "rule_id"))


def test_composed_retrieval_diversifies_as_a_greedy_search(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    n = [(k, "memory_project", f"name{k}", None, k % 9 == 0, k % 5 == 0, k * 1000, " ".join(rng.choices(words, k=8)), None) for k in range(60)]
    nodes = spark.createDataFrame(n, "id long, type string, name string, project_key string, base boolean, local_only boolean, updated_at long, body string, description string")
    vec = {k: [rng.gauss(0, 1) for _ in range(4)] for k in range(60) if k % 7}
    vectors = spark.createDataFrame(list(vec.items()), "id long, embedding array<float>")
    edges = spark.createDataFrame([(1, 2, "derived_from", 1.0)], "src long, dst long, relation string, weight double")
    prompts = spark.createDataFrame([(0, "w1 w2 name13", vec[1]), (1, "nothing here", None), (2, "w3", vec[2])], "qid long, prompt string, vector array<double>")
    args = (nodes, vectors, edges, prompts, 100_000, [])
    s = retrieve.Scoring()
    pool = {}
    for r in retrieve.top(retrieve.candidates(*args, s).where("NOT local_only"), 20).orderBy("qid", "rank").collect():
        pool.setdefault(r["qid"], []).append((r["id"], r["score"]))
    unit = {k: np.array(np.array(v, np.float32), float) / np.linalg.norm(np.array(v, np.float32)) for k, v in vec.items()}
    want = {}
    for q, hits in pool.items():
        low, high = min(x for _, x in hits), max(x for _, x in hits)
        left, got = list(hits), []
        while left and len(got) < s.k and len(hits) > s.k:
            near = lambda i: max([0.0, *(float(unit[i] @ unit[j]) for j in got if i in unit and j in unit)])  # noqa: B023, E731
            best = max(left, key=lambda h: (s.mmr * (h[1] - low) / (high - low) - (1 - s.mmr) * near(h[0]), -left.index(h)))
            got.append(best[0])
            left.remove(best)
        want[q] = got or [i for i, _ in hits]
    made = {}
    for r in retrieve.retrieved(*args, s).orderBy("qid", "pick").collect():
        made.setdefault(r["qid"], []).append(r["id"])
        assert r["excluded"] >= 0 and r["line"].startswith("[ref:")
    assert made == want and 13 in made[0] and not any(k % 5 == 0 for x in made.values() for k in x)


def test_writes_check_what_they_get(spark):
    from quillon.operators import store

    e = spark.createDataFrame([("a", "b", "calls", 1.0, 1, "x", 1.0)], "src_id string, dst_id string, relation string, weight double, created_at long, source string, confidence double")
    with pytest.raises(ValueError):
        store.upsert_edges(e, spark.createDataFrame([("a", "b", "likes")], "src_id string, dst_id string, relation string"), 1)
    keys = spark.createDataFrame([("k",)], "id string")
    quota = spark.createDataFrame([("k", "monthly", 1, 1)], "api_key_id string, period string, max_queries long, max_tokens long")
    for bad in (("k", "monthly", -1, 1), ("z", "monthly", 1, 1)):
        with pytest.raises(ValueError):
            store.set_quotas(quota, spark.createDataFrame([bad], quota.schema), keys)
    w = spark.createDataFrame([("1", "n"), ("2", "m")], "id string, name string").withColumn("created_ms", F.lit(1).cast("long"))
    with pytest.raises(ValueError):
        store.save_workspaces(w, spark.createDataFrame([("2", "n", 5)], w.schema))
    with pytest.raises(ValueError):
        store.set_overrides(spark.createDataFrame([("p", "retry", 1)], "source_path string, decision string, decided_ms long"), spark.createDataFrame([("p", "maybe", 1)], "source_path string, decision string, decided_ms long"))


def test_settings_stay_in_bounds(tmp_path):
    from quillon.sources import settings

    raw = {"k": 900, "budget_tokens": "x", "fusion": " BM25_lead ", "isolation": "odd", "mmr": -3, "scoring": {"vector": 1, "odd": 2}, "rrf_k": True, "requery_cosine": 1}
    s = settings.merged(raw)
    assert (s.k, s.budget_tokens, s.fusion, s.isolation, s.mmr, s.scoring["vector"], s.rrf_k, s.requery_cosine) == (200, 800, "bm25_lead", "strict", 0.0, 1.0, 60, 1.0) and "odd" not in s.scoring
    path = str(tmp_path / "s.json")
    settings.save(s, path)
    assert settings.load(path) == s and settings.load(path + ".none") == settings.Settings() == settings.merged([1])
    assert settings.scoring(s).fusion == "bm25_lead"
    assert settings.environment("# c\nA=1\n B = 'x y' \nbad\n=z\nC=\"q'\nD=a=b") == {"A": "1", "B": "x y", "C": "\"q'", "D": "a=b"}
    assert settings.with_excludes([" a ", "b", "a"], "c, b,") == ["a", "b", "c"]


def test_fixtures(spark, tmp_path):
    from quillon.sources import settings

    (tmp_path / "e.json").write_text('[{"prompt": "p", "expect_source_contains": ["x"], "query_type": "Odd"}]')
    assert settings.retrieval_fixture(spark, str(tmp_path / "e.json")).first()["query_type"] == "lexical"
    (tmp_path / "t.json").write_text('[{"id": "1", "cls": "structural", "answer_keys": ["a"]}]')
    assert settings.task_fixture(spark, str(tmp_path / "t.json")).count() == 1
    (tmp_path / "u.json").write_text('[{"id": "1", "cls": "magic"}]')
    with pytest.raises(ValueError):
        settings.task_fixture(spark, str(tmp_path / "u.json"))
    (tmp_path / "corpus.jsonl").write_text('{"id": "a", "body": "b"}\n\n{"id": "c", "body": "d"}\n')
    (tmp_path / "prompts.json").write_text('{\n "prompts": [\n {"id": "x1", "confidence": "high", "text": "q \\"1\\""},\n {"id": "x2", "text": "r"}]}')
    (tmp_path / "expected.json").write_text('{"invariant": "i", "notes": {"a": 1}, "by_prompt": {"x1": {"relevant_node_ids": ["a"], "acceptance_criteria_keywords": ["k"], "rubric": ["m"], "expected_clarifications": 2}}}')
    corpus, prompts = settings.bench_fixture(spark, str(tmp_path))
    assert corpus.count() == 2
    assert sorted(map(tuple, prompts.collect())) == [("x1", "high", 'q "1"', ["a"], ["k"], ["m"], 2, "i"), ("x2", None, "r", [], [], [], 0, "i")]
    (tmp_path / "prompts.json").write_text('{"prompts": ["How?", "And {then}?"]}')
    (tmp_path / "expected.json").write_text('{"relevant_node_ids": ["a", "c"], "required_keywords_final_turn": ["k"], "rubric": {"turn_1": "x"}}')
    got = settings.bench_fixture(spark, str(tmp_path))[1].select("prompt_id", "text", "relevant", "keywords")
    assert sorted(map(tuple, got.collect())) == [("turn_1", "How?", ["a", "c"], []), ("turn_2", "And {then}?", ["a", "c"], ["k"])]


def test_small_text_functions(spark):
    assert one(spark, t.concept_context(F.lit("x" * 400 + "abc" + "y" * 400), F.lit("abc"))) == "x" * 300 + "abc" + "y" * 300
    assert one(spark, t.strip_truncation(F.lit("a\n... (12 more lines)\n"))) == "a" and one(spark, t.head_lines(F.lit("a\nb\nc"), 2)) == "a\nb\n... (1 more lines)"
    assert [one(spark, t.private_symbol(F.lit(x))) for x in ("_a", "__a", "__a__", "a")] == [True, True, False, False]
    assert [one(spark, t.test_symbol(F.lit(a), F.lit(b))) for a, b in (("test_a", ""), ("_test_a", ""), ("tested", "x"), ("a", "q\\Tests\\b.py"))] == [True, True, False, True]
    assert one(spark, t.module_path(F.lit("a.py::f"))) == "a.py" == one(spark, t.module_path(F.lit("a.py:3-9"))) and one(spark, t.node_id_shape(F.lit("a" * 32)))


def test_names_in_texts_against_a_naive_scan(spark, monkeypatch):
    rng = random.Random(81)
    words = ["tide", "level", "gauge_2", "tide level", "é", "Fix", "a", "level.", "(x)", "中"]
    names = [(k, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for k in range(60)] + [(100, "tide"), (101, "tide"), (102, ""), (103, None)]
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", "", "\n", "-", "_", "."]) for _ in range(rng.randint(0, 30)))) for k in range(80)] + [(200, None), (201, ""), (3, "tide")]
    edge = lambda t, n: re.search(r"(?:^|\W)" + re.escape(n) + r"(?=$|\W)", t) is not None
    want = {(i, k) for i, t in texts for k, n in names if t and n and edge(t, n)}
    frames = spark.createDataFrame(texts, "text_id long, text string").repartition(3), spark.createDataFrame(names, "name_id long, name string")
    for size, most in ((50_000, 1 << 25), (7, 300)):
        monkeypatch.setattr(joins, "NAMES", size)
        monkeypatch.setattr(joins, "TEXT_BYTES", most)
        got = joins.named_in(*frames).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert joins.named_in(frames[0], frames[1].limit(0)).count() == 0


def test_close_points_are_seen_and_parted_in_two_dimensions():
    rng = np.random.default_rng(91)
    x = np.concatenate([rng.uniform(0, 60, (300, 2)), np.zeros((20, 2)), [[30.0, y] for y in range(40)]])
    i, j = graph.close_pairs(x, 3.0)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if far[a, b] < 3.0} and len(i) == len({(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)})
    made = graph.separate(x, 3.0, rounds=400)
    far = np.sqrt(((made[:, None] - made[None]) ** 2).sum(axis=2)) + np.eye(len(x)) * 99
    assert far.min() > 2.7 and np.array_equal(made, graph.separate(x, 3.0, rounds=400))
    heap = graph.separate(np.zeros((5000, 2)), 1.0)
    assert len(np.unique(heap.round(6), axis=0)) == 5000
    assert len(graph.separate(np.zeros((1, 2)), 1.0)) == 1 and len(graph.separate(np.zeros((0, 2)), 1.0)) == 0
