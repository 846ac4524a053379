"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import decontaminate, ngram_join, quality_rules, secret_scan
from tests.llm.test_matches import base_spans, brute_components, brute_hits


def test_stages(spark, sf, corpus, labels):
    docs = corpus
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "secrets", "encode"]

    out = stages["quality"](spark, docs, sf).cache()
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    assert rows(out) == [r for r in rows(docs) if verdict[r[0]]] and out.columns == docs.columns

    docs, before = out, rows(out)
    out = stages["near_duplicates"](spark, docs, sf).cache()
    keep = {c for _, _, c in brute_components(before)}
    assert rows(out) == [r for r in before if r[0] in keep] and out.columns == docs.columns

    docs, before = out, rows(out)
    out = stages["decontaminate"](spark, docs, sf).cache()
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(out) == [r for r in before if not brute_hits(r[1], items)[1]]

    docs, before = out, rows(out)
    out = stages["secrets"](spark, docs, sf).cache()
    after = dict(rows(out))
    assert set(after) == {i for i, _ in before}
    for i, t in before:
        assert (after[i] == t) if not secret_scan.RUN.search(t) and not base_spans(t) else not base_spans(after[i].replace("<SECRET>", " "))
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())

    out = stages["encode"](spark, out, sf)
    assert {r["doc_id"] for r in out.collect()} == set(after) and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def test_empty_input_passes_all_stages(spark, sf, corpus):
    docs = corpus.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_stage_operators_are_those_of_the_list():
    assert decontaminate.clean and ngram_join.deduplicated and quality_rules.kept and secret_scan.redacted
