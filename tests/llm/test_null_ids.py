"""Rows without an id, and nulls in every other column, in the operators that read rows one by one."""

from __future__ import annotations

import pytest

from quillon.llm import bpe, chat_format, license_scan, pieces, quality_rules, registry, secret_scan, url_filter

TEXTS = ["Released under the MIT License.", None, "", "token = 'abcDEF123456' and some words", "Released under the MIT License."]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(None if k % 2 == 0 else k, t, None, None, None) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")


def count(frame, column="doc_id"):
    return sum(r[column] is None for r in frame.collect())


def test_encoders(rows):
    for made in (bpe.digest(bpe.encoded(rows, registry.vocabulary("word_bpe_49k.json"))), pieces.digest(pieces.encoded(rows, registry.vocabulary("piece_bpe_32k.model"), packed=True))):
        assert made.count() == len(TEXTS) and count(made) == 3


def test_licenses(rows):
    got = license_scan.scan(rows).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(None, "MIT/notice")] * 2


def test_secrets(rows, labels):
    made = secret_scan.digest(secret_scan.found(rows, secret_scan.train(rows, labels))).collect()
    assert len(made) == len(TEXTS) and sum(r["doc_id"] is None for r in made) == 3 and {r["doc_id"]: r["n_assign"] for r in made}[3] == 1


def test_quality(rows, labels):
    made = quality_rules.judge(rows, labels)
    assert made.count() == len(TEXTS) and count(made) == 3 and made.where("kept").count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(None, "http://example.net/de/8"), (None, "http://example.net/de/8"), (1, None), (2, "x"), (3, "http://a.com/en/1")], "page_id long, url string")
    made = url_filter.judge(pages, url_filter.rule_table(spark)).collect()
    assert len(made) == 5 and [(r["rule"], r["verdict"]) for r in made if r["page_id"] is None] == [("example.net/de/8", "block")] * 2
    assert {r["page_id"]: r["host"] for r in made}[1] == ""


def test_conversations(spark):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, None, None, None), (1, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    made = {r["conv_id"]: r for r in chat_format.digest(chat_format.formatted(chat_format.canonical(turns))).collect()}
    assert made[None]["n_turns"] == 2 and made[1]["loss_chars"] == 1
