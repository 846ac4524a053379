"""A corpus pipeline of five stages, each one operator of quillon.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage sees
all rows that the one before it kept; all but the last return the columns of documents.

1. quality: documents that the learned decision list or the base rule rejects go.
2. near_duplicates: of each component of near duplicates the document with the smallest doc_id stays.
3. decontaminate: documents with benchmark windows go.
4. secrets: spans of secrets are replaced by a mark; every document stays.
5. encode: token ids, their number and the decoded text's digest.

Null and empty texts fail the base rule of stage 1; an empty table passes through all stages; columns beside those
of documents are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontaminate, ngram_join, quality_rules, registry, secret_scan
from quillon.llm.base import shared_dir, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs).select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), remove="documents").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secret_scan.train(docs, table(spark, sf_dir, "labels"))
    return secret_scan.redacted(docs, model).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encoded(docs, registry.vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmarks),
    ("secrets", without_secrets),
    ("encode", encode),
]

#: Learned rules and Markov models decide in two stages, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{k}-{name}")
    return docs
