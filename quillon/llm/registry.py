"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, chat_format, decontaminate, license_scan, merkle, ngram_join, pieces, quality_rules, secret_scan, substring_dedup, token_files, turn_repair, url_filter
from quillon.llm.base import shared_dir, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    turns = chat_format.canonical(chat_format.with_probe(table(spark, sf_dir, "conversations"), spark))
    return chat_format.digest(chat_format.formatted(turns))


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by forced boundaries, and decoded."""
    return bpe.digest(bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text and each of its lines."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text written to token files and read back."""
    return token_files.write(table(spark, sf_dir, "documents"), shared_dir(spark), vocabulary("byte_bpe_50k.json")).read()


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the contract's rules on every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.found(docs, secret_scan.train(docs, table(spark, sf_dir, "labels"))))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that repeat a passage of an earlier document."""
    return substring_dedup.digest(substring_dedup.repeats(table(spark, sf_dir, "documents")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that stand in a benchmark window."""
    return decontaminate.digest(decontaminate.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates over all documents."""
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the learned list's verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rule")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as the contract says, with its faults, cheapest edits and repaired rows' hash."""
    given = table(spark, sf_dir, "conversations")
    return turn_repair.Repair(turn_repair.damaged(given)).report(given)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by an agenda of symbol pairs, and decoded."""
    return pieces.digest(pieces.encoded(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), packed=True))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every row."""
    docs = table(spark, sf_dir, "documents")
    return merkle.proved(merkle.manifest(docs, merkle.one_in_three(docs["doc_id"])))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_bpe": op2_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_token_files": op4_token_files,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_turn_repair": op11_turn_repair,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op3_license_scan": license_scan.oracle(),
    "op5_url_filter": url_filter.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
