"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spreadlab.llm import chat_format, decontaminate, filter_audit, importance, jaccard, quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlab.llm.quality import quality_held_out

    return quality_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlab.llm.secret_scan import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlab.llm.media import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlab.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlab.llm.decontaminate import contamination

    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlab.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlab.llm.language import language_held_out

    return language_held_out(_table(spark, sf_dir, "documents"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spreadlab.llm.chat_format import perspectives

    return perspectives(_table(spark, sf_dir, "conversations"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spreadlab.llm.bpe import bpe_digest

    return bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spreadlab.llm.token_store import stored_digest

    return stored_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = filter_audit.document_flags(_table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.with_labels(flagged, _table(spark, sf_dir, "labels")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.verdicts(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    return entries.select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_media": op3_media,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_language": op7_language,
    "op8_chat_perspectives": op8_chat_perspectives,
    "op9_bpe": op9_bpe,
    "op10_token_store": op10_token_store,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality_rules": op12_quality_rules,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op6_ngram_jaccard": jaccard.ORACLE_SQL,
    "op8_chat_perspectives": chat_format.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_quality_rules": quality_rules.ORACLE_SQL,
    "op13_importance": importance.ORACLE_SQL,
}
