"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    chat,
    decontaminate,
    exact_dedup,
    fingerprints,
    line_chunks,
    manifest,
    mixing,
    quality,
    secrets,
    simhash,
    spelling,
    token_blocks,
    toxicity,
)

#: File name and vocabulary of the tokenizer of the production query.
TOKENIZER, VOCABULARY = "byte_bpe_50k.json", 50_257


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, words=secrets.common_words(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_blocks.token_report(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)
    )


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.remove_repeated_chunks(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_fingerprints,
        op2_secrets,
        op3_quality,
        op4_toxicity,
        op5_chat,
        op6_decontaminate,
        op7_mix,
        op8_simhash,
        op9_token_blocks,
        op10_line_chunks,
        op11_exact_dedup,
        op12_manifest,
        op13_spelling,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat": chat.CHAT_SQL,
        "op6_decontaminate": decontaminate.CONTAINED_SQL,
        "op7_mix": mixing.MIX_SQL,
        "op11_exact_dedup": exact_dedup.EXACT_SQL,
        "op12_manifest": manifest.MANIFEST_SQL,
        "op13_spelling": spelling.SPELLING_SQL,
    }
