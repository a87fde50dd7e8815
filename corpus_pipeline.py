"""A training corpus from raw documents: five stages, each writing Parquet for the next.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables
and further columns; what becomes of these is said at each. A null text counts as empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, quality, simhash, token_blocks
from tidemark.llm.common import shared_dir
from tidemark.llm.queries import TOKENIZER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject. Texts
    without words have the score of the bias alone; repeated rows stay or go together; of
    several labelled rows with one id one is learned from; without labels all stay."""
    return quality.keep_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 80 percent of their five-word
    shingles or more: the one with the smallest id, null first. Wordless texts are one
    group, and rows that repeat id and text are one."""
    return simhash.deduplicate_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Wordless texts contain none; repeated rows
    stay or go together; without items all stay."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say. A null source is a
    source of its own; one without words keeps nothing; rows with one id share one draw."""
    return mixing.mix(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, in ascending doc_id order, null first; what is read back of each
    document. Empty texts give the end id alone; repeated rows are written each."""
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    token_blocks.write_blocks(docs, path, public_tokenizers.path(TOKENIZER))
    return token_blocks.read_checksums(spark, path)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
    ("token blocks", token_file),
]

#: The classifier and the fingerprints cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to the shared folder and reread."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/stage{i}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
