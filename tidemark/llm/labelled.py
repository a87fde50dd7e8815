"""Bounded samples of labelled documents, for the models that are fitted on the driver."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_label: int, condition=None
) -> DataFrame:
    """(text, label) of at most rows_per_label labelled documents for each value 0 and 1 of
    the label, chosen by a hash of the id. Labelled rows without an id are left out; of
    several documents with one id the least text counts, of several labels the greater.

    The chosen ids are few by construction, so they are broadcast to one scan of docs.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    if condition is not None:
        rows = rows.filter(condition)
    chosen = None
    for value in (0, 1):
        part = rows.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = F.broadcast(chosen)  # at most twice rows_per_label
    return texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def not_held_out():
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def unlike_rows(vocabularies: list[list[str]], bands: int = 8, rows: int = 4) -> list[int]:
    """Indices of a bounded sample without near copies: a row stays if no earlier one has
    the same MinHash values in a whole band. Copies of one text would pass for evidence
    that each of its rare words goes with its label."""
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) | np.uint64(1)
    kept, seen = [], set()
    for i, words in enumerate(vocabularies):
        keys = {(-1, 0)}
        if words:
            ids = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
            least = [int((ids * f >> np.uint64(7)).min()) for f in factors]
            keys = {(b, *least[b * rows : (b + 1) * rows]) for b in range(bands)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept
