"""The chunk index: live sources, orphans, replacement, duplicates and postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.bounds import small
from tidemark.sources.shared import bounded_batches


def live_sources(documents: DataFrame, experiences: DataFrame) -> DataFrame:
    """(source_type, source_id) that may be retrieved: completed documents and published
    lessons, of either case, that are not deleted."""
    kind = lambda df, name, status: df.filter(~F.col("is_deleted") & (F.lower("status") == status)).select(
        F.lit(name).alias("source_type"), F.col("id").alias("source_id")
    )
    return kind(documents, "document", "completed").unionByName(kind(experiences, "experience", "published"))


def eligible_chunks(chunks: DataFrame, live: DataFrame) -> DataFrame:
    return chunks.join(live, ["source_type", "source_id"], "left_semi")


def orphan_chunks(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Chunks of sources that are gone, archived or not live: the set to purge."""
    return chunks.join(live, ["source_type", "source_id"], "left_anti")


def replace_index(index: DataFrame, fresh: DataFrame, reindexed: DataFrame | None = None) -> DataFrame:
    """index with all chunks of the reindexed sources (default: those of fresh) replaced."""
    keys = (fresh if reindexed is None else reindexed).select("source_type", "source_id").distinct()
    return index.join(keys, ["source_type", "source_id"], "left_anti").unionByName(fresh)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(organization_id, term, chunk_id, tf) of rows (organization_id, chunk_id, terms)."""
    for batch in batches:
        listed = batch.column("terms")
        words = listed.flatten().dictionary_encode()
        n_words = len(words.dictionary)
        if not n_words:
            continue
        row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        pairs, tf = np.unique(row * n_words + words.indices.to_numpy(), return_counts=True)
        row, word = (pa.array(x) for x in np.divmod(pairs, n_words))
        columns = [batch.column("organization_id").take(row), words.dictionary.take(word), batch.column("chunk_id").take(row), pa.array(tf.astype("int64"))]
        yield pa.RecordBatch.from_arrays(columns, ["organization_id", "term", "chunk_id", "tf"])


def postings(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(organization_id, term, chunk_id, tf), of the wanted (organization_id, term) only
    where they are given.

    Contents meet by chunk and are counted there: what is shuffled are the texts, a row a
    chunk, not a row for each of its words. Wanted terms, if they are few enough, go to all
    tasks, so that other words' counts are shuffled nowhere.
    """
    bounded_batches(chunks.sparkSession)
    # a chunk that comes in several rows is counted as one text; no term has a newline in it
    whole = chunks.groupBy("organization_id", "chunk_id").agg(F.array_join(F.collect_list("content"), "\n").alias("content"))
    listed = whole.select("organization_id", "chunk_id", tx.posting_terms(F.col("content")).alias("terms"))
    kinds = dict(chunks.dtypes)
    counts = listed.mapInArrow(_counted, f"organization_id {kinds['organization_id']}, term string, chunk_id {kinds['chunk_id']}, tf long")
    if wanted is None:
        return counts
    few = wanted.select("organization_id", "term").distinct()
    return counts.join(small(few, few.count(), 96), ["organization_id", "term"], "left_semi")


def duplicate_uploads(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads (id, organization_id, sha256) with existing_id: the first stored document of the
    same organisation and content whose deleted_at is null, else the first such upload of
    the batch; null if that is the upload itself, so that one that comes again, once it is
    stored, is decided as it was.

    Only ids and hashes are shuffled. The first of a batch is a smallest id by partial
    aggregation, so one file that everybody uploads costs a row a task.
    """
    live = stored.filter("deleted_at IS NULL").groupBy("organization_id", "sha256").agg(F.min("id").alias("stored_id"))
    first = incoming.groupBy("organization_id", "sha256").agg(F.min("id").alias("first_id"))
    known = first.join(live, ["organization_id", "sha256"], "left")
    holder = F.coalesce("stored_id", "first_id")
    return incoming.join(known, ["organization_id", "sha256"]).select(
        "id", "organization_id", "sha256", F.when(holder != F.col("id"), holder).alias("existing_id")
    )


def insert_if_absent(table: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """table with the incoming rows whose key is new; of several, the first by order."""
    first = Window.partitionBy(*key).orderBy(*order)
    new = incoming.join(table, key, "left_anti").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return table.unionByName(new)


def upsert_by_key(table: DataFrame, incoming: DataFrame, key: list[str], stamp: str, tie: str) -> DataFrame:
    """The newest row of each key; at equal stamps the greater tie column wins."""
    newest = Window.partitionBy(*key).orderBy(F.desc(stamp), F.desc(tie))
    both = table.unionByName(incoming)
    return both.withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")


def replace_grants(grants: DataFrame, changed: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All grants of the changed owners dropped, the new ones inserted."""
    return grants.join(changed.select(owner).distinct(), owner, "left_anti").unionByName(new)
