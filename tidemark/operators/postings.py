"""Stored keyword postings in blocks with score bounds, and a search that skips blocks.

The postings of a term of an organisation lie in blocks, best first, each with the largest
number of occurrences in it: a bound of what it adds to a score. The first blocks of a
question's terms give the least score of its pool; of the others only those are read whose
bound, with the best that the question's other terms can add, reaches it. What is skipped
holds no chunk of the pool, so the answer is that of reading all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as vx
from tidemark.operators import index, retrieval
from tidemark.operators.bounds import small
from tidemark.sources.buckets import BucketedTable
from tidemark.sources.shared import bounded_batches, save

#: Postings of a block; more than a pool, so that first blocks can fill one.
BLOCK = 128
KEYS = ["organization_id", "term"]
SCHEMA = "organization_id string, term string, block int, most_tf long, least_chunk long, chunk_ids array<long>, tfs array<long>"
_CUT = [*KEYS, "piece", "most_tf", "least_chunk", "nth", "chunk_ids", "tfs"]
#: Scores are rounded to nine places; bounds have to pass by more.
_MARGIN = 1e-8


def stored_postings(spark: SparkSession, path: str, buckets: int = 256) -> BucketedTable:
    return BucketedTable(spark, path, KEYS, SCHEMA, buckets)


def _cut(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (organization_id, term, chunk_id, tf, piece) in order to blocks, numbered from 0 for
    each key. The first and last key of a piece are told by rows of number -1. Only the rows
    of a block are held back for the next batch."""

    def made(rows: pa.RecordBatch, begins: np.ndarray, end: int, numbers: np.ndarray) -> pa.RecordBatch:
        offsets, at = pa.array(np.r_[begins, end].astype("int32")), pa.array(begins)
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("chunk_id", "tf")]
        firsts = [rows.column(c).take(at) for c in (*KEYS, "piece", "tf", "chunk_id")]
        return pa.RecordBatch.from_arrays([*firsts, pa.array(numbers.astype("int64")), *lists], _CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                yield made(batch, np.array([0]), 0, np.array([-1]))
            rows = batch if held is None else pa.concat_batches([held, batch])
            first, second = (rows.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in KEYS)
            starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            place = np.arange(len(first)) - np.repeat(starts, np.diff(np.r_[starts, len(first)]))
            begins = np.flatnonzero(place % block == 0)
            numbers = place[begins] // block
            numbers[: len(begins) if len(starts) == 1 else np.searchsorted(begins, starts[1])] += number
            if len(begins) > 1:
                yield made(rows, begins[:-1], begins[-1], numbers[:-1])
            held, number = rows.slice(begins[-1]), numbers[-1]
        if held is not None:
            held = pa.concat_batches([held.slice(0, 0), held])
            yield made(held, np.array([0]), held.num_rows, np.array([number]))
            yield made(held, np.array([0]), 0, np.array([-1]))

    return run


def posting_blocks(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of postings (organization_id, term, chunk_id, tf). A term of any number of
    chunks is ranked and cut in pieces, so it does not meet in one task; where a piece ends, a
    block may hold less. Only the first and last terms of the pieces can lie in several: the
    numbers of their blocks go on from piece to piece."""
    kinds = dict(postings.dtypes)
    bounded_batches(postings.sparkSession)
    by = [*(F.col(k).asc_nulls_first() for k in KEYS), F.desc("tf"), F.col("chunk_id")]
    ranked = save(postings.select(*KEYS, "chunk_id", "tf"), "postings").repartitionByRange(*by).sortWithinPartitions(*by)
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + f", piece int, most_tf {kinds['tf']}, least_chunk {kinds['chunk_id']}, nth long"
    cut = ranked.withColumn("piece", F.spark_partition_id()).mapInArrow(_cut(block), f"{schema}, chunk_ids array<{kinds['chunk_id']}>, tfs array<{kinds['tf']}>")
    cut = save(cut, "cut-blocks")
    edges = cut.filter("nth < 0").select(*KEYS, "piece").distinct()
    n_edges = edges.count()  # two a piece at most
    names = {k: f"edge {k}" for k in (*KEYS, "piece")}
    same = lambda columns: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"`{names[k]}`")) for k in columns))
    before = Window.partitionBy(*KEYS).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.filter("nth >= 0")
    counts = whole.join(small(edges.withColumnsRenamed(names), n_edges, 128), same([*KEYS, "piece"]), "left_semi").groupBy(*KEYS, "piece").agg(F.count("*").alias("n"))
    shifts = counts.select(*KEYS, "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")).withColumnsRenamed(names)
    placed = whole.join(small(shifts, n_edges, 128), same([*KEYS, "piece"]), "left")
    number = (F.col("nth") + F.coalesce("shift", F.lit(0))).cast("int")
    return placed.select(*KEYS, number.alias("block"), "most_tf", "least_chunk", "chunk_ids", "tfs")


def _exploded(blocks: DataFrame, *columns: str) -> DataFrame:
    pairs = F.arrays_zip("chunk_ids", "tfs")
    return blocks.select(*columns, F.explode(pairs).alias("p")).select(*columns, F.col("p.chunk_ids").alias("chunk_id"), F.col("p.tfs").alias("tf"))


def write_postings(table: BucketedTable, chunks: DataFrame, block: int = BLOCK, stamp: int | None = None) -> None:
    """The postings of all chunks (organization_id, chunk_id, content)."""
    blocks = save(posting_blocks(index.postings(chunks), block), "blocks")
    table.replace(blocks, stamp=stamp)


def update_postings(table: BucketedTable, gone: DataFrame, fresh: DataFrame, block: int = BLOCK, stamp: int | None = None) -> list[int]:
    """Take chunks out of the postings and put others in, both (organization_id, chunk_id,
    content): only terms of these chunks are read and written, in their buckets."""
    new, old = index.postings(fresh), index.postings(gone)
    touched = save(new.select(*KEYS).unionByName(old.select(*KEYS)).distinct(), "touched-terms")
    stored = _exploded(table.read_keys(touched).join(touched, KEYS, "left_semi"), *KEYS)
    place = ["organization_id", "chunk_id"]
    changed = save(gone.select(*place).unionByName(fresh.select(*place)).distinct(), "changed-chunks")
    kept = stored.join(small(changed, changed.count(), 48), place, "left_anti")
    blocks = save(posting_blocks(kept.unionByName(new.select(*kept.columns)), block), "blocks")
    return table.replace(blocks, touched, stamp)


def wanted_blocks(terms: DataFrame, blocks: DataFrame, pool: int = retrieval.POOL) -> DataFrame:
    """(query_id, n_terms, organization_id, term, block): the blocks that may hold a chunk of a
    question's pool. terms as of retrieval.query_terms."""
    about = blocks.select(*KEYS, "block", vx.term_rank(F.col("most_tf")).alias("most"), "least_chunk")
    asked = terms.join(about.filter("block = 0").withColumnRenamed("most", "best").drop("block", "least_chunk"), KEYS)
    whole = Window.partitionBy("query_id")  # at most twelve terms
    asked = save(asked.withColumn("others", F.sum("best").over(whole) - F.col("best")), "asked-terms")
    n_asked = asked.count()
    first = small(asked, n_asked, 128).join(blocks.filter("block = 0"), KEYS)
    known = _exploded(first, "query_id").groupBy("query_id", "chunk_id").agg(F.sum(vx.term_rank(F.col("tf"))).alias("known"))
    pools = retrieval.top(known, "known", pool).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("known").alias("least"), F.max(F.struct(-F.col("known"), "chunk_id"))["chunk_id"].alias("last_chunk")
    )
    pools = pools.filter(F.col("n") >= pool).select("query_id", "least", "last_chunk")
    reach = F.col("most") + F.col("others")
    below = reach + _MARGIN < F.col("least")
    # one term alone: a block of the least score, whose chunks all come behind the last one
    behind = (F.col("n_terms") == 1) & (F.col("most") <= F.col("least")) & (F.col("least_chunk") > F.col("last_chunk"))
    rows = small(asked.join(pools, "query_id", "left"), n_asked, 160).join(about, KEYS)
    return rows.filter(F.col("least").isNull() | ~(below | behind)).select("query_id", "n_terms", *KEYS, "block")


def pruned_candidates(terms: DataFrame, blocks: DataFrame, pool: int = retrieval.POOL) -> DataFrame:
    """retrieval.keyword_candidates from stored blocks, of which those out of reach are skipped."""
    wanted = save(wanted_blocks(terms, blocks, pool), "wanted-blocks")
    hits = _exploded(small(wanted, wanted.count(), 128).join(blocks, [*KEYS, "block"]), "query_id", "n_terms")
    score = vx.keyword_rank(F.sum(vx.term_rank(F.col("tf"))), F.max("n_terms"))
    return retrieval.top(hits.groupBy("query_id", "chunk_id").agg(F.round(score, 9).alias("keyword_score")), "keyword_score", pool)


def search_stored(terms: DataFrame, table: BucketedTable, pool: int = retrieval.POOL) -> DataFrame:
    """Candidates of questions' terms from the buckets that hold them."""
    return pruned_candidates(terms, table.read_keys(terms), pool)
