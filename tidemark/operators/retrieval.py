"""Candidates of many questions at once, by vectors and by keywords, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vectors as vx
from tidemark.operators.bounds import small

TOP_K, MIN_SCORE = 8, 0.15
POOL = max(30, 4 * TOP_K)
#: Questions that a task holds as one matrix; more questions make more passes.
QUERY_BLOCK = 4096
#: Chunks of an organisation that meet such a matrix at once, and rows of a product of both.
CHUNK_BLOCK, _SLICE = 8192, 1024


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, organization_id, term, n_terms) of queries (query_id, organization_id,
    text): at most twelve distinct index terms a question."""
    cut = F.array_join(tx.or_terms(F.col("text")), " ")
    terms = queries.select("query_id", "organization_id", F.array_distinct(tx.posting_terms(cut)).alias("terms"))
    return terms.select("query_id", "organization_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def keyword_candidates(terms: DataFrame, postings: DataFrame, pool: int = POOL) -> DataFrame:
    """(query_id, chunk_id, keyword_score): the best chunks of each question with at least
    one of its terms; ties by chunk id. Scores are summed by partial aggregation; few terms go
    to all tasks, so that postings are not shuffled for them."""
    hits = small(terms, terms.count(), 96).join(postings, ["organization_id", "term"])
    score = vx.keyword_rank(F.sum(vx.term_rank(F.col("tf"))), F.max("n_terms"))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(score, 9).alias("keyword_score"))
    return top(scored, "keyword_score", pool)


def top(scored: DataFrame, score: str, n: int) -> DataFrame:
    """The n best rows of each query, ties by chunk id: a rank filter, kept small before
    the shuffle by Spark's group limit."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= n).drop("n")


def vector_candidates(queries: DataFrame, chunks: DataFrame, pool: int = POOL) -> DataFrame:
    """(query_id, chunk_id, vector_score): the nearest chunks of each question within its
    organisation by cosine, exactly; chunks without a vector or of length 0 are left out.

    At most QUERY_BLOCK questions (query_id, organization_id, embedding) are held by every
    task, which multiplies its chunks with those of their organisations and keeps the best
    of each; only these rows are shuffled. More questions are dealt in blocks, and so are
    the chunks of an organisation: each pair of blocks meets in one group, and no question
    passes through the driver.
    """
    schema = "query_id long, chunk_id long, vector_score double"
    asked = queries.filter("embedding IS NOT NULL").select("query_id", "organization_id", "embedding")
    rows = chunks.filter("embedding IS NOT NULL").select("organization_id", "chunk_id", "embedding")
    few = asked.limit(QUERY_BLOCK + 1).toPandas()
    if len(few) <= QUERY_BLOCK:
        found = rows.mapInPandas(_nearest(few, pool), schema)
    else:
        found = _nearest_in_blocks(asked, rows, pool, schema)
    return top(found, "vector_score", pool)


def _nearest_in_blocks(asked: DataFrame, rows: DataFrame, pool: int, schema: str) -> DataFrame:
    """The best chunks of each question in each pair of blocks of an organisation."""
    count = lambda df, size, name: df.groupBy("organization_id").agg(F.ceil(F.count("*") / size).cast("long").alias(name))
    sizes = count(asked, QUERY_BLOCK, "of_questions").join(count(rows, CHUNK_BLOCK, "of_chunks"), "organization_id")
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "organization_id").select("query_id", "organization_id", "embedding", own("query_id", "of_questions").alias("q"), each("of_chunks").alias("c"))
    right = rows.join(sizes, "organization_id").select("chunk_id", "organization_id", "embedding", each("of_questions").alias("q"), own("chunk_id", "of_chunks").alias("c"))

    def meet(questions: pd.DataFrame, own_chunks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "chunk_id": [], "vector_score": []}).astype({"query_id": "int64", "chunk_id": "int64"})
        if questions.empty or own_chunks.empty:
            return none
        return pd.concat([none, *_nearest(questions, pool)(iter([own_chunks]))])

    key = ("organization_id", "q", "c")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)


def _nearest(asked: pd.DataFrame, pool: int):
    groups = {}
    for org, part in asked.groupby("organization_id"):
        matrix = np.stack([np.asarray(e, dtype=np.float64) for e in part["embedding"]])
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        groups[org] = (part["query_id"].to_numpy(), matrix / np.where(lengths, lengths, 1), lengths[:, 0] > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        parts = (batch.iloc[at : at + _SLICE] for batch in batches for at in range(0, len(batch), _SLICE))
        for batch in parts:
            for org, part in batch.groupby("organization_id"):
                if org not in groups:
                    continue
                ids, questions, asked_for = groups[org]
                own = np.stack([np.asarray(e, dtype=np.float64) for e in part["embedding"]])
                lengths = np.linalg.norm(own, axis=1)
                own, chunk = own[lengths > 0] / lengths[lengths > 0, None], part["chunk_id"].to_numpy()[lengths > 0]
                scores = np.round(questions @ own.T, 9)
                for i in np.flatnonzero(asked_for):
                    old_chunk, old_score = best.get((org, i), (chunk[:0], scores[i, :0]))
                    all_chunk, all_score = np.r_[old_chunk, chunk], np.r_[old_score, scores[i]]
                    if len(all_score) > 4 * pool:  # what is below the pool-th best can go unsorted
                        least = np.partition(all_score, -pool)[-pool]
                        all_chunk, all_score = all_chunk[all_score >= least], all_score[all_score >= least]
                    keep = np.lexsort((all_chunk, -all_score))[:pool]
                    best[org, i] = (all_chunk[keep], all_score[keep])
        for (org, i), (chunk, score) in best.items():
            yield pd.DataFrame({"query_id": groups[org][0][i], "chunk_id": chunk, "vector_score": score})

    return run


def candidate_ranks(candidates: DataFrame, score: str) -> DataFrame:
    """0-based place in a question's list, best first, ties by chunk id."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return candidates.withColumn("rank0", F.row_number().over(best) - 1)


def fuse_candidates(by_vector: DataFrame, by_keyword: DataFrame) -> DataFrame:
    """Full outer join of both lists with their scores (0 if absent) and fused_score."""
    v = candidate_ranks(by_vector, "vector_score").withColumnRenamed("rank0", "vector_rank")
    k = candidate_ranks(by_keyword, "keyword_score").withColumnRenamed("rank0", "keyword_rank")
    return v.join(k, ["query_id", "chunk_id"], "full_outer").select(
        "query_id",
        "chunk_id",
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"),
        (vx.rrf(F.col("vector_rank")) + vx.rrf(F.col("keyword_rank"))).alias("fused_score"),
    )


def score_floor(fused: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    near = ~F.isnan("vector_score") & (F.col("vector_score") >= min_score)
    return fused.filter(near | (F.col("keyword_score") > 0))


def fused_topk(fused: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """(…, rank): the k best of each question above the floor, rank from 1."""
    best = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "chunk_id")
    return score_floor(fused, min_score).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
