"""Whole searches: questions and chunks in, ranked chunks out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import index, retrieval
from tidemark.operators.bounds import small
from tidemark.sources.shared import save


def keyword_search(questions: DataFrame, chunks: DataFrame, k: int = retrieval.TOP_K) -> DataFrame:
    """The k best chunks of each question by keywords alone, with rank and excerpt.

    Chunks are stored first, as they are read for postings and for excerpts. The ranked rows
    are at most k a question; below a bound they are broadcast, so the chunks' texts are not
    shuffled to be looked up.
    """
    chunks = save(chunks, "chunks")
    terms = save(retrieval.query_terms(questions), "terms")
    found = retrieval.keyword_candidates(terms, index.postings(chunks, terms))
    best = Window.partitionBy("query_id").orderBy(F.desc("keyword_score"), "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    few = small(ranked, k * questions.count(), 64)
    return few.join(chunks, "chunk_id").select(
        "query_id", "rank", "chunk_id", "source_id", "section", "keyword_score", tx.excerpt(F.col("content")).alias("excerpt")
    )


def fused(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Candidates of questions (with embedding) by vectors and by keywords, fused. The chunks'
    vectors may be a table of their own, so that they need not be joined to the texts."""
    by_vector = retrieval.vector_candidates(questions, chunks if vectors is None else vectors)
    terms = save(retrieval.query_terms(questions), "terms")
    by_keyword = retrieval.keyword_candidates(terms, index.postings(chunks, terms))
    return retrieval.fuse_candidates(by_vector, by_keyword)
