"""Hashed and given vectors, and the scores of retrieval."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
FNV_START, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF
DIMENSIONS, BIGRAM_WEIGHT = 768, 0.5
#: Sum of 1/j^2 over all j, and the weight of an unlabelled word.
INVERSE_SQUARES, WORD_WEIGHT = 1.64493406685, 0.1
RRF_K = 60
# ---- end of fixed values


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the characters of a text."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(MASK32))
    return F.aggregate(F.split(text, ""), F.lit(FNV_START).cast("long"), step)


@cache
def _bucket(feature: str) -> int:
    value = FNV_START
    for unit in np.frombuffer(feature.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        value = (value ^ unit) * FNV_PRIME & MASK32
    return value


def embed_tokens(tokens: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vector of signed counts of words and, at half weight, of pairs of words."""
    vector = np.zeros(dimensions)
    pairs = [f"{a}_{b}" for a, b in zip(tokens, tokens[1:])]
    for features, weight in ((tokens, 1.0), (pairs, BIGRAM_WEIGHT)):
        hashes = np.array([_bucket(f) for f in features], dtype=np.int64)
        np.add.at(vector, hashes % dimensions, np.where(hashes % 2 == 1, weight, -weight))
    length = np.linalg.norm(vector)
    return vector / length if length else vector


def hash_embedding(tokens: Column, dimensions: int = DIMENSIONS, kind: str = "float") -> Column:
    """Embedding of an array of tokens; the zero vector without any."""

    dtype = {"float": np.float32, "double": np.float64}[kind]

    @F.pandas_udf(f"array<{kind}>")
    def embed(column: pd.Series) -> pd.Series:
        if _bucket.cache_info().currsize > 1_000_000:
            _bucket.cache_clear()
        return column.map(lambda t: embed_tokens(list(t) if t is not None else [], dimensions).astype(dtype))

    return embed(tokens)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if a vector is missing, empty or of length 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    lengths = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n > 0) & (lengths > 0), dot(x, y) / lengths).otherwise(0.0)


def lexical_score(query: Column, tokens: Column) -> Column:
    """How many query tokens occur in the text, over the root of the text's tokens."""
    hits = F.size(F.filter(query, lambda t: F.array_contains(tokens, t)))
    return F.when(F.size(tokens) > 0, hits / F.sqrt(F.size(tokens))).otherwise(0.0)


def term_rank(tf: Column) -> Column:
    """Share of one term in the keyword rank: its tf occurrences weigh 1, 1/4, 1/9 and so
    on. From 10,000 on the sum no longer changes within double precision of the rank."""
    # occurrences of one term in one chunk, bounded by the chunk's length
    return F.aggregate(F.sequence(F.lit(1), tf.cast("int")), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (j * j))


def keyword_rank(sum_of_terms: Column, query_terms: Column) -> Column:
    return F.lit(WORD_WEIGHT / INVERSE_SQUARES) * sum_of_terms / query_terms


def rrf(rank0: Column) -> Column:
    """Share of one list in the fused score; 0 for what is not in the list."""
    return F.coalesce(F.lit(1.0) / (RRF_K + rank0 + 1), F.lit(0.0))
