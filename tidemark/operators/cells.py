"""Exact nearest chunks with pruning: cells of vectors, skipped as a whole by their bounds.

The vectors of an organisation, of length 1, are parted into cells around centres (k-means on
a bounded sample; all vectors are assigned). A cell's radius is the largest distance of its
vectors from the centre, so none of them is nearer to a question than the centre's distance
less the radius. The nearest cells of a question give the distance that its pool reaches; of
the others only those are multiplied whose bound is within it. So the answer is that of all
products, whatever the centres are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import retrieval
from tidemark.operators.bounds import small
from tidemark.sources.shared import save

#: Chunks of a cell on average, most cells of all organisations, vectors that the centres of an
#: organisation are fitted on (more or less), and rounds of the fit.
CELL_CHUNKS, MOST_CELLS, SAMPLE, ROUNDS = 512, 1 << 14, 20_000, 8
#: Distances come from rounded products; bounds have to pass by more.
_MARGIN = 1e-6
_KEY = ["organization_id", "cell"]


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _fit(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
    """Centres by Lloyd's rounds, begun at vectors that are spread over the sample."""
    points = _unit(sample.sort_values("chunk_id")["embedding"])
    k = min(len(points), int(sample["k"].iloc[0]))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return pd.DataFrame({"organization_id": [key[0]] * k, "cell": range(k), "centre": [*centres]})


def _with_vectors(chunks: DataFrame) -> DataFrame:
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return chunks.filter("embedding IS NOT NULL").select("organization_id", "chunk_id", "embedding").filter(length > 0)


def build_cells(chunks: DataFrame, cell_chunks: int = CELL_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """(organization_id, cell, chunk_id, embedding, part) of chunks, and their cells
    (organization_id, cell, centre, radius, n, parts), both stored. A cell of more than
    retrieval.CHUNK_BLOCK chunks, be they all alike, has several parts. Chunks without a vector
    or of length 0 are left out; a null organisation is one of its own."""
    rows = _with_vectors(chunks)
    kind = dict(rows.dtypes)["organization_id"]
    counts = save(rows.groupBy("organization_id").agg(F.count("*").alias("n_rows")), "tenants")
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    each = max(cell_chunks, -(-total // MOST_CELLS))
    about = counts.select(F.col("organization_id").alias("org"), F.ceil(F.col("n_rows") / each).cast("int").alias("k"), F.least(F.lit(1.0), SAMPLE / F.col("n_rows")).alias("share"))
    sample = rows.join(small(about, counts.count(), 64), F.col("organization_id").eqNullSafe(F.col("org")))
    sample = sample.filter((F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) / float(1 << 30) < F.col("share")) | (F.col("k") <= 1))
    sample = sample.select("organization_id", "chunk_id", "embedding", "k")
    fitted = save(sample.filter("k > 1").groupBy("organization_id").applyInPandas(_fit, f"organization_id {kind}, cell int, centre array<double>"), "centres")
    centres = {org: _matrix(part) for org, part in fitted.toPandas().groupby("organization_id", dropna=False)}  # MOST_CELLS rows

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for org, part in batch.groupby("organization_id", dropna=False):
                points = _unit(part["embedding"])
                middle = centres.get(org)
                if middle is None:
                    cell, distance = np.zeros(len(part), int), np.ones(len(part))  # a cell around the origin
                else:
                    cell = (points @ middle.T - (middle**2).sum(axis=1) / 2).argmax(axis=1)
                    distance = np.linalg.norm(points - middle[cell], axis=1)
                yield part[["organization_id", "chunk_id", "embedding"]].assign(cell=cell, distance=distance)

    assigned = save(rows.mapInPandas(assign, f"organization_id {kind}, chunk_id long, embedding array<float>, cell int, distance double"), "assigned")
    cells = assigned.groupBy(*_KEY).agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / retrieval.CHUNK_BLOCK).cast("int"))
    right = fitted.select(F.col("organization_id").alias("org"), F.col("cell").alias("of"), "centre")
    cells = save(cells.join(right, F.col("organization_id").eqNullSafe(F.col("org")) & (F.col("cell") == F.col("of")), "left").drop("org", "of"), "cells")
    parts = cells.select(F.col("organization_id").alias("org"), F.col("cell").alias("of"), "parts")
    placed = assigned.join(small(parts, MOST_CELLS, 32), F.col("organization_id").eqNullSafe(F.col("org")) & (F.col("cell") == F.col("of")))
    return save(placed.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).select(*_KEY, "part", "chunk_id", "embedding"), "celled"), cells


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part.sort_values("cell")["centre"].tolist())


def _bounds(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, organization_id, cell, n, parts, nearest): how near a vector of each cell of a
    question's organisation can be. Cells are few beside their chunks."""
    pairs = asked.select("query_id", F.col("organization_id").alias("org"), F.col("embedding").alias("asked")).join(cells, F.col("org").eqNullSafe(F.col("organization_id")))
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length = F.sqrt(squares(F.col("asked")))
    apart = F.sqrt(squares(F.zip_with("asked", "centre", lambda x, c: x.cast("double") / length - c)))
    nearest = F.greatest(F.lit(0.0), F.coalesce(apart, F.lit(0.0)) - F.coalesce(F.when(F.col("centre").isNotNull(), F.col("radius")), F.lit(0.0)))
    return pairs.filter(length > 0).select("query_id", *_KEY, "n", "parts", nearest.alias("nearest"), "asked")


def _products(wanted: DataFrame, celled: DataFrame, pool: int) -> DataFrame:
    """The best chunks of questions in the parts of the cells that are wanted of each."""
    schema = "query_id long, chunk_id long, vector_score double"
    # equal keys, nulls among them: the text of an organisation, or that it has none
    named = lambda df: df.withColumn("organization_id", F.coalesce(F.concat(F.lit("="), F.col("organization_id").cast("string")), F.lit("-")))
    left = named(wanted).select("organization_id", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", F.col("asked").alias("embedding"))
    right = named(celled)

    def meet(questions: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "chunk_id": [], "vector_score": []}).astype({"query_id": "int64", "chunk_id": "int64"})
        if questions.empty or own.empty:
            return none
        blocks = (questions.iloc[at : at + retrieval.QUERY_BLOCK] for at in range(0, len(questions), retrieval.QUERY_BLOCK))
        return pd.concat([none, *(f for block in blocks for f in retrieval._nearest(block, pool)(iter([own])))])

    key = (*_KEY, "part")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, schema)


def search_cells(queries: DataFrame, celled: DataFrame, cells: DataFrame, pool: int = retrieval.POOL) -> tuple[DataFrame, DataFrame]:
    """retrieval.vector_candidates of questions (query_id, organization_id, embedding), and the
    cells that were multiplied for each (query_id, organization_id, cell, n)."""
    bounds = save(_bounds(queries.filter("embedding IS NOT NULL"), cells), "bounds")
    near = Window.partitionBy("query_id").orderBy("nearest", "cell")
    ranked = bounds.withColumn("before", F.coalesce(F.sum("n").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = save(ranked.filter(F.col("before") < pool), "first-cells")  # enough cells to fill a pool
    found = save(retrieval.top(_products(first, celled, pool), "vector_score", pool), "first-found")
    reached = found.groupBy("query_id").agg(F.count("*").alias("held"), F.min("vector_score").alias("least"))
    # unit vectors at a cosine of c are sqrt(2 - 2c) apart
    within = F.when(F.col("held") >= pool, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))) + _MARGIN).otherwise(F.lit(float("inf")))
    left = ranked.filter(F.col("before") >= pool).join(reached, "query_id", "left")
    rest = save(left.filter(F.col("nearest") <= F.coalesce(within, F.lit(float("inf")))).select(*first.columns), "other-cells")
    every = found.unionByName(_products(rest, celled, pool))
    return retrieval.top(every, "vector_score", pool), first.unionByName(rest).select("query_id", *_KEY, "n")
