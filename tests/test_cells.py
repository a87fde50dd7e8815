"""Nearest chunks by cells are those of all products, with fewer products."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import cells, retrieval

CHUNKS = "chunk_id long, organization_id string, embedding array<float>"


def clustered(spark, n=3000, groups=30, dims=16):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(groups, dims))
    rows = [(i, "big", (middles[i % groups] + rng.normal(size=dims) * 0.15).tolist()) for i in range(n)]
    rows += [(n + i, "alike", [1.0] * dims) for i in range(200)] + [(n + 300 + i, "small", rng.normal(size=dims).tolist()) for i in range(20)]
    rows += [(9990, "big", None), (9991, "big", [0.0] * dims), (9992, None, [1.0] * dims)]
    asked = [(i, "big", (middles[i] + rng.normal(size=dims) * 0.1).tolist()) for i in range(groups)]
    asked += [(100, "alike", [1.0, 2.0] * (dims // 2)), (101, "small", [1.0] * dims), (102, "none", [1.0] * dims), (103, "big", None), (104, "big", [0.0] * dims)]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, "query_id long, organization_id string, embedding array<float>")


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "vector_score").collect()))


def test_cells_give_the_nearest(spark, monkeypatch):
    chunks, asked = clustered(spark)
    celled, found = cells.build_cells(chunks, 50)
    assert celled.count() == chunks.count() - 2
    got, read = cells.search_cells(asked, celled, found)
    assert rows_of(got) == rows_of(retrieval.vector_candidates(asked, chunks))
    products = read.filter("query_id < 100").agg(F.sum("n")).first()[0]
    assert products < 0.3 * 30 * 3000
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 16)  # cells in parts, where many are alike
    celled, found = cells.build_cells(chunks, 200)
    assert celled.filter("organization_id = 'alike'").groupBy("part").count().count() > 8
    assert rows_of(cells.search_cells(asked, celled, found)[0]) == rows_of(retrieval.vector_candidates(asked, chunks))
    nothing = cells.build_cells(chunks.limit(0))
    assert cells.search_cells(asked, *nothing)[0].count() == 0


def test_cells_of_the_given_vectors(spark, sf_dir):
    from tidemark.plans import standins as st

    rows = st.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("one").alias("organization_id"), "embedding")
    asked = rows.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    got, _ = cells.search_cells(asked, *cells.build_cells(rows, 20))
    assert rows_of(got) == rows_of(retrieval.vector_candidates(asked, rows))
