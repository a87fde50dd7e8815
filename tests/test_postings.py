"""Stored postings with bounds give what all postings give, and read less."""

import random

from tidemark.operators import index, postings, retrieval


def chunks_of(spark, n, seed=1):
    rng = random.Random(seed)
    rare = [f"rare{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = ["the"] * rng.choice([1, 1, 1, 2, 5]) + (["pump"] * rng.choice([0, 0, 1, 3])) + rng.sample(rare, 2) + (["valve"] if rng.random() < 0.3 else [])
        rows.append((f"org{i % 2}", i, " ".join(words)))
    return spark.createDataFrame(rows, "organization_id string, chunk_id long, content string")


def asked(spark):
    texts = ["the", "the pump", "rare3 the", "rare1 rare2 valve", "nowhere", "pump valve the rare5"]
    rows = [(i, f"org{i % 2}", t) for i, t in enumerate(texts)] + [(90, "none", "the")]
    return retrieval.query_terms(spark.createDataFrame(rows, "query_id long, organization_id string, text string"))


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "keyword_score").collect()))


def test_pruned_search(spark, tmp_path):
    chunks, terms = chunks_of(spark, 4000), asked(spark)
    want = rows_of(retrieval.keyword_candidates(terms, index.postings(chunks)))
    table = postings.stored_postings(spark, str(tmp_path / "postings"), 8)
    postings.write_postings(table, chunks)
    assert rows_of(postings.search_stored(terms, table)) == want
    blocks = table.read()
    all_blocks = terms.join(blocks, postings.KEYS).count()
    read = postings.wanted_blocks(terms, blocks).count()
    assert read < all_blocks
    one = terms.filter("query_id = 0")
    assert postings.wanted_blocks(one, blocks).count() == 1 < one.join(blocks, postings.KEYS).count()
    assert max(len(r.chunk_ids) for r in blocks.collect()) == postings.BLOCK


def test_postings_follow_the_chunks(spark, tmp_path):
    """Chunks that go, come and change; the terms that they lack keep their files."""
    before, terms = chunks_of(spark, 600), asked(spark)
    table = postings.stored_postings(spark, str(tmp_path / "postings"), 64)
    postings.write_postings(table, before, block=16)
    gone = before.filter("chunk_id % 7 = 3")
    fresh = spark.createDataFrame([("org0", 10_000, "rare3 rare3 pump"), ("org1", 9, "pump pump pump pump"), ("new", 1, "words")], before.schema)
    changed = before.filter("chunk_id = 9")
    after = before.join(gone.unionByName(changed), "chunk_id", "left_anti").select(*before.columns).unionByName(fresh)
    for _ in range(2):  # done again it changes nothing
        postings.update_postings(table, gone.unionByName(changed), fresh, block=16)
        assert rows_of(postings.search_stored(terms, table)) == rows_of(retrieval.keyword_candidates(terms, index.postings(after)))
    touched = postings.update_postings(table, spark.createDataFrame([("new", 1, "words")], before.schema), before.limit(0), block=16)
    assert len(touched) == 1 and table.read().filter("organization_id = 'new'").count() == 0
    assert postings.search_stored(terms.limit(0), table).count() == 0
