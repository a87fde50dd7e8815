"""What is shuffled, and what is not."""

import pytest

from tidemark.operators import access, index, postings, retrieval
from tidemark.plans import standins as st


@pytest.fixture
def no_size_known(spark):
    """As with tables whose size says nothing: only hints broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_are_exploded_last(spark):
    """A task holds users with their sets of roles, not a row for each of their codes."""
    frame = spark.createDataFrame
    users = frame([(1, True), (2, False), (3, False), (4, True), (6, False)], "id long, is_superadmin boolean")
    given = frame([(1, 7), (2, 7), (2, 8), (2, 8), (3, 9), (5, 8), (None, 7)], "user_id long, role_id int")
    of_role = frame([(7, 1), (7, 2), (8, 2), (8, 3), (8, 5), (10, 4)], "role_id int, permission_id long")
    codes = frame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "b")], "id long, code string")
    held = access.effective_permissions(users, given, of_role, codes)
    want = {1: "abcd", 4: "abcd", 2: "abc", 5: "bc", None: "ab"}
    assert sorted(map(tuple, held.collect()), key=str) == sorted(((u, c) for u, cs in want.items() for c in cs), key=str)
    steps = plan(held)
    assert "Generate explode" in steps and ("Exchange" not in steps or steps.index("Generate explode") < steps.index("Exchange"))


def test_words_are_counted_with_their_chunk(spark, no_size_known):
    """Texts are shuffled by chunk, their words not; a chunk in several rows is one text."""
    rows = [("o", 1, "b a A"), ("o", 1, "a c"), ("p", 1, "a"), (None, 2, "x"), ("o", 3, None), ("o", 4, "…"), ("o", 5, "سلام b_1 سلام")]
    chunks = spark.createDataFrame(rows, "organization_id string, chunk_id long, content string")
    found = index.postings(chunks)
    want = [("o", "a", 1, 3), ("o", "b", 1, 1), ("o", "c", 1, 1), ("p", "a", 1, 1), (None, "x", 2, 1), ("o", "سلام", 5, 2), ("o", "b_1", 5, 1)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    steps = plan(index.postings(chunks))
    assert steps.count("Exchange") == 1 and "hashpartitioning(organization_id" in steps and "term" not in steps.split("Exchange")[1].split("\n")[0]
    terms = retrieval.query_terms(spark.createDataFrame([(1, "o", "b_1 سلام"), (2, "q", "سلام")], "query_id long, organization_id string, text string"))
    own = index.postings(chunks, terms)
    assert sorted(map(tuple, own.select("term", "tf").collect())) == [("b_1", 1), ("سلام", 2)]
    assert "SortMergeJoin" not in plan(index.postings(chunks, terms))


def test_postings_and_texts_stay_where_they_are(spark, sf_dir, no_size_known, monkeypatch):
    """Terms go to the postings and ids to the texts: neither is shuffled to be joined."""
    terms = spark.createDataFrame([(1, "o", "a", 1)], "query_id long, organization_id string, term string, n_terms int")
    stored = spark.createDataFrame([("o", "a", 5, 2)], "organization_id string, term string, chunk_id long, tf long")
    steps = plan(retrieval.keyword_candidates(terms, stored))
    assert "BroadcastHashJoin" in steps and "SortMergeJoin" not in steps
    monkeypatch.setattr(st, "save", lambda df, name: df)
    texts = st.vector_texts(spark, sf_dir)
    assert "BroadcastHashJoin" in plan(texts) and "hashpartitioning" not in plan(texts)
    want = st.vector_rows(spark, sf_dir).select("chunk_id", "organization_id", "content", "lang")
    assert sorted(map(tuple, texts.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_blocks_are_cut_as_they_are_ranked(spark, no_size_known):
    """Postings are shuffled once, to be ranked; a term in several pieces has blocks in order."""
    rows = spark.range(6000).selectExpr("IF(id % 3 = 0, NULL, 'o') AS organization_id", "IF(id % 7 < 5, 'hot', concat('t', id % 50)) AS term", "id AS chunk_id", "id % 11 + 1 AS tf")
    blocks = postings.posting_blocks(rows, 16)
    found = {}
    for r in blocks.collect():
        assert r.most_tf == max(r.tfs) and r.least_chunk == r.chunk_ids[0] and 0 < len(r.chunk_ids) == len(r.tfs) <= 16
        assert found.setdefault((r.organization_id, r.term), {}).setdefault(r.block, (r.chunk_ids, r.tfs)) == (r.chunk_ids, r.tfs)
    want = {}
    for r in rows.collect():
        want.setdefault((r.organization_id, r.term), []).append((-r.tf, r.chunk_id))
    assert found.keys() == want.keys() and sum(len(b) for b in found.values()) == blocks.count()
    for key, own in found.items():
        assert sorted(own) == list(range(len(own)))
        assert [(-t, c) for b in sorted(own) for c, t in zip(*own[b])] == sorted(want[key])
    steps = plan(postings.posting_blocks(rows, 16))
    assert "collect_list" not in steps and "SortMergeJoin" not in steps
    assert postings.posting_blocks(rows.limit(0)).count() == 0
