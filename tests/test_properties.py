"""Properties of the plain helpers."""

from collections import deque

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions.vectors import embed_tokens
from tidemark.streaming.replay import LOCK_AFTER, admit, login_steps


@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 5), st.integers(0, 50))
def test_limiter_never_admits_too_many(times, most, window):
    times = sorted(times)
    ok = admit(times, deque(), most, window)
    kept = [t for t, a in zip(times, ok) if a]
    for i, t in enumerate(kept):
        assert sum(t - window <= k <= t for k in kept[: i + 1]) <= most
    whole = deque()
    assert [x for t in times for x in admit([t], whole, most, window)] == ok


@given(st.lists(st.tuples(st.integers(0, 10**10), st.booleans()), max_size=40))
def test_locked_users_never_succeed(attempts):
    rows = [(i, t, True, True, ok) for i, (t, ok) in enumerate(sorted(attempts))]
    state = {"failures": 0, "locked_until": 0}
    until = 0
    for row in rows:
        (_, outcome, failures) = login_steps(state, [row])[0]
        assert (outcome == "account_locked") == (until > row[1])
        assert failures < LOCK_AFTER or state["locked_until"] > 0
        until = state["locked_until"]


@given(st.lists(st.text(min_size=1, max_size=8), max_size=30), st.integers(1, 64))
def test_embeddings_have_length_one_or_none(tokens, dimensions):
    length = np.linalg.norm(embed_tokens(tokens, dimensions))
    assert length < 1e-12 or abs(length - 1) < 1e-9


def test_vector_blocks(spark, monkeypatch):
    """Questions and chunks dealt in blocks give what one matrix gives."""
    import numpy as np

    from tidemark.operators import retrieval

    rng = np.random.default_rng(5)
    rows = lambda n: [(i, f"o{i % 3}", None if i % 17 == 5 else [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(n)]
    kind = "id long, organization_id string, embedding array<float>"
    asked, chunks = (spark.createDataFrame(rows(n), kind).withColumnRenamed("id", name) for n, name in ((40, "query_id"), (300, "chunk_id")))
    key = lambda df: sorted((r.query_id, r.chunk_id, r.vector_score) for r in df.collect())
    whole = key(retrieval.vector_candidates(asked, chunks, 7))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 30)
    assert key(retrieval.vector_candidates(asked, chunks, 7)) == whole and len(whole) > 200
