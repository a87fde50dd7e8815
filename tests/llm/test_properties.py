"""Properties of the operators' plain helpers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import chat, line_chunks, simhash, token_blocks


@given(st.lists(st.integers(0, 2**20 - 1), max_size=300), st.integers(20, 32), st.data())
def test_packed_ranges(ids, bits, data):
    payload = token_blocks.pack(np.array(ids, "<u4"), bits)
    first = data.draw(st.integers(0, len(ids)))
    last = data.draw(st.integers(first, len(ids)))
    assert token_blocks.unpack(payload, bits, first, last).tolist() == ids[first:last]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd\nrole\\"]), st.text(alphabet="ab<|\\\n>_im_endstart é"))))
def test_formatted_turns_are_read_back(turns):
    formatted = "".join(f"{chat.START}{chat.escape_role(r)}\n{chat.escape(t)}{chat.END}\n" for r, t in turns)
    assert chat.parse(formatted) == turns


@given(st.lists(st.sampled_from(["", "a", "b b", "c " * 25, "d " * 30]), max_size=60))
def test_line_chunks_cover_all_lines_once(lines):
    covered = [i for first, n in line_chunks.chunk_lines(lines) for i in range(first, first + n)]
    assert covered == list(range(len(lines)))


@given(st.lists(st.text(alphabet="xyz", min_size=1, max_size=3), min_size=12, max_size=12, unique=True), st.lists(st.text(alphabet="pq", min_size=1, max_size=4), max_size=9), st.lists(st.text(alphabet="pq", min_size=1, max_size=4), max_size=9))
def test_chunk_boundaries_inside_a_passage_do_not_shift(passage, before, after):
    alone = line_chunks.chunk_lines(passage)
    moved = {(f - len(before), n) for f, n in line_chunks.chunk_lines(before + passage + after)}
    inner = [c for c in alone if c[0] > 2 and c[0] + c[1] < len(passage) - 2]
    assert all(c in moved for c in inner)


@settings(max_examples=40)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**12)), max_size=150), st.sampled_from([1, 3, 5]))
def test_forest_joins_what_pairs_join(rows, radius):
    rows.sort()
    bucket = np.array([b for b, _ in rows], np.int64)
    values = np.array([[v * 0x1001] for _, v in rows], "<u8").reshape(-1, 1)
    a, b = simhash.forest(values, bucket, radius)
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for x, y in zip(a.tolist(), b.tolist()):
        assert bucket[x] == bucket[y]
        root[find(x)] = find(y)
    for i in range(len(rows)):
        for j in range(i):
            if bucket[i] == bucket[j] and int(values[i, 0] ^ values[j, 0]).bit_count() <= radius:
                assert find(i) == find(j)
    assert len(a) <= max(len(rows) - 1, 0)


@settings(max_examples=60)
@given(st.lists(st.text(alphabet="ab'., \n\t\r\x0b\x1c éßΩ1<|endoftext|>-", max_size=40), max_size=5))
def test_pieces_encode_like_whole_texts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = _tokenizer(path, Tokenizer)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert token_blocks.encode_texts(texts, path) == want


_held = {}


def _tokenizer(path, kind):
    if path not in _held:
        _held[path] = kind.from_file(path)
    return _held[path]


@given(st.text(alphabet="aAÉé \t\n x", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash.simhash(text) == brute.simhash(text)


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.95])
def test_wide_fingerprints_estimate_similarity(similarity):
    rng = np.random.default_rng(2)
    distances = []
    for _ in range(40):
        shared = int(round(2000 * similarity / (1 + similarity)))
        words = [f"w{x}" for x in rng.integers(0, 10**9, 1000 + 1000 - shared)]
        a, b = words[:1000], words[1000 - shared :]
        x, y = (int.from_bytes(simhash.wide_simhash(simhash.shingle_hashes(" ".join(t), 1)), "little") for t in (a, b))
        distances.append((x ^ y).bit_count())
    assert abs(np.mean(distances) / 256 - simhash.share_of_bits(similarity)) < 0.03
