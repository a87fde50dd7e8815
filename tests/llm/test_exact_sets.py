"""Exact duplicates, manifests and spelling variants against SQL and plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.test_documents import ODD, REPEATED, empty, odd
from tests.test_queries import plain
from tidemark.llm import exact_dedup, manifest, queries, spelling

OPERATORS = {
    "op11_exact_dedup": exact_dedup.exact_duplicates,
    "op12_manifest": manifest.manifest,
    "op13_spelling": spelling.spelling_variants,
}


def same(got, want):
    pd.testing.assert_frame_equal(plain(got), plain(want))


def by_sql(name, rows):
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    documents = pa.table({c: pa.array(v, t) for c, v, t in zip(columns, zip(*rows), types, strict=True)})
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(queries.oracle_sql()[name]).df()


@pytest.mark.parametrize("name", OPERATORS)
def test_query(spark, duck, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("rows", [ODD, REPEATED, [ODD[0]], [(None, None, None, None, None)] * 3])
def test_odd_rows(spark, name, rows):
    same(OPERATORS[name](odd(spark, rows)).toPandas(), by_sql(name, rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0


# --- exact duplicates ---


def copies():
    """Long texts that differ in one place, white space that does not count, and a hot text."""
    rng = random.Random(5)
    long = "".join(rng.choice("abc déß漢 \n") for _ in range(60_000)) + "."
    rows = [(i, long[:k] + "#" + long[k + 1 :]) for i, k in enumerate((0, 4095, 4096, 30_000, 59_999))]
    rows += [(10, long), (11, long.replace(" ", "\t ")), (12, long + " "), (13, long + "  "), (9, long)]
    rows += [(100 + i, "the same") for i in range(400)] + [(None, "the\nsame"), (5, "the same"), (5, "the same")]
    return [(i, t, "en", "a", 1) for i, t in rows]


@pytest.mark.parametrize("sizes", [{}, {"part_bytes": 1000, "compared_bytes": 1 << 12}, {"prime": 3, "part_bytes": 64, "compared_bytes": 50}])
def test_parts_and_collisions(spark, sizes):
    """Results do not depend on how texts are cut, nor on fingerprints that fall together."""
    rows = copies()
    same(exact_dedup.exact_duplicates(odd(spark, rows), **sizes).toPandas(), by_sql("op11_exact_dedup", rows))


def test_deduplicate(spark):
    docs = odd(spark, copies())
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.select("doc_id").collect()) == [-1, 0, 1, 2, 3, 4, 9, 12]
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def horner(text, point, prime):
    text, value = text + b"\0" * (len(text) % 2), 0
    for i in range(0, len(text), 2):
        value = (value * point + int.from_bytes(text[i : i + 2], "little")) % prime
    return value


@given(st.binary(max_size=40), st.integers(0, 6), st.binary(max_size=40), st.sampled_from([exact_dedup.PRIME, 101]))
def test_values_combine(a, stretch, b, prime):
    a = (a * 1 + b"\xff" * (4096 * stretch - 3 if stretch else 0)) + b"\0"
    a = a[: len(a) // 2 * 2]
    left, right, both = exact_dedup.values([a, b, a + b], prime)
    assert both == exact_dedup.combine(left, right, exact_dedup.units_of(len(b)), prime)
    assert both == tuple(horner(a + b, p, prime) for p in exact_dedup.POINTS)


# --- manifest ---


def tree(digests):
    """Levels of a tree, and the proof of each leaf: (siblings before, behind) by level."""
    proofs, places, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for proof, i in zip(proofs, places, strict=True):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            proof.append((run[: i % 8], run[i % 8 + 1 :]))
        level = [hashlib.sha256("".join(level[k : k + 8]).encode()).hexdigest() for k in range(0, len(level), 8)]
        places = [i // 8 for i in places]
    return level[0], proofs


def manifest_of(rows):
    def leaf(*values):
        said = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)
        return hashlib.sha256(said.encode()).hexdigest()

    langs = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = text and "".join(c.lower() if c < "\x80" else c for c in text)
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        own = leaf(doc_id, source, lang, n_chars, text)
        order = (doc_id is not None, doc_id or 0, own)
        langs.setdefault(lang, []).append((order, doc_id, own, leaf(doc_id, source, lang, n_chars, low) if changed else own))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    lower = {lang: tree([x[2] for x in sorted(langs[lang])]) for lang in names}
    root, upper = tree([lower[lang][0] for lang in names])
    out = []
    for lang, above in zip(names, upper, strict=True):
        for (_, doc_id, own, changed), proof in zip(sorted(langs[lang]), lower[lang][1], strict=True):
            folded, siblings = changed, ""
            for before, behind in [*proof, *above]:
                folded = hashlib.sha256("".join([*before, folded, *behind]).encode()).hexdigest()
                siblings += "".join([*before, *behind])
            out.append((doc_id, own, lower[lang][0], root, hashlib.sha256(siblings.encode()).hexdigest(), folded, folded == root))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


@pytest.mark.parametrize("langs", [1, 3, 70])
def test_manifest_of_many_rows(spark, langs):
    """A group of half the rows, rows of one id, identical rows, and as many groups as need levels."""
    rng = random.Random(langs)
    rows = [(i, f"Text {i}", f"l{min(rng.randrange(2 * langs), langs - 1):02d}", "s", i) for i in range(700)]
    rows += [(None, "one", "l00", None, 1)] * 90 + [(7, f"t{i}", "l00", "s", 1) for i in range(40)]
    same(manifest.manifest(odd(spark, rows)).toPandas(), manifest_of(rows))


# --- spelling variants ---


def edits(word):
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def near_of(words):
    return {(w, x) for w in words for x in edits(w) & set(words) if x != w}


@pytest.mark.parametrize("cell_words", [4096, 3])
def test_near_words(spark, monkeypatch, cell_words):
    """Dense words, anagrams, long ones, and cells so small that each split is crossed."""
    monkeypatch.setattr(spelling, "CELL_WORDS", cell_words)  # read where the trees are planned
    rng = random.Random(1)
    words = {"".join(rng.choice("abàÿ") for _ in range(rng.randrange(1, 9))) for _ in range(500)}
    words |= {"x" * k for k in range(95, 112)} | {"x" * 104 + "y", "z" * 300, "z" * 299}
    words |= {"streng", "string", "gnirts", "sting", "strings"}
    df = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    got = spelling.near_words(df).select("word", "near").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == near_of(words)


def test_forms_are_followed(spark):
    words = {"kettle": 5 * 5**3, "kettlef": 5 * 5**2, "kettleff": 5 * 5, "kettlefff": 5, "ketale": 200, "kattle": 200}
    rows = [(i, " ".join([w] * n), "en", "a", 1) for i, (w, n) in enumerate(words.items())]
    got = {r.word: r for r in spelling.spelling_variants(odd(spark, rows), damage=0).collect()}
    assert {w: (r.form, r.root, r.n) for w, r in got.items()} == {
        "kettle": (None, "kettle", 625),
        "kettlef": ("kettle", "kettle", 125),
        "kettleff": ("kettlef", "kettle", 25),
        "kettlefff": ("kettleff", "kettle", 5),
        "ketale": (None, "ketale", 200),
        "kattle": (None, "kattle", 200),
    }
    assert got["kettle"].n_near == 3 and got["kettlefff"].form_n == 25


def test_words_of_long_texts(spark):
    """Texts beyond a slice, runs beyond the steps of a checksum, and letters outside."""
    run = "q" * 70 + "É" * 40
    text = f"{run} Straße-STRASSE漢{run}×÷ " * 60_000
    rows = [(-3, text, "de", "a", 1), (4, "É" * 3_000_000 + " " + "x", "de", "a", 1)]
    got = {r.word: r.n for r in spelling.count_words(odd(spark, rows)).collect()}
    want = {}
    for doc_id, t, *_ in rows:
        for w in re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if c < "\x80" else c for c in t)):
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            if len(w) >= 6:
                want[w] = want.get(w, 0) + 1
    assert got == want


@given(st.lists(st.text(st.characters(min_codepoint=97, max_codepoint=122), max_size=90), min_size=1, max_size=20))
def test_checksums(runs):
    begun = np.array([zlib.crc32(b"%d:" % i) for i in range(len(runs))], np.uint32)
    got = spelling.checksums(pa.array(runs), begun)
    assert got.tolist() == [zlib.crc32(f"{i}:{r}".encode()) for i, r in enumerate(runs)]
