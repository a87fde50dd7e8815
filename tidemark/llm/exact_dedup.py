"""Operator 11: exact duplicates by composable polynomial fingerprints.

A text with its white space folded is read as a sequence of 16-bit units, which are the
coefficients of a polynomial; the fingerprint is its value at two fixed points modulo a
prime, and the length. Values of chunks combine: value(a + b) = value(a) * point^units(b) +
value(b). So chunks are hashed side by side, as one product of matrices, and a huge text is
dealt out in parts to all tasks and put together by a sum of shifted values. Texts with one
fingerprint are compared chunk by chunk: chunks meet by fingerprint and number, equal ones
collapse inside each task, and texts whose chunks differ are told apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, lean, save, small

#: 16-bit units of a chunk; bytes of a part of a huge text, of a chunk that is compared.
UNITS, PART_BYTES, COMPARED_BYTES = 2048, 1 << 20, 1 << 16
PRIME = (1 << 61) - 1
#: Points at which the polynomials are evaluated.
POINTS = (0x0A1B2C3D4E5F6071, 0x13579BDF02468ACE)
#: Chunks that are multiplied at once.
_SLAB = 512
_LIMBS = 4
#: White space that is not one blank: only that has to be replaced.
_ODD_SPACE = re.compile(rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")

FINGERPRINT = ["h1", "h2", "n_bytes"]
_DIGESTS = "doc_id long, rid long, tie long, text_sha256 string, n_bytes long, h1 long, h2 long, after long, part binary"
_PIECES = "doc_id long, tie long, h1 long, h2 long, n_bytes long, no int, piece binary"


def fold_space(text: bytes) -> bytes:
    return _ODD_SPACE.sub(b" ", text)


@lru_cache(maxsize=4)
def _powers(prime: int) -> np.ndarray:
    """(UNITS, 2 * _LIMBS): powers of both points, highest first, in limbs of 16 bits. Sums of
    UNITS products of 16 bits by 16 bits are below 2^53, so floats hold them exactly."""
    columns = []
    for point in POINTS:
        power, powers = 1 % prime, []
        for _ in range(UNITS):
            powers.append(power)
            power = power * point % prime
        powers = np.array(powers[::-1], np.uint64)
        columns += [(powers >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(_LIMBS)]
    return np.stack(columns, axis=1).astype(np.float64)


def chunk_values(chunks: np.ndarray, prime: int = PRIME) -> list[tuple[int, int]]:
    """Values at both points of each row of chunks, (rows, UNITS) of 16 bits; zeros that fill
    up a row stand at its front, where they add nothing."""
    found = []
    for at in range(0, len(chunks), _SLAB):
        sums = (chunks[at : at + _SLAB].astype(np.float64) @ _powers(prime)).astype(np.int64).tolist()
        for row in sums:
            one, two = (sum(row[p * _LIMBS + k] << (16 * k) for k in range(_LIMBS)) % prime for p in (0, 1))
            found.append((one, two))
    return found


def combine(left: tuple[int, int], right: tuple[int, int], right_units: int, prime: int = PRIME) -> tuple[int, int]:
    """Values of a sequence from those of its two halves."""
    return tuple((a * pow(point, right_units, prime) + b) % prime for a, b, point in zip(left, right, POINTS, strict=True))


def units_of(n_bytes: int) -> int:
    return (n_bytes + 1) // 2


def values(texts: list[bytes], prime: int = PRIME) -> list[tuple[int, int]]:
    """Values of each text; an odd last byte is filled up by a zero, which the length tells."""
    found: list[tuple[int, int]] = []
    for start, end in _slabs([len(t) for t in texts]):
        filled, tails = [], []
        for text in texts[start:end]:
            units = np.frombuffer(text + b"\0" * (len(text) % 2), "<u2")
            whole = len(units) // UNITS * UNITS
            filled.append(units[:whole].reshape(-1, UNITS))
            tail = np.zeros((1, UNITS), "<u2")
            tail[0, UNITS - (len(units) - whole) :] = units[whole:]
            filled.append(tail)
            tails.append((whole // UNITS, len(units) - whole))
        got = iter(chunk_values(np.concatenate(filled), prime))
        for full, tail_units in tails:
            value = (0, 0)
            for _ in range(full):
                value = combine(value, next(got), UNITS, prime)
            found.append(combine(value, next(got), tail_units, prime))
    return found


def _slabs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together: of some slabs of chunks, or one text."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > 4 * _SLAB * UNITS:
            yield start, i
            start, total = i, 0
        total += size + 2 * UNITS
    if start < len(sizes):
        yield start, len(sizes)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text"):
        yield fold_space(text.as_buffer().to_pybytes())


def _digest(prime: int, part_bytes: int):
    """A row for each text: its id, a number of its own, SHA-256, length and values; a text
    longer than a part has no values yet, but a further row for each of its parts, with the
    units that come after it."""
    names = [c.split()[0] for c in _DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, short = [], []
            ids, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
            for doc_id, tie, text in zip(ids, ties, _texts(batch), strict=True):
                sha, size = hashlib.sha256(text).hexdigest(), len(text)
                if size <= part_bytes:
                    short.append(text)
                    rows.append([doc_id, rid, tie, sha, size, 0, 0, None, None])
                else:
                    yield batch_of([(doc_id, rid, tie, sha, size, None, None, None, None)])
                    for at in range(0, size, part_bytes):
                        part = text[at : at + part_bytes]
                        yield batch_of([(None, rid, None, None, size, None, None, units_of(size) - units_of(at + len(part)), part)])
                rid += 1
            for row, value in zip(rows, values(short, prime), strict=True):
                row[5:7] = value
            if rows:
                yield batch_of(rows)

    return run


def _shifted(prime: int):
    """Values of parts, shifted by the units that come after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, after = batch.column("rid"), batch.column("after").to_pylist()
            got = values([p.as_buffer().to_pybytes() for p in batch.column("part")], prime)
            moved = [combine(v, (0, 0), n, prime) for v, n in zip(got, after, strict=True)]
            columns = [pa.array([m[k] for m in moved], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([rids, *columns], ["rid", "p1", "p2"])

    return run


def digests(docs: DataFrame, id_col: str, text_col: str, prime: int = PRIME, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, rid (a number of its own), tie (hash of the text as
    it is), text_sha256 and the fingerprint h1, h2, n_bytes. Written to the shared folder."""
    if part_bytes % 2:
        raise ValueError("part_bytes has to be even, as units have two bytes")
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    made, _ = save(rows.mapInArrow(lean(_digest(prime, part_bytes)), _DIGESTS), "digests")
    # parts go to as many tasks as their bytes ask for; sums of values below 2^61 are exact
    parts = made.filter("part IS NOT NULL").select("rid", "after", "part").hint("rebalance")
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")) % F.lit(prime)
    sums = parts.mapInArrow(lean(_shifted(prime)), "rid long, p1 long, p2 long").groupBy("rid")
    huge, _ = save(sums.agg(total("p1").cast("long").alias("p1"), total("p2").cast("long").alias("p2")), "huge-texts")
    return (
        made.filter("part IS NULL")
        .drop("after", "part")
        .join(small(huge, huge.count(), 24), "rid", "left")
        .withColumns({"h1": F.coalesce("h1", "p1"), "h2": F.coalesce("h2", "p2")})
        .drop("p1", "p2")
    )


def _pieces(prime: int, wanted_bytes: int):
    """The chunks of texts, to be compared."""
    names = [c.split()[0] for c in _PIECES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            ids, ties = batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist()
            for doc_id, tie, text in zip(ids, ties, _texts(batch), strict=True):
                one, two = values([text], prime)[0]
                for no, at in enumerate(range(0, max(1, len(text)), wanted_bytes)):
                    rows.append((doc_id, tie, one, two, len(text), no, text[at : at + wanted_bytes]))
                    held += wanted_bytes
                    if held >= 64 * COMPARED_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    return run


def _parted(pieces: DataFrame, variants: DataFrame) -> DataFrame:
    """(doc_id, tie, fingerprint, variant) of texts whose fingerprint stands for different
    texts: a text is told by the places at which each of its chunks was first seen."""
    own = pieces.join(variants, [*FINGERPRINT, "no", "piece"])
    signature = F.array_sort(F.collect_set(F.struct("no", "seen")))
    signed = own.groupBy("doc_id", "tie", *FINGERPRINT).agg(signature.alias("signature"))
    first = signed.groupBy(*FINGERPRINT, "signature").agg(F.min(F.struct("doc_id", "tie")).alias("variant"))
    return signed.join(first, [*FINGERPRINT, "signature"]).drop("signature")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prime: int = PRIME,
    part_bytes: int = PART_BYTES,
    compared_bytes: int = COMPARED_BYTES,
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical once each run of ASCII white space is one blank. Of
    equal texts the row with the smallest id stays, null first; of several rows with that id
    one stays. A null text counts as empty, all empty texts are one group; an empty table
    gives an empty result; other columns are not read.
    """
    made = digests(docs, id_col, text_col, prime, part_bytes)
    repeated = made.groupBy(*FINGERPRINT).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated, _ = save(repeated, "repeated")
    n_repeated = repeated.count()

    # texts of repeated fingerprints, found again by a hash of what they were, are compared
    ties, _ = save(made.join(small(repeated, n_repeated, 32), FINGERPRINT, "left_semi").select("tie").distinct(), "ties")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    again = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    again = again.join(small(ties, ties.count(), 16), "tie", "left_semi").select("doc_id", "tie", "text")
    pieces = again.mapInArrow(lean(_pieces(prime, compared_bytes)), _PIECES)
    variants = pieces.groupBy(*FINGERPRINT, "no", "piece").agg(F.min(F.struct("doc_id", "tie")).alias("seen"))
    variants, _ = save(variants, "variants")
    differing = variants.groupBy(*FINGERPRINT, "no").agg(F.count("*").alias("n")).filter("n > 1").select(*FINGERPRINT)
    differing, _ = save(differing.distinct(), "differing")
    if n_differing := differing.count():  # then what one fingerprint stands for is no single text
        few = small(differing, n_differing, 32)
        parts = _parted(pieces.join(few, FINGERPRINT, "left_semi"), variants.join(few, FINGERPRINT, "left_semi"))
        parts, _ = save(parts, "parted")
        on = [F.col(f"m.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "tie", *FINGERPRINT)]
        made = made.alias("m").join(parts.alias("p"), on, "left").select("m.*", "p.variant")
    else:
        made = made.withColumn("variant", F.lit(None).cast("struct<doc_id:bigint,tie:bigint>"))

    groups = made.groupBy(*FINGERPRINT, "variant").agg(F.min(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("size"))
    groups, _ = save(groups.filter("size > 1"), "groups")
    few = small(groups, groups.count(), 80).alias("g")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) if c == "variant" else F.col(f"r.{c}") == F.col(f"g.{c}") for c in (*FINGERPRINT, "variant")]
    alone = F.col("g.size").isNull()
    return made.alias("r").join(few, on, "left").select(
        "r.doc_id",
        F.when(alone, F.col("r.doc_id")).otherwise(F.col("g.keep.doc_id")).alias("keep_id"),
        F.coalesce("g.size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("r.rid") == F.col("g.keep.rid"))).alias("kept"),
        "r.text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """docs without the rows that repeat a text; of equal texts the row with the smallest id
    stays. Rows that repeat id and text are one: they differ in nothing that is compared, so
    any of them stays. Nulls and empty tables are as exact_duplicates says."""
    stays = exact_duplicates(docs, id_col, text_col, **sizes).filter("kept").select("doc_id", "text_sha256")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    folded = F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), 256)
    own = {"dedup id": F.col(id_col).cast("long"), "dedup sha": folded}  # no names that docs may have
    stays = stays.toDF("stays id", "stays sha")
    same = F.col("`dedup id`").eqNullSafe(F.col("`stays id`")) & (F.col("`dedup sha`") == F.col("`stays sha`"))
    found = docs.withColumns(own).join(stays, same, "left_semi")
    return found.dropDuplicates([*own]).drop(*own)


#: Any of identical rows stays, so that row_number() names as many of them.
EXACT_SQL = r"""
WITH folded AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(text) AS text_sha256
FROM folded
WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS FIRST)
"""
