"""Operator 8: SimHash near-duplicates, compared bit-sliced.

1. A 64-bit fingerprint of each text: per bit, the majority over the XXH64 values of
   its word shingles. Equal fingerprints collapse to one node before anything is compared.
2. The bits fall into `radius + 2` blocks; fingerprints within the radius agree on two
   whole blocks, so every pair of blocks is a bucket key and no link is lost.
3. In a bucket the fingerprints stand vertically, as 64 bit planes. Shifting the planes
   by d lanes compares all pairs d apart at once: the differing bits are added by
   carry-save counters, and words of lanes are abandoned once all exceed the radius.
   A bucket gives a spanning forest of its links, never all pairs. Buckets above a size
   are dealt to several tasks as pairs of blocks.
4. Connected components by alternating large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, drop, key_of, lean, partitions, quoted, save, small

SHINGLE_WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints of one bucket that are compared in one task; larger buckets are split.
BLOCK_ROWS = 8192
_SLICE = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint. Words are runs of other than ASCII white space, A-Z
    lower-cased; a text of fewer words is one shingle; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle_words, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends, n = ends - sizes, ends[k - 1 :], len(words) - k + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        spans = zip(starts[at : min(n, at + _SLICE)].tolist(), ends[at : at + _SLICE].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def simhash_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        values = [simhash(t, shingle_words) for t in texts]
        return pd.Series(np.array(values, dtype=np.uint64).view(np.int64), index=texts.index)

    return fingerprints(text)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(bits, words) of values (rows, 64-bit words): lane i of plane k is bit k of row i;
    one spare word at the end."""
    n, width = values.shape
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8 * width), axis=1, bitorder="little")
    lanes = np.zeros((64 * width, (n // 64 + 2) * 64), np.uint8)
    lanes[:, :n] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def close_lanes(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Indices i where rows i and i + shift differ in at most radius bits, of those whose
    bit is set in valid. The counters start so that radius + 1 differences overflow them."""
    word, bit = divmod(shift, 64)
    at = np.flatnonzero(valid)
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    counters = [np.full(len(at), _ALL if start >> i & 1 else 0, np.uint64) for i in range(size)]
    over = ~valid[at]
    last = planes.shape[1] - 1
    for k in range(0, len(planes), 8):
        low = planes[k : k + 8, np.minimum(at + word, last)]
        if bit:
            low = (low >> np.uint64(bit)) | (
                planes[k : k + 8, np.minimum(at + word + 1, last)] << np.uint64(64 - bit)
            )
        for carry in planes[k : k + 8, at] ^ low:
            for i, counter in enumerate(counters):
                counters[i], carry = counter ^ carry, counter & carry
            over |= carry
        live = over != _ALL
        if not live.any():
            return np.empty(0, np.int64)
        if not live.all():
            at, over, counters = at[live], over[live], [c[live] for c in counters]
    found = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows, lanes = np.nonzero(found)
    return at[rows] * 64 + lanes


def forest(
    values: np.ndarray, bucket: np.ndarray, radius: int, alike: Callable[[int, int], bool] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root), as row numbers, that join all rows of equal bucket linked by a
    chain of pairs within the radius; with alike, of those pairs only that it accepts.
    bucket: numbers of runs, as sorted."""
    _, inverse, size = np.unique(bucket, return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, -size[inverse]))  # larger buckets first: shifts end early
    order = order[size[inverse[order]] > 1]
    if not len(order):
        return order, order
    values, group, size = values[order], inverse[order], size[inverse[order]]
    planes, parent = bit_planes(values), np.arange(len(order))
    for shift in range(1, int(size[0])):
        lanes = np.searchsorted(-size, -shift, "left")  # lanes of buckets larger than shift
        n = min(lanes, len(order) - shift)
        apart = np.zeros((lanes // 64 + 1) * 64, np.uint8)  # of one bucket, not yet joined
        apart[:n] = (group[:n] == group[shift : shift + n]) & (parent[:n] != parent[shift : shift + n])
        if not apart.any():
            continue
        near = close_lanes(planes, shift, np.packbits(apart, bitorder="little").view("<u8"), radius)
        for i in near.tolist():
            a, b = i, i + shift
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b and (alike is None or alike(order[i], order[i + shift])):
                parent[max(a, b)] = min(a, b)
        if len(near):
            while (up := parent[parent] != parent).any():
                parent[up] = parent[parent[up]]
    moved = np.flatnonzero(parent != np.arange(len(order)))
    return order[moved], order[parent[moved]]


def _link_buckets(radius: int):
    """Links of rows (bucket, part, id, fp) sorted by bucket and part; fp: the bytes of one
    or more 64-bit words."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        rows = 0

        def flush(keys: np.ndarray, ids: np.ndarray, values: np.ndarray) -> pd.DataFrame:
            run = np.cumsum(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            a, b = forest(values, run, radius)
            return pd.DataFrame({"a": ids[a], "b": ids[b]})

        for batch in batches:
            words = np.frombuffer(b"".join(batch["fp"]), "<u8").reshape(len(batch), -1)
            held.append((batch[["bucket", "part"]].to_numpy(np.int64), batch["id"].to_numpy(np.int64), words))
            rows += len(batch)
            if rows < _SLICE:
                continue
            data = [np.concatenate(x) for x in zip(*held, strict=True)]
            ends = np.flatnonzero((data[0][1:] != data[0][:-1]).any(axis=1)) + 1
            if len(ends):  # the last bucket may go on in the next batch
                yield flush(*(x[: ends[-1]] for x in data))
                data = [x[ends[-1] :] for x in data]
            held, rows = [tuple(data)], len(data[0])
        if rows:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return link


def _in_parts(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows (bucket, id, ...) with part: a bucket of large (bucket, blocks) is cut into blocks
    by a hash of the id, and each pair of blocks meets in a part of its own."""
    large, _ = save(large, "large-buckets")
    if not (n_large := large.count()):
        return rows.withColumn("part", F.lit(0).cast("long"))
    rows = rows.join(small(large, n_large, 64), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("own", F.expr("pmod(xxhash64(id), blocks)")).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return rows.withColumn("part", part).drop("blocks", "own", "other")


def _link(rows: DataFrame, radius: int, block_rows: int) -> DataFrame:
    """Links (a, b) of rows (bucket, id, fp), buckets above block_rows in parts."""
    blocks = F.ceil(F.col("count") / block_rows).cast("long").alias("blocks")
    large = rows.groupBy("bucket").count().filter(F.col("count") > block_rows).select("bucket", blocks)
    return (
        _in_parts(rows, large).select("bucket", "part", "id", "fp")
        .repartition(partitions(rows.sparkSession), "bucket", "part")
        .sortWithinPartitions("bucket", "part")
        .mapInPandas(lean(_link_buckets(radius)), "a long, b long")
    )


def links(nodes: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints nodes.fp within the radius."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    block = lambda i: F.expr(
        f"shiftrightunsigned(fp, {cuts[i]}) & {(1 << (cuts[i + 1] - cuts[i])) - 1}L"
    )
    keys = [
        F.lit(n << 40).bitwiseOR(F.shiftleft(block(i), cuts[j + 1] - cuts[j])).bitwiseOR(block(j))
        for n, (i, j) in enumerate(combinations(range(radius + 2), 2))
    ]
    raw = F.unhex(F.lpad(F.hex("fp"), 16, "0"))  # the order of the bytes does not matter
    rows = nodes.select(F.col("fp").alias("id"), raw.alias("fp"), F.explode(F.array(*keys)).alias("bucket"))
    return _link(rows, radius, block_rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) that is not a root itself: root is the
    smallest node reachable."""
    spark = edges.sparkSession
    now, path = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        joined = star.join(least, "a").select("a", "b", "m")
        down = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, new_path = save(down.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        count = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(spark, path)
        now, path = new, new_path
        if tuple(count) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(count)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """One row for each row of docs: id, fp (signed long), component_id, and keeper: the
    (key, fp) of the row that stays for its component.

    component_id is the smallest id reachable by links of at most radius differing bits.
    Null and wordless texts have fingerprint 0 and are linked like any other; null ids
    take part but never name a component unless it has no other id; repeated rows share a
    component; an empty table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows, _ = save(
        docs.select(F.col(id_col).cast("long").alias(id_col), simhash_column(F.col(text_col), shingle_words).alias("fp")),
        "fingerprints",
    )
    nodes = rows.groupBy("fp").agg(
        F.min(id_col).alias("least"), F.min(key_of(id_col)).alias("least_key")
    )
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(
        F.min("least").alias("component_id"),
        F.min(F.struct(F.col("least_key").alias("key"), "fp")).alias("keeper"),
    )
    by_fp, _ = save(rooted.select("fp", "root").join(named, "root").drop("root"), "components")
    return rows.join(by_fp, "fp")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one row for each component: the one with the smallest id (null first).
    Null and wordless texts are linked like any other; repeated rows are one; an empty table
    stays empty; all columns are kept."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keepers = near_duplicates(docs, **options).select("keeper.key", "keeper.fp").distinct()
    keyed = docs.select(
        F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"),
        key_of(id_col).alias("key"),
        simhash_column(F.col(text_col), options.get("shingle_words", SHINGLE_WORDS)).alias("fp"),
    )
    kept = keyed.join(keepers, ["key", "fp"]).dropDuplicates(["key", "fp"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


# ---- near copies of a given similarity: wide fingerprints, and whole sets compared ----

WIDE_WORDS, SIMILAR_WORDS, SIMILARITY = 4, 5, 0.8
#: Share of the pairs of just the similarity that meet in some bucket; minima in a key.
RECALL, KEY_ROWS = 0.9999, 5
#: Standard deviations by which a pair of the similarity may differ in more bits than on average.
DEVIATIONS = 4
#: Shingle sets of one group that are compared in one task, by rows and bytes.
SET_ROWS, SET_BYTES = 1024, 8 << 20
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def share_of_bits(similarity: float) -> float:
    """Expected share of differing bits of two sets of a Jaccard similarity and one size."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_radius(similarity: float = SIMILARITY) -> int:
    """Differing bits of wide fingerprints up to which two sets may have the similarity."""
    share, bits = share_of_bits(similarity), 64 * WIDE_WORDS
    return int(bits * share + DEVIATIONS * np.sqrt(bits * share * (1 - share)))


def shingle_hashes(text: str | None, shingle_words: int = SIMILAR_WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of all word shingles; words as in simhash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    n = max(1, len(words) - shingle_words + 1)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words))
    mixed = np.zeros(n, "<u8")
    for i in range(min(shingle_words, len(words))):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def wide_simhash(hashes: np.ndarray) -> bytes:
    """SimHash of WIDE_WORDS 64-bit words of a set of hashes, as bytes."""
    counts = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # sums of one byte
        mixed = hashes[at : at + 255, None] * _ODD
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def key_tables(similarity: float) -> int:
    """Number of keys with which pairs of the similarity meet with the probability RECALL."""
    return int(np.ceil(np.log(1 - RECALL) / np.log(1 - similarity**KEY_ROWS)))


def sampled_keys(hashes: np.ndarray, tables: int) -> np.ndarray:
    """Signed keys of KEY_ROWS minima each: two sets agree on one with the probability
    similarity ** KEY_ROWS, whatever their sizes. An empty set has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    factors = np.random.default_rng(SEED).integers(0, 1 << 31, tables * KEY_ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low, least = hashes.astype(np.uint32), np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at : at + 512, None] * factors).min(axis=0), out=least)
    keys = np.arange(1, tables + 1, dtype=np.uint64)
    for column in least.reshape(tables, KEY_ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


_SKETCHES = "key long, text_hash long, digest binary, fp binary, size long, keys array<long>"


def _sketch(shingle_words: int, tables: int):
    """digest: of the set of shingles; fp: its wide fingerprint; size; keys: sampled keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, sizes, keys = [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), shingle_words)
                digests.append(hashlib.sha256(hashes).digest())
                prints.append(wide_simhash(hashes))
                sizes.append(len(hashes))
                keys.append(sampled_keys(hashes, tables))
            columns = [batch.column("key"), batch.column("text_hash"), pa.array(digests, pa.binary()), pa.array(prints, pa.binary())]
            columns += [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SKETCHES.split(", ")])

    return run


def _sets(shingle_words: int):
    """Rows (bucket, id, fp, text) with the hashes of all shingles in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), shingle_words).tobytes() for t in batch.column("text")]
            rest = [batch.column(c) for c in ("bucket", "id", "fp")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(hashes, pa.binary())], ["bucket", "id", "fp", "hashes"])

    return run


def _link_sets(radius: int, similarity: float):
    """Links (a, b) of rows (bucket, part, id, fp, hashes) sorted by bucket and part: of the
    pairs in a part whose fingerprints are within the radius, those whose sets have the
    similarity, as far as they join what is not joined yet."""

    def flush(rows: list[tuple]) -> pd.DataFrame:
        sets = [np.frombuffer(r[3], "<u8") for r in rows]

        def alike(i: int, j: int) -> bool:
            one, two = sorted((sets[i], sets[j]), key=len)
            if len(one) < similarity * len(two) - 1e-9:
                return False
            at = np.minimum(two.searchsorted(one), len(two) - 1)
            both = int(np.count_nonzero(two[at] == one))
            return both >= similarity * (len(one) + len(two) - both) - 1e-9

        runs = np.cumsum([0] + [a[0] != b[0] for a, b in zip(rows, rows[1:])])
        values = np.frombuffer(b"".join(r[2] for r in rows), "<u8").reshape(len(rows), -1)
        a, b = forest(values, runs, radius, alike)
        ids = np.array([r[1] for r in rows], np.int64)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = whole = 0  # bytes held; rows of groups that have ended
        for batch in batches:
            buckets, parts, ids = (batch.column(c).to_pylist() for c in ("bucket", "part", "id"))
            for row in zip(zip(buckets, parts), ids, batch.column("fp").to_pylist(), batch.column("hashes").to_pylist()):
                if held and row[0] != held[-1][0]:
                    whole = len(held)
                held.append(row)
                size += len(row[3]) + 64
                if size >= SET_BYTES and whole:
                    yield pa.RecordBatch.from_pandas(flush(held[:whole]), preserve_index=False)
                    held, whole = held[whole:], 0
                    size = sum(len(r[3]) + 64 for r in held)
        if held:
            yield pa.RecordBatch.from_pandas(flush(held), preserve_index=False)

    return link


def similar_groups(nodes: DataFrame, similarity: float) -> DataFrame:
    """(id, bucket) of the nodes (id, fp, keys) that may be alike: chains of pairs that share a
    key and whose wide fingerprints are within the radius have one bucket."""
    keyed = nodes.select("id", F.explode("keys").alias("bucket"))
    common = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    shared, _ = save(keyed.join(common, "bucket").join(nodes.select("id", "fp"), "id"), "shared-keys")
    found = components(_link(shared, wide_radius(similarity), BLOCK_ROWS))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.unionByName(roots).select(F.col("node").alias("id"), F.col("root").alias("bucket"))


def similar_links(rows: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between rows (bucket, id, fp, hashes) of one bucket whose sets have the
    similarity. sizes: (bucket, size) of the same rows; large buckets are cut into parts."""
    cut = F.ceil(F.greatest(F.count("*") / SET_ROWS, F.sum("size") * 8 / SET_BYTES)).cast("long")
    large = sizes.groupBy("bucket").agg(cut.alias("blocks")).filter("blocks > 1")
    return (
        _in_parts(rows, large).select("bucket", "part", "id", "fp", "hashes")
        .repartition(partitions(rows.sparkSession), "bucket", "part")
        .sortWithinPartitions("bucket", "part")
        .mapInArrow(lean(_link_sets(wide_radius(similarity), similarity)), "a long, b long")
    )


def deduplicate_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    shingle_words: int = SIMILAR_WORDS,
) -> DataFrame:
    """docs with one row for each group of near copies: the one with the smallest id, null
    first. Groups are joined by links of at least the Jaccard similarity of whole sets of
    word shingles; texts with equal sets are one group. Null and wordless texts are one
    group; repeated rows are one; an empty table stays empty; all columns are kept.

    Wide SimHash fingerprints are compared bit-sliced where MinHash keys agree; what is then
    linked by chains is compared again on whole sets. A pair at the similarity itself is
    compared with a probability of RECALL, less what DEVIATIONS leaves out; one above it
    with a higher one, at any number of documents. Ids and fingerprints are shuffled; texts
    only where the ids that go are too many for a broadcast.
    """
    bounded_batches(docs.sparkSession)
    key, text = key_of(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")
    text_hash = F.xxhash64(text).alias("text_hash")
    sketch = _sketch(shingle_words, key_tables(similarity))
    rows, _ = save(docs.select(key, text_hash, text).mapInArrow(lean(sketch), _SKETCHES), "sketches")
    place = F.struct("key", "text_hash")
    nodes, _ = save(
        rows.groupBy("digest").agg(F.min(place).alias("place"), *(F.first(c).alias(c) for c in ("fp", "size", "keys")))
        .select("place.*", "fp", "size", "keys", F.monotonically_increasing_id().alias("id")),
        "nodes",
    )
    repeated, _ = save(rows.groupBy("key", "text_hash").count().filter("count > 1").drop("count"), "repeated-rows")
    n_repeated = repeated.count()

    groups, _ = save(similar_groups(nodes, similarity).join(nodes.drop("keys"), "id"), "groups")
    wanted = small(groups.drop("size"), groups.count(), 160)
    members = docs.select(key, text_hash, text).join(wanted, ["key", "text_hash"])
    sets = members.select("bucket", "id", "fp", "text").mapInArrow(lean(_sets(shingle_words)), "bucket long, id long, fp binary, hashes binary")
    sets = sets.dropDuplicates(["id"]) if n_repeated else sets
    roots = components(similar_links(sets, groups.select("bucket", "size"), similarity)).withColumnRenamed("node", "id")

    rooted = nodes.select("key", "text_hash", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    keepers = rooted.groupBy("root").agg(F.min(place).alias("place")).select("place.*")
    gone, _ = save(rows.select("key", "text_hash").distinct().join(keepers, ["key", "text_hash"], "left_anti"), "near-copies")
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")
    kept = docs.select(row, key, text_hash).join(small(gone, gone.count(), 32), ["key", "text_hash"], "left_anti")
    if n_repeated:
        again = small(repeated, n_repeated, 32)
        once = kept.join(again, ["key", "text_hash"], "left_semi").dropDuplicates(["key", "text_hash"])
        kept = kept.join(again, ["key", "text_hash"], "left_anti").unionByName(once)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lowercase hex digits, and component_id: a row for each row of
    docs. Null and wordless texts have fingerprint zero and are linked like any other; a null
    id comes first, and is the component_id of what it is linked to; repeated rows are in one
    component; an empty table gives an empty result; other columns are not read."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
