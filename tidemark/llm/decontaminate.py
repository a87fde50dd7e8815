"""Operator 6: benchmark items inside documents, by MinHash containment search.

Shingles are five words (an item of fewer words is one shingle). Items are partitioned
by size; an item of s distinct shingles, of the size class up to u, keeps as its MinHash
sketch the smallest u - ceil(t * u) + 1 shingle hashes. A document that contains a share
of at least t of the item lacks at most s - ceil(t * s) of its shingles, so it has one of
the sketch: probing sketches with a document's shingles misses nothing, however long the
document. Candidates are then verified by exact containment of the shingles' words.

The items are held by every task, in blocks of bounded size; each block passes over the
documents once. Of several blocks each is done with, its result written to the shared
folder, before the next one is read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, lean, quoted, save, small

SHINGLE_WORDS, THRESHOLD_PERCENT = 5, 80
#: Bytes of item texts that a task holds at once.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"[^\W_]+")
_MEMORY_WORDS = 50_000


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the lower-cased text."""
    return _WORD.findall((text or "").lower())


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < _MEMORY_WORDS:
            self[word] = value
        return value


_hash_of = _WordHashes()


def shingle_hashes(tokens: list[str], width: int) -> np.ndarray:
    """64-bit hashes of the runs of width tokens."""
    n = len(tokens) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_hash_of.__getitem__, tokens), np.uint64, len(tokens))
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


class Sketches:
    """Sketches of a block of items, and the exact check."""

    def __init__(self, items: list[tuple[int | None, str]], percent: int = THRESHOLD_PERCENT):
        self.percent = percent
        self.items: dict[int, list] = defaultdict(list)  # by shingle width: id, hashes, shingles
        probes: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            tokens = words(text)
            if not tokens:
                continue
            width = min(SHINGLE_WORDS, len(tokens))
            shingles = {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}
            hashes = np.unique(shingle_hashes(tokens, width))
            upper = (1 << len(shingles).bit_length()) - 1
            size = upper - -(-percent * upper // 100) + 1
            for h in hashes[:size].tolist():
                probes[width][h].append(len(self.items[width]))
            self.items[width].append((item_id, hashes, shingles))
        self.probes = {}
        for width, index in probes.items():
            known = np.array(sorted(index), np.uint64)
            first = np.zeros(1 << 20, bool)
            first[known >> np.uint64(44)] = True
            self.probes[width] = (first, known, dict(index))

    def search(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, distinct shingles, of them in the text) of each item contained."""
        found, tokens = [], words(text)
        for width, (first, known, index) in self.probes.items():
            hashes = shingle_hashes(tokens, width)
            maybe = hashes[first[hashes >> np.uint64(44)]]
            if not len(maybe):
                continue
            maybe = np.unique(maybe)
            hit = maybe[known[np.minimum(np.searchsorted(known, maybe), len(known) - 1)] == maybe]
            for i in sorted({i for h in hit.tolist() for i in index[h]}):
                item_id, own, shingles = self.items[width][i]
                where = np.flatnonzero(np.isin(hashes, own))
                in_both = {tuple(tokens[p : p + width]) for p in where.tolist()} & shingles
                if 100 * len(in_both) >= self.percent * len(shingles):
                    found.append((item_id, len(shingles), len(in_both)))
        return found


def item_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def item_blocks(items: DataFrame, text_col: str, block_bytes: int) -> Iterator[tuple[Sketches, bool]]:
    """Sketches of the distinct texts of the items (with item_key), block by block, and whether
    it is the last; the number of blocks grows with these texts, and the driver holds one at a
    time, however often an item is repeated."""
    texts = items.select(item_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    total, rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = (total + 64 * rows) // block_bytes + 1
    for n in range(blocks):
        part = texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == n).orderBy("key")
        yield Sketches([tuple(r) for r in part.collect()]), n == blocks - 1


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles and containment of each document
    and item of which at least 80 percent of the distinct shingles occur in the document.

    Null texts and texts without words contain nothing and are contained in nothing; null
    ids stay null; repeated rows each give their pairs; without items or documents the
    result is empty; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, key string, item_shingles long, shared_shingles long"

    def search(sketches: Sketches):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = batch["doc_id"].astype("Int64").array
                out = [
                    (ids[i], *found)
                    for i, text in enumerate(batch["text"])
                    for found in sketches.search(text)
                ]
                frame = pd.DataFrame(out, columns=["doc_id", "key", "item_shingles", "shared_shingles"])
                yield frame.astype({c: "Int64" for c in frame.columns if c != "key"} | {"key": object})

        return run

    found = None
    for sketches, last in item_blocks(items, "text", block_bytes):
        part = rows.mapInPandas(search(sketches), schema)
        part = part if last and found is None else save(part, "items-found")[0]
        found = part if found is None else found.unionByName(part)
    # an item that is repeated, under one id or several, is found once and given for each row
    ids = items.select(F.col("item_id").cast("long").alias("item_id"), item_key(F.col("text")).alias("key"))
    pairs = found.join(small(ids, ids.count(), 100), "key").select("doc_id", "item_id", "item_shingles", "shared_shingles")
    return pairs.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def contains_any(text: Column, sketches: Sketches) -> Column:
    """Whether a text contains an item; a null text or one without words does not."""
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bool(sketches.search(t)) for t in texts], dtype=bool)

    @F.pandas_udf("boolean")
    def contaminated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(found)(batches)

    return contaminated(text)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that contain an item, without a shuffle.

    Null texts and texts without words contain nothing and stay; repeated rows stay or go
    together; items without words are in no document; without items all stay; an empty
    table stays empty; all columns are kept.
    """
    bounded_batches(docs.sparkSession)
    for sketches, last in item_blocks(items, "text", block_bytes):
        docs = docs.filter(~contains_any(F.col(quoted(text_col)), sketches))
        docs = docs if last else save(docs, "decontaminated")[0]
    return docs


CONTAINED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT iid, item_id, least(5, len(w)) AS width,
         unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(w[p:p + least(5, len(w)) - 1], ' '))) AS s
  FROM i WHERE len(w) > 0),
sizes AS (SELECT iid, count(*) AS n FROM item_shingles GROUP BY iid),
doc_shingles AS (
  SELECT DISTINCT rid, doc_id, width,
         unnest(list_transform(range(1, len(w) - width + 2), lambda p: array_to_string(w[p:p + width - 1], ' '))) AS s
  FROM d CROSS JOIN (SELECT DISTINCT width FROM item_shingles) WHERE len(w) >= width),
pairs AS (
  SELECT rid, doc_id, i.iid, i.item_id, count(*) AS shared
  FROM doc_shingles d JOIN item_shingles i USING (width, s) GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS item_shingles, shared::BIGINT AS shared_shingles, shared / n AS containment
FROM pairs JOIN sizes USING (iid) WHERE 100 * shared >= 80 * n
"""
