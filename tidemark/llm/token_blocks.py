"""Operator 9: token ids in fixed-width bit-packed blocks.

A block is a row of a Parquet table: ids of whole consecutive documents, each in the
fewest bits that hold the vocabulary, little-endian, without gaps. Columns: shard and
block (order of the blocks), start (ids before it in its shard), n_ids, bits, doc_ids and
doc_tokens (the documents and how many ids each has), payload. Shards follow each other
in ascending doc_id order; a shard's first id is the sum of n_ids of the shards before.
Id i of a block starts at bit i * bits, so any range can be unpacked alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_KEY, bounded_batches, key_of, lean, partitions, shared_dir

END_ID = 0
#: A block is closed at the first document end past so many ids.
BLOCK_IDS = 1 << 17
#: Words whose ids a task remembers between batches (some 50 bytes each), and words that
#: pass the tokenizer as one text.
REMEMBERED, _TOGETHER = 300_000, 8192
BLOCKS = (
    "shard int, block int, start long, n_ids long, bits int,"
    " doc_ids array<long>, doc_tokens array<long>, payload binary"
)
_BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
_SLICE = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit-pack ids. Slices of 65,536 ids end on whole bytes. An id that does not fit is an
    error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    out = []
    for at in range(0, len(ids), _SLICE):
        part = np.ascontiguousarray(ids[at : at + _SLICE], dtype="<u4")
        rows = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(rows[:, :bits].reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids first to last (exclusive) of a block, reading only their bytes."""
    raw, out = np.frombuffer(payload, np.uint8), np.empty(last - first, "<u4")
    for at in range(first, last, _SLICE):
        n = min(_SLICE, last - at)
        byte, skip = divmod(at * bits, 8)
        flat = np.unpackbits(raw[byte : byte + (skip + n * bits + 7) // 8], bitorder="little")
        rows = np.zeros((n, 32), np.uint8)
        rows[:, :bits] = flat[skip : skip + n * bits].reshape(n, bits)
        out[at - first : at - first + n] = np.packbits(rows, axis=1, bitorder="little").view("<u4").reshape(-1)
    return out


#: Marks a word that no space precedes.
_MARK = "\x02"
#: White space as the tokenizer's first step knows it (Unicode White_Space), in Arrow's syntax.
_WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_NOT_LINE = _WHITE.replace("\\t-\\r", "\\t\\x0b-\\r")
#: Texts with other white space than single characters between words, and empty lines. They
#: go through the tokenizer whole, and so do texts with its special tokens.
_UNEVEN = f"^[{_WHITE}]|[{_WHITE}]$|[{_WHITE}]{{3}}|[{_NOT_LINE}][{_WHITE}]|[{_WHITE}][{_NOT_LINE}]|{_MARK}"
#: A full stop or comma that ends a word of Latin letters.
_STOP = "([A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}])([.,])( |$)"

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file; for each id, whether its token begins with a space; and the
    id of a line feed."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spaced = np.zeros(tokenizer.get_vocab_size(), bool)
        spaced[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        _tokenizers[path] = tokenizer, spaced, tokenizer.encode("\n", add_special_tokens=False).ids
    return _tokenizers[path]


def vocabulary_of(path: str) -> int:
    """Number of ids of the tokenizer of a file."""
    return len(_tokenizer(path)[1])


class Words:
    """Words (an Arrow array) and their ids: word i has size[i] of flat, from first[i]."""

    def __init__(self, words: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        self.words, self.flat, self.size, self.first = words, flat, size, np.cumsum(size) - size

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """The ids of words by number, one after the other."""
        size = self.size[codes]
        places = np.repeat(self.first[codes] - np.cumsum(size) + size, size)
        places += np.arange(len(places))
        return self.flat[places]

    def last(self, n: int) -> Words:
        at = max(0, len(self.words) - n)
        used = int(self.first[at]) if at < len(self.words) else len(self.flat)
        return Words(pa.concat_arrays([self.words.slice(at)]), self.flat[used:].copy(), self.size[at:].copy())

    def __add__(self, other: Words) -> Words:
        return Words(
            pa.concat_arrays([self.words, other.words]), np.r_[self.flat, other.flat], np.r_[self.size, other.size]
        )


class Encoder:
    """Encodes texts. Each distinct word of a batch passes the tokenizer at most once, all
    new words in one call; a task remembers the REMEMBERED last new ones, at least half.

    The tokenizer's first step parts a text where white space follows another character,
    before the last of several white-space characters, between white space and another
    character (a single space belongs to what it precedes), and between a letter and a full
    stop or comma. So words between spaces can be encoded apart; a word that no space
    precedes (at a text's or line's beginning, a line feed, a stop) has a mark before it.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.spaced, self.line = _tokenizer(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uneven = "|".join([_UNEVEN, *("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in special)])
        self.fixed = Words(pa.array([_MARK, f"{_MARK}\n"]), np.array(self.line, "<u4"), np.array([0, len(self.line)]))
        self.known = self.fixed

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def learn(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space at their ends, and how many each has. All are one
        text, each after a space (which is theirs) or a line feed (which is not)."""
        found = [self._learn(words[at : at + _TOGETHER], before) for at in range(0, len(words), _TOGETHER)]
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _learn(self, words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
        text = "".join([before + w for w in words])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.spaced[ids]) if before == " " else np.flatnonzero(ids == self.line[0])
        if len(starts) != len(words):  # some word holds what parts words
            return self.whole([before * (before == " ") + w for w in words])
        size = np.diff(np.r_[starts, len(ids)])
        return (ids, size) if before == " " else (np.delete(ids, starts), size - 1)

    def look_up(self, words: pa.Array) -> tuple[Words, np.ndarray]:
        """Known words, and the numbers of these (distinct) words among them."""
        known = self.known
        places = pc.fill_null(pc.index_in(words, known.words), -1).to_numpy().copy()
        missing = places < 0
        if missing.any():
            marked = pc.starts_with(words, _MARK).to_numpy(zero_copy_only=False)
            for of_kind, before in ((missing & ~marked, " "), (missing & marked, "\n")):
                if of_kind.any():
                    some = words.filter(pa.array(of_kind))
                    places[of_kind] = np.arange(len(some)) + len(known.words)
                    listed = some.to_numpy(zero_copy_only=False).tolist()
                    known += Words(some, *self.learn([w[1:] for w in listed] if before == "\n" else listed, before))
            self.known = known if len(known.words) <= REMEMBERED else self.fixed + known.last(REMEMBERED // 2)
        return known, places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        uneven = pc.match_substring_regex(texts, self.uneven).to_numpy(zero_copy_only=False)
        even = pc.replace_substring(texts.filter(pa.array(~uneven)), "\n", f" {_MARK}\n {_MARK}")
        even = pc.replace_substring_regex(pc.binary_join_element_wise(_MARK, even, ""), _STOP, f"\\1 {_MARK}\\2\\3")
        split = pc.split_pattern(even, " ")
        words = split.values.dictionary_encode()
        known, places = self.look_up(words.dictionary)
        codes = places[words.indices.to_numpy()]
        ids, counts = known.ids(codes), np.diff(np.r_[0, np.cumsum(known.size[codes])][np.asarray(split.offsets)])
        if not uneven.any():
            return ids, counts
        own, own_counts = self.whole(texts.filter(pa.array(uneven)).to_pylist())
        sizes = np.empty(len(texts), np.int64)
        sizes[~uneven], sizes[uneven] = counts, own_counts
        out, from_own = np.empty(sizes.sum(), "<u4"), np.repeat(uneven, sizes)
        out[from_own], out[~from_own] = own, ids
        return out, sizes


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    ids, counts = Encoder(path).encode(pa.array(texts, pa.string()))
    return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def _encode(path: str, end_id: int, bits: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        encoder = Encoder(path)
        held: list[np.ndarray] = []  # ids; and for each document its id and number of ids
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, start
            ids, documents, counts = map(np.concatenate, (held, docs, sizes))
            row = (shard, block, start, len(ids), bits, documents.tolist(), counts.tolist(), pack(ids, bits))
            block, start = block + 1, start + len(ids)
            for x in (held, docs, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)

        waiting = 0
        for batch in batches:
            ids, counts = encoder.encode(batch.column("text").cast(pa.string()))
            ends = np.cumsum(counts)
            ids, counts = np.insert(ids, ends, np.uint32(end_id)), counts + 1
            ends, names, done, first = ends + np.arange(1, len(ends) + 1), batch.column("doc_id").to_numpy(), 0, 0
            while done < len(counts):
                # up to the first document whose end makes a block full
                last = min(int(np.searchsorted(ends, first + block_ids - waiting)) + 1, len(counts))
                held.append(ids[first : ends[last - 1]])
                docs.append(names[done:last])
                sizes.append(counts[done:last])
                waiting += int(ends[last - 1]) - first
                done, first = last, int(ends[last - 1])
                if waiting >= block_ids:
                    yield close()
                    waiting = 0
        if held:
            yield close()

    return run


def write_blocks(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    vocabulary: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode all texts and write blocks to path, in ascending id order. vocabulary: number
    of ids, by default the tokenizer's; a larger id than these bits hold is an error.

    Documents are range-partitioned by id, then by a hash of the text, so that one
    repeated id does not fill a task. Null ids come first, as the smallest long; null
    texts are empty and give the end id alone; repeated rows are written each; an empty
    table gives a table without blocks; a long document makes one long block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        key_of(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    encode = _encode(tokenizer_path, end_id, bits_for(max(vocabulary or vocabulary_of(tokenizer_path), end_id + 1)), block_ids)
    ordered.select("doc_id", "text").mapInArrow(lean(encode), BLOCKS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with first_id: the number of ids in all blocks before. No documents, no blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")
    )
    joined = blocks.join(F.broadcast(before), "shard")  # one row a shard of the writer
    return joined.withColumn("first_id", F.col("before") + F.col("start")).drop("before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, unsigned 32-bit) of each document: a row for
    each row that was written, null ids and repeated rows among them, texts without words with
    the end id alone."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids binary", lambda ids: ids.tobytes(), "ids")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the blocks; rows
    are as read_documents says."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids), "ids_crc32")


def _read(spark: SparkSession, path: str, schema: str, value, name: str) -> DataFrame:
    """A row for each document: value of its ids, under name. The smallest long is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                ends = np.cumsum(b.doc_tokens)
                starts = ends - b.doc_tokens
                ids = unpack(b.payload, b.bits, 0, b.n_ids)
                yield pd.DataFrame(
                    {
                        "doc_id": b.doc_ids,
                        "start": b.first_id + starts,
                        "n_tokens": b.doc_tokens,
                        name: [value(ids[s:e]) for s, e in zip(starts, ends, strict=True)],
                    }
                )

    read = read_blocks(spark, path).mapInPandas(lean(run), schema)
    return read.withColumn("doc_id", F.expr(f"nullif(doc_id, {NULL_KEY + 1}L - 1L)"))


def token_report(docs: DataFrame, tokenizer_path: str, vocabulary: int | None = None) -> DataFrame:
    """Write docs to a new folder of blocks, and what read_checksums reads back: a row for each
    row of docs, in ascending order of ids, null first; a null text counts as empty; an empty
    table gives an empty result; other columns are not read."""
    path = f"{shared_dir(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    write_blocks(docs, path, tokenizer_path, vocabulary)
    return read_checksums(docs.sparkSession, path)
