"""Operator 10: globally repeated passages of lines, by content-defined chunks.

Hashes roll over the hashes of lines; a boundary is a local minimum of the rolled hash, so
that it moves with the lines around it. Chunks whose hash occurs again are compared by their
bytes, and all but the first occurrence (smallest doc_id, then line) go. That leaves the ends
of a repeated run, which share a chunk with lines outside of it, and runs that hold no whole
chunk: a boundary that looks at the lines inside a run of two alone would have to be at every
line. So each chunk that went is extended line by line, and what no chunk reaches is found,
by windows of two neighbouring lines: those inside a chunk that went are left out, which are
most of a long repeat, and those across a boundary or with a line that is still there are
compared in the same way. The result is that of comparing all windows.

A chunk or window has two lines at least, or is one line of at least LONG_LINE words: what a
repeated line that stands alone has to have to be a passage.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_KEY, bounded_batches, key_of, save, small

LONG_LINE, LEAST_LINES, MOST_LINES = 20, 2, 16
_MASK = (1 << 64) - 1
#: Bits of the table that tells spans that may be repeated: some for each repeated hash, from
#: a least to a largest size; where it is fuller more spans are compared, none is left out.
FILTER_BITS, MOST_FILTER_BITS, BITS_A_HASH = 1 << 20, 1 << 28, 16
#: Tells hashes of chunks from those of windows of the same lines.
_CHUNK = np.uint64(0xA5A5A5A5A5A5A5A5)
_ROLL = (0x243F6A8885A308D3, 0x13198A2E03707344)


def _is_long(line: str) -> bool:
    return len(line) >= 2 * LONG_LINE - 1 and len(line.split(None, LONG_LINE)) >= LONG_LINE


_last: list = [None, None, None]


def _known(lines: list[str]) -> tuple[list[tuple[int, int]], list[bool]]:
    """Two hashes of 64 bits of each line, and whether it is long. Those of the list asked for
    last are kept."""
    if _last[0] is not lines:
        raw = b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines])
        _last[:] = lines, list(struct.iter_unpack("<QQ", raw)), list(map(_is_long, lines))
    return _last[1], _last[2]


def chunk_lines(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, number of lines) of the content-defined chunks, in order."""
    chunks: list[tuple[int, int]] = []
    n, at, (hashes, long) = len(lines), 0, _known(lines)
    while at < n:
        if long[at]:
            chunks.append((at, 1))
            at += 1
            continue
        end = at
        while end < n and not long[end]:
            end += 1
        own = [h for h, _ in hashes[at:end]]
        rolled = [((a * 0x9E3779B97F4A7C15 ^ b) * 0xC2B2AE3D27D4EB4F) & _MASK for a, b in zip([0, *own], own)]
        start = at
        for i in range(at, end):
            k = i - at
            least = 0 < k < len(rolled) - 1 and rolled[k - 1] > rolled[k] < rolled[k + 1]
            if least or i + 1 == end or i + 1 - start == MOST_LINES:
                chunks.append((start, i + 1 - start))
                start = i + 1
        at = end
    return chunks


def spans_of(lines: list[str]) -> list[tuple[int, int]]:
    """Spans to compare: long lines, and all windows of LEAST_LINES lines but those of two
    long lines, which are compared one by one. Spans of blank lines are left out; more than
    two of them are in a span with the lines around them."""
    long = _known(lines)[1]
    blank = [not x.strip() for x in lines]
    spans = [(i, 1) for i, x in enumerate(long) if x]
    windows = range(len(lines) - LEAST_LINES + 1)
    spans += [
        (i, LEAST_LINES)
        for i in windows
        if not all(long[i : i + LEAST_LINES]) and not all(blank[i : i + LEAST_LINES])
    ]
    filled = [i for i, x in enumerate(blank) if not x]
    spans += [(i, j - i + 1) for i, j in zip(filled, filled[1:]) if j - i > LEAST_LINES + 1]
    return spans


def span_hashes(lines: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
    """(spans, 2) hashes of 64 bits, rolled over the 128-bit hashes of the lines in a span."""
    hashes, out = _known(lines)[0], []
    for first, count in spans:
        one, two = _ROLL
        for x, y in hashes[first : first + count]:
            one, two = (one ^ x) * 0x9E3779B97F4A7C15 & _MASK, (two ^ y) * 0x9E3779B97F4A7C15 & _MASK
            one, two = one ^ one >> 29, two ^ two >> 29
        out.append((one, two))
    return np.array(out, "<u8").reshape(-1, 2)


def chunk_spans(lines: list[str]) -> tuple[list[tuple[int, int]], list[int]]:
    """Chunks to compare (first line, number of lines), and the number of the chunk of each
    line. Single short lines and blank lines alone are no chunks to compare; of blank lines at
    an end of a chunk one is left, as more of them are in no window with a line of the chunk."""
    spans, of_line, long = [], [], _known(lines)[1]
    for number, (first, count) in enumerate(chunk_lines(lines)):
        of_line += [number] * count
        end = first + count
        while end - first > 1 and not lines[first].strip() and not lines[first + 1].strip():
            first += 1
        while end - first > 1 and not lines[end - 1].strip() and not lines[end - 2].strip():
            end -= 1
        if end - first >= LEAST_LINES or long[first]:
            spans.append((first, end - first))
    return spans, of_line


def _of(lines: list[str], hashes_of: Callable) -> tuple[list[tuple[int, int]], list[int], np.ndarray]:
    """Spans of a text, chunks first, then windows; the chunk that each is in, for a chunk the
    negative of its number less 2, for a window across chunks -1; and their hashes."""
    chunks, of_line = chunk_spans(lines)
    windows = [(f, n) for f, n in spans_of(lines) if n > 1]
    inside = [-2 - of_line[f] for f, _ in chunks] + [of_line[f] if of_line[f] == of_line[f + n - 1] else -1 for f, n in windows]
    found = hashes_of(lines, chunks + windows)
    found[: len(chunks), 0] ^= _CHUNK
    return chunks + windows, inside, found


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first hash of every span of the texts."""
    for batch in batches:
        found = [np.empty(0, "<u8")]
        for text in batch.column("text"):
            found.append(_of(text.as_py().split("\n"), span_hashes)[2][:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h1"])


def _spans(seen: Broadcast):
    """Spans (key, tie, inside, first, count, h1, h2, chunk) whose first hash may occur again:
    its bit is set in seen, a table of as many bits as its length says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(seen.value, np.uint8)
        for batch in batches:
            rows, hashes = [], [np.empty((0, 2), "<u8")]
            for key, tie, text in zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), batch.column("text"), strict=True):
                lines = text.as_py().split("\n")
                spans, inside, found = _of(lines, span_hashes)
                at = found[:, 0] % np.uint64(8 * len(bits))
                again = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                hashes.append(found[again])
                for i in again.tolist():
                    first, count = spans[i]
                    rows.append((key, tie, inside[i], first, count, "\n".join(lines[first : first + count])))
            h1, h2 = np.concatenate(hashes).view(np.int64).T
            columns = zip(*rows) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            *columns, chunk = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(h1), pa.array(h2), chunk], [c.split()[0] for c in _SPANS.split(", ")])

    return run


_SPANS = "key long, tie long, inside int, first int, count int, h1 long, h2 long, chunk string"


def _bits_of(repeated: DataFrame, size: int) -> bytes:
    """A table of size bits (a power of 2, from 64) with those of the hashes set. Words of 64 bits
    are made by aggregation, so no more than size / 64 rows reach the driver."""
    at = F.col("h1").bitwiseAND(F.lit(size - 1))
    word, bit = F.shiftrightunsigned("at", 6), F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = repeated.select(at.alias("at")).select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got, table = words.toArrow(), np.zeros(size // 64, np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table.astype("<i8").tobytes()


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, removed, spans = [], [], []
        for text, gone in zip(batch["text"], batch["gone"], strict=True):
            lines, kept, at, ranges = text.split("\n"), [], 0, []
            for first, count in sorted((int(g["first"]), int(g["count"])) for g in gone) if gone is not None else []:
                kept += lines[at:first]
                start, at = max(at, first), max(at, first + count)
                if start < at:
                    if ranges and ranges[-1][1] == start:
                        start = ranges.pop()[0]
                    ranges.append((start, at))
            texts.append("\n".join(kept + lines[at:]))
            removed.append(sum(e - f for f, e in ranges))
            spans.append(",".join(f"{f}:{e}" for f, e in ranges))
        yield pd.DataFrame({"doc_id": batch["key"], "text": texts, "removed_lines": removed, "removed_spans": spans})


def _later(spans: DataFrame) -> DataFrame:
    """(key, tie, inside, first, count) of the spans that occurred before; one that overlaps
    its first occurrence stays with it. Only first places and counts are shuffled by hash."""
    groups = spans.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("key", "tie", "first", "count")).alias("keep"))
    apart = (
        (F.col("key") != F.col("keep.key"))
        | (F.col("tie") != F.col("keep.tie"))
        | (F.col("first") >= F.col("keep.first") + F.col("keep.count"))
    )
    found = spans.join(groups.filter("times > 1"), ["h1", "h2"]).filter(apart)
    return found.select("key", "tie", "inside", "first", "count")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the text without its repeated chunks,
    removed_lines, and removed_spans (first line:end line, comma-joined).

    A null text counts as empty, a null id sorts first; rows with the same id and text are
    one document and keep the same lines; a text of one short line is never changed; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        key_of(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    counted = rows.select("text").mapInArrow(_hashes, "h1 long").groupBy("h1").agg(F.count("*").alias("times"))
    repeated, _ = save(counted.filter("times > 1").select("h1"), "repeated-hashes")
    size, n_repeated = FILTER_BITS, repeated.count()
    while size < min(MOST_FILTER_BITS, BITS_A_HASH * n_repeated):
        size *= 2
    seen = spark.sparkContext.broadcast(_bits_of(repeated, size))
    spans, _ = save(rows.mapInArrow(_spans(seen), _SPANS), "spans")
    # a hash stands for one sequence of bytes, else it is not used; copies collapse before
    # the shuffle, and only what may be repeated is shuffled with its text
    texts = spans.groupBy("h1", "h2", "chunk").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("texts"))
    several, _ = save(texts.filter("texts > 1").select("h1", "h2"), "several-texts")
    slim = spans.drop("chunk")
    if n_several := several.count():
        slim = slim.join(small(several, n_several, 16), ["h1", "h2"], "left_anti")
    chunks, _ = save(_later(slim.filter("inside < -1")), "later-chunks")
    went = chunks.select("key", "tie", (-2 - F.col("inside")).alias("inside"))
    windows = slim.filter("inside >= -1").join(went, ["key", "tie", "inside"], "left_anti")
    victims = chunks.drop("inside").unionByName(_later(windows).drop("inside"))
    victims = victims.groupBy("key", "tie").agg(F.collect_set(F.struct("first", "count")).alias("gone"))
    cleaned = rows.join(victims, ["key", "tie"], "left").select("key", "text", "gone").mapInPandas(
        _remove, "doc_id long, text string, removed_lines long, removed_spans string"
    )
    return cleaned.withColumn("doc_id", F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")))
