"""Operator 13: spelling variants, by k-d trees over letter-count vectors.

One edit moves the vector of letter counts of a word by at most two: a replaced letter takes
one count away and adds one elsewhere, an inserted letter adds one. So the neighbours of a
word of length l are sought among the words of length l within one step down and one up, and
among those of length l + 1 within one step up. For each length a k-d tree over the count
vectors cuts the words into cells of bounded size, a split being a letter and a count; a word
is sent to the cells whose box is in reach, where a deeper tree of the cell's own words is
searched the same way, and what its leaves hold is verified letter by letter.

The upper trees are fitted on a bounded sample of the words of each length; all words are
indexed, and reach is exact for any splits, so that the sample only bears on the cells' sizes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, lean, save

#: Words are runs of these letters, A-Z in lower case; the lower-case ones have vectors.
LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS, LEAST_TIMES = 6, 5
#: A form is so many times as frequent as its variant.
FORM_TIMES = 5
#: One checksum in so many, of id and word, loses a letter.
DAMAGED = 199
#: Most words and letters of a cell as planned, most cells of all lengths, words of a leaf, and
#: about how many words of a length its upper tree is fitted on.
CELL_WORDS, CELL_LETTERS, MOST_CELLS, LEAF_WORDS, SAMPLE = 4096, 1 << 22, 1 << 16, 8, 20_000
_COUNT_MOST = 100  # counts beyond are taken as this: what is in reach stays in reach
_DIMS = 26 + 64
_CODE = np.full(256, 255, np.uint8)
_CODE[ord("a") : ord("z") + 1] = np.arange(26)
_CODE[0xC0:] = np.arange(26, _DIMS)
_BY_STEPS = 64  # longer runs have their checksum taken one by one
_BREAK = re.compile(rb"(?<=[\x00-\x40\x5b-\x60\x7b-\x7f])")


# --- words and their counts -----------------------------------------------------------


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_CRC = _crc_table()


def checksums(runs: pa.StringArray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each run, continued from a checksum begun; a step for each byte of all runs."""
    offsets = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1]
    data = np.frombuffer(runs.buffers()[2] or b"", np.uint8)
    sizes, out = np.diff(offsets), np.empty(len(runs), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    long = int((sizes > _BY_STEPS).sum())
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[offsets[i] : offsets[i + 1]], int(begun[i]))
    order = order[long:]
    state, starts = ~begun[order].astype(np.uint32), offsets[:-1][order]
    for k in range(int(sizes[order].max(initial=0))):
        on = int(np.searchsorted(-sizes[order], -k))  # the longer ones stand first
        state[:on] = _CRC[(state[:on] ^ data[starts[:on] + k]) & 255] ^ (state[:on] >> 8)
    out[order] = ~state
    return out


def damaged(run: str, checksum: int) -> str:
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


def _slices(text: pa.StringScalar) -> Iterator[str]:
    """A text in slices of bounded size, cut where no run goes on; a longer run stays whole."""
    raw, at = text.as_buffer(), 0
    data = raw.to_pybytes()
    while at < len(data):
        end = at + (1 << 22)
        if end < len(data):
            found = _BREAK.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].decode("utf-8", "surrogatepass")
        at = end


def _counts(damage: int, least_letters: int):
    """(word, n) of batches of (doc_id as text, text), summed for each batch."""

    def of(ids: list[str], texts: pa.StringArray) -> tuple[pa.Array, pa.Array]:
        split = pc.split_pattern_regex(pc.ascii_lower(texts), f"[^{LETTERS}]+")
        runs, owner = split.flatten(), pc.list_parent_indices(split)
        some = pc.greater(pc.binary_length(runs), 0)
        runs, owner = runs.filter(some), owner.filter(some).to_numpy()
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        sums = checksums(runs, prefix[owner])
        hit = np.zeros(len(runs), bool) if not damage else sums % np.uint32(damage) == 0
        changed = Counter(map(damaged, runs.filter(pa.array(hit)).to_pylist(), sums[hit].tolist()))
        counted = runs.filter(pa.array(~hit)).value_counts()
        words = pa.concat_arrays([counted.field("values"), pa.array([*changed], pa.string())])
        times = pa.concat_arrays([counted.field("counts"), pa.array([*changed.values()], pa.int64())])
        enough = pc.greater_equal(pc.utf8_length(words), least_letters)
        return words.filter(enough), times.filter(enough)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            sizes = pc.binary_length(texts).to_numpy()
            short = np.flatnonzero(sizes <= 1 << 22)
            groups = [([ids[i] for i in short], texts.take(pa.array(short)))]
            long = ((ids[i], s) for i in np.flatnonzero(sizes > 1 << 22).tolist() for s in _slices(texts[i]))
            for own_ids, own in (*groups, *(([i], pa.array([s])) for i, s in long)):
                if len(own):
                    yield pa.RecordBatch.from_arrays([*of(own_ids, own)], ["word", "n"])

    return run


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGED, least_letters: int = LEAST_LETTERS
) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, with their numbers. Where
    damage divides the checksum of id and run, the run loses a letter; 0 leaves runs as they are."""
    bounded_batches(docs.sparkSession)
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.filter(F.col(text_col).isNotNull()).select(own.alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(lean(_counts(damage, least_letters)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# --- k-d trees ------------------------------------------------------------------------


def letters_of(words: list[str]) -> np.ndarray:
    """(words, length) codes of the letters of words of one length."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return _CODE[raw].reshape(len(words), -1)


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """(words, _DIMS) counts of the letters."""
    n, length = codes.shape
    places = codes.astype(np.int64) + np.arange(n, dtype=np.int64)[:, None] * _DIMS
    counts = np.bincount(places.ravel(), minlength=n * _DIMS).reshape(n, _DIMS)
    return np.minimum(counts, _COUNT_MOST).astype(np.int8)


def fit_tree(vectors: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters and counts of the splits of a complete binary tree, in heap order. A node takes
    the split that halves its vectors best; one whose vectors are alike sends all to the left."""
    dims, most = np.zeros((1 << depth) - 1, np.int16), np.full((1 << depth) - 1, 127, np.int8)
    held = {0: np.arange(len(vectors))}
    for node in range(len(dims)):
        own = held.pop(node, np.empty(0, np.int64))
        if len(own) > 1:
            part, best = vectors[own], 0
            for t in range(int(part.max(initial=0))):
                above = (part > t).sum(axis=0)
                even = np.minimum(above, len(own) - above)
                d = int(even.argmax())
                if even[d] > best:
                    best, dims[node], most[node] = int(even[d]), d, t
        right = vectors[own, dims[node]] > most[node]
        held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return dims, most


def in_reach(vectors: np.ndarray, tree: tuple[np.ndarray, np.ndarray], up: bool, down: bool) -> tuple[np.ndarray, np.ndarray]:
    """(vector, leaf) pairs: leaves whose box holds a point that is at most one step up (if up)
    and one step down (if down) from the vector. Without both it is the leaf of the vector."""
    dims, most = tree
    q, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    raised, lowered = np.full(len(vectors), -1, np.int16), np.full(len(vectors), -1, np.int16)
    for _ in range((len(dims) + 1).bit_length() - 1):
        d, t = dims[node], most[node].astype(np.int16)
        c = vectors[q, d] + (raised == d) - (lowered == d)
        right = c > t
        over = np.flatnonzero(~right & (c == t) & (raised < 0) & (lowered != d)) if up else np.empty(0, np.int64)
        under = np.flatnonzero(right & (c == t + 1) & (lowered < 0) & (raised != d)) if down else np.empty(0, np.int64)
        q = np.concatenate([q, q[over], q[under]])
        raised, lowered = np.concatenate([raised, d[over], raised[under]]), np.concatenate([lowered, lowered[over], d[under]])
        node = np.concatenate([2 * node + 1 + right, 2 * node[over] + 2, 2 * node[under] + 1])
    return q, node - len(dims)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters of a and b differ by one replaced letter, or, where b's words are
    one longer, by one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


class Cell:
    """The words of one length and box, under a tree of their own."""

    def __init__(self, words: list[str], times: list[int]):
        self.codes = letters_of(words)
        vectors = vectors_of(self.codes)
        self.tree = fit_tree(vectors, max(0, (len(words) - 1) // LEAF_WORDS).bit_length())
        leaf = in_reach(vectors, self.tree, False, False)[1]
        order = np.argsort(leaf, kind="stable")
        self.codes, self.words, self.times = self.codes[order], [words[i] for i in order], np.array(times, np.int64)[order]
        self.starts = np.searchsorted(leaf[order], np.arange(len(self.tree[0]) + 2))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, place in the cell) pairs of words, of one length, one edit apart."""
        asked, found = letters_of(words), []
        same = asked.shape[1] == self.codes.shape[1]
        q, leaf = in_reach(vectors_of(asked), self.tree, True, same)
        first, count = self.starts[leaf], self.starts[leaf + 1] - self.starts[leaf]
        step = max(1, CELL_LETTERS // asked.shape[1])
        ends = np.cumsum(count)
        for low in range(0, int(ends[-1]) if len(ends) else 0, step):
            nth = np.arange(low, min(low + step, int(ends[-1])))
            of = np.searchsorted(ends, nth, side="right")
            place, who = first[of] + nth - (ends[of] - count[of]), q[of]
            hit = one_edit(asked[who], self.codes[place])
            found.append((who[hit], place[hit]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _depth(words: int, length: int, scale: float) -> int:
    """Levels of the upper tree of a length, so that cells hold CELL_WORDS words, or fewer long
    ones; with more words than MOST_CELLS such cells hold, cells are larger."""
    cell = max(1.0, min(CELL_WORDS, CELL_LETTERS / length) * scale)
    return max(0, int(np.ceil(np.log2(max(1.0, words / cell)))))


def _fit(depths: dict[int, int]):
    def run(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        length = int(key[0])
        dims, most = fit_tree(vectors_of(letters_of(sample["word"].tolist())), depths[length])
        return pd.DataFrame({"length": [length], "dims": [dims.tobytes()], "most": [most.tobytes()]})

    return run


def upper_trees(words: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The tree of each length of words (word, n, length). Only lengths with more words than a
    cell holds have splits, fitted on SAMPLE of their words, more or less, chosen by hash."""
    counts = {r.length: r.n for r in words.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    cells = sum(n / max(1, min(CELL_WORDS, CELL_LETTERS / k)) for k, n in counts.items())
    depths = {k: _depth(n, k, max(1.0, cells / MOST_CELLS)) for k, n in counts.items()}
    trees = {k: (np.empty(0, np.int16), np.empty(0, np.int8)) for k in counts}
    split = {k: min(1.0, SAMPLE / counts[k]) for k, d in depths.items() if d}
    if split:
        share = F.create_map(*(F.lit(x) for k, v in split.items() for x in (k, int(v * (1 << 30)))))
        chosen = words.filter(F.col("length").isin([*split])).filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share[F.col("length")])
        fitted = chosen.select("length", "word").groupBy("length").applyInPandas(_fit(depths), "length int, dims binary, most binary")
        for r in fitted.collect():  # MOST_CELLS splits, more or less
            trees[r.length] = np.frombuffer(r.dims, np.int16), np.frombuffer(r.most, np.int8)
        for k in split:  # no word was chosen: all go to the left
            if not len(trees[k][0]):
                trees[k] = fit_tree(np.zeros((0, _DIMS), np.int8), depths[k])
    return trees


def _route(trees: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Words to cells: to their own as members, and as askers to those in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == length))
                words = own.column("word").to_pylist()
                step = max(1, CELL_LETTERS // max(length, _DIMS))
                for at in range(0, len(words), step):
                    part = own.slice(at, step)
                    vectors = vectors_of(letters_of(words[at : at + step]))
                    for asks, among, up, down in ((False, length, False, False), (True, length, True, True), (True, length + 1, True, False)):
                        if among in trees:
                            q, leaf = in_reach(vectors, trees[among], up, down)
                            rows = part.take(pa.array(q))
                            cell = pa.array((np.int64(among) << 32) + leaf, pa.int64())
                            columns = [cell, pa.array(np.full(len(q), asks)), rows.column("word"), rows.column("n")]
                            yield pa.RecordBatch.from_arrays(columns, ["cell", "asks", "word", "n"])

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows sorted by cell, members before those who ask: only the members of one
    cell are held. A pair of two lengths is found once, and given in both directions."""
    now, members, times, cell = None, [], [], None
    for batch in batches:
        cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
            if start == end:
                continue
            if cells[start] != now:
                now, members, times, cell = cells[start], [], [], None
            if not asks[start]:
                members += words[start:end]
                times += n[start:end]
                continue
            if not members:
                continue
            cell = cell or Cell(members, times)
            by_length: dict[int, list[int]] = {}
            for i in range(start, end):
                by_length.setdefault(len(words[i]), []).append(i)
            for length, own in by_length.items():
                step = max(1, min(2048, CELL_LETTERS // max(length, _DIMS)))
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    who, place = cell.near([words[i] for i in part])
                    a, b = [part[i] for i in who.tolist()], place.tolist()
                    left, left_n = [words[i] for i in a], [n[i] for i in a]
                    right, right_n = [cell.words[i] for i in b], cell.times[b].tolist() if b else []
                    if length != cell.codes.shape[1]:
                        left, right = left + right, right + left
                        left_n, right_n = left_n + right_n, right_n + left_n
                    columns = [pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(right_n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs of words (word, n), distinct, one edit apart, in both
    directions. Words have letters a-z and U+00C0 to U+00FF only."""
    rows = words.select("word", "n", F.char_length("word").alias("length")).filter("length > 0")
    trees = upper_trees(rows)
    dealt = rows.mapInArrow(lean(_route(trees)), "cell long, asks boolean, word string, n long")
    # about as many rows a partition as the words of a length have reach
    return dealt.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(lean(_search), "word string, near string, near_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that follows from each word. Each round
    doubles the steps taken, and a form is FORM_TIMES as frequent, so a few rounds are enough."""
    steps, _ = save(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("at"), F.col("root").alias("onward"))
        moved = steps.select("word", "root").join(onward, F.col("root") == F.col("at"), "left")
        moved = moved.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        steps, _ = save(moved, "roots")
        if not steps.filter("moved").limit(1).count():
            return steps.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    damage: int = DAMAGED,
    least_letters: int = LEAST_LETTERS,
    least_times: int = LEAST_TIMES,
    form_times: int = FORM_TIMES,
) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are the distinct runs of letters of at least least_letters letters and least_times
    occurrences (see count_words). A word's form is its most frequent near word, if that is
    form_times as frequent, the first in code-point order among equals; its root is the last of
    its forms. A null text has no words, a null id counts as the empty string, repeated rows
    count each; runs of any length are words; no words give an empty result; other columns are
    not read.
    """
    words, _ = save(count_words(docs, id_col, text_col, damage, least_letters).filter(F.col("n") >= least_times), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    formed = F.when(-F.col("best.less") >= form_times * F.col("n"), F.col("best.near"))
    known = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        formed.alias("form"),
        F.when(formed.isNotNull(), -F.col("best.less")).alias("form_n"),
    )
    known, _ = save(known, "near-words")
    found = known.join(roots_of(known.filter("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SPELLING_SQL = (
    r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS entries
  FROM (SELECT unnest(range(256)) AS b)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
-- the bytes of a letter beyond a-z are C3 and its code point less 64
bytes AS (
  SELECT run, times, coalesce(doc_id::VARCHAR, '') || ':' AS head,
         list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda c: ascii(c)::BIGINT) AS head_bytes,
         flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c) - 64] END)) AS run_bytes
  FROM runs),
hashed AS (
  SELECT run, times,
         xor(4294967295, list_reduce([4294967295] || head_bytes || run_bytes, lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1]))) AS h
  FROM bytes CROSS JOIN crc_table),
words AS (
  SELECT word, sum(times)::BIGINT AS n, translate(word, '"""
    + "".join(map(chr, range(0xC0, 0x100)))
    + r"""', '"""
    + "".join(map(chr, range(0x21, 0x61))).replace("'", "''")
    + r"""') AS plain
  FROM (SELECT times, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
-- two near words share the rest of one of them without a letter, or with one at its place
gaps AS (
  SELECT word, n, plain, left(plain, i - 1) || chr(1) || substr(plain, i + 1) AS hole, left(plain, i - 1) || substr(plain, i + 1) AS rest
  FROM (SELECT *, unnest(range(1, length(plain) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.hole = b.hole AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.plain
  UNION
  SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.plain),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near COLLATE "binary") AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
followed AS (
  SELECT word, word AS root, 0 AS steps FROM known
  UNION ALL
  SELECT f.word, k.form, steps + 1 FROM followed f JOIN known k ON f.root = k.word WHERE k.form IS NOT NULL)
SELECT k.word, form, r.root, n, n_near, form_n
FROM known k JOIN (SELECT word, arg_max(root, steps) AS root FROM followed GROUP BY word) r USING (word)
"""
)
