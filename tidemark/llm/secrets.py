"""Operator 2: secrets in texts, with the guess cost of values in credential contexts.

Base spans are found by three patterns. Values that follow a credential word and a
separator are then priced as passwords: dynamic programming finds the cheapest split into
words, dates, repeats, keyboard walks and brute-force characters, where a segment costs
the decimal logarithm of the guesses it takes. A value that costs at least MIN_COST and
lies in no assign span gives a span of the kind "guess".
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, drop, lean, quoted, save

#: Decimal logarithm of the guesses from which a value counts as a secret.
MIN_COST = 8.0
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Tells bytes that may be in a hex run, so that runs are sought only where there are long ones.
_HEX_BYTES = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
#: What every credential word has one of.
_HINTS = ("pass", "pwd", "pin", "secret", "token", "bearer", "credential", "auth", "key")
# a credential word, a separator or "is", perhaps the scheme of an authorisation, and a value
# up to white space or a quote
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code|key)?|pwd|pin|secret|token|bearer|credentials?|auth(?:orization)?"""
    r"""|(?:api|access|private|secret|signing|encryption)[_-]?key)["']?[\x20\t]*(?:[:=]>?|\bis\b)[\x20\t]*"""
    r"""["']?(?:(?:bearer|basic|digest|token)[\x20\t]+)?["']?([^\s"'<>]{6,})""",
    re.I | re.A,
)
# ---- fixed values: words that guessers try first, in the order they are tried, and words
# that stand after credential words in prose
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess sunshine football"
    " baseball shadow superman michael jordan hunter ranger buster soccer hockey killer george charlie"
    " andrew michelle love jessica pepper daniel access thunder summer winter spring autumn ginger joshua"
    " cheese amanda computer secret test guest root user changeme default hello world freedom whatever"
    " trustno batman starwars cookie flower orange banana apple silver golden purple yellow matrix internet"
    " server database system public private token key company office january february march april june july"
    " august september october november december monday tuesday wednesday thursday friday saturday sunday"
    " the and not that this with from have been will must should never always required available invalid"
    " expired missing wrong needed optional something nothing everything anything valid correct incorrect"
    " empty unknown unset none null true false your their same here there only also used stored changed"
    " rotated revoked generated disabled enabled authentication authorization credentials username"
).split()
#: Rows of keys along which fingers walk, and the alphabet.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: Letters that stand for others in words.
LEET = str.maketrans("4@3105$7!", "aaelosstl")
# ---- end of fixed values
#: Words of a corpus that join the dictionary, at most, as it is sent to every task; their
#: letters; and how often they stand in prose, at least, and for each time in a context.
MOST_WORDS, WORD_LETTERS, LEAST_TIMES, PROSE_TIMES = 50_000, (3, 64), 2, 5
#: Units of repeats have so many characters at most: longer ones cost more than MIN_COST
#: themselves, a digit a tenfold, so that no such repeat makes a value cheap.
LONGEST_UNIT = 8
_DATE = re.compile(
    r"(?=((?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d))"
)
_STEP = {pair for row in WALKS for pair in zip(row, row[1:])} | {pair for row in WALKS for pair in zip(row[1:], row)}
#: Added for each segment, so that many short ones are not free.
_JOIN = 0.3


def _brute(c: str) -> float:
    """Cost of one character of brute force: the logarithm of its class's size."""
    if c.isdigit():
        return 1.0
    return math.log10(26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def _runs(on: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of true places."""
    edges = np.flatnonzero(np.diff(np.r_[False, on, False]))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


class Guesser:
    """Prices values as passwords, with a ranked dictionary: WORDS, then the words given.

    Time grows with the length of a value, and with the runs and words found in it.
    """

    def __init__(self, words: Sequence[str] = ()) -> None:
        rank = {w: n for n, w in enumerate(dict.fromkeys([*WORDS, *words]), 2)}
        self.finder = ahocorasick.Automaton()
        for word, n in rank.items():
            self.finder.add_word(word, (len(word), math.log10(n)))
        self.finder.make_automaton()

    def segments_ending(self, value: str) -> list[Sequence[tuple[int, float, str]]]:
        """For each end, the (start, cost, kind) of segments other than brute force.

        Repeats and walks run from the start of their run; dates and words from anywhere.
        """
        n = len(value)
        # one character for one, so that places agree
        low = "".join([c.lower() if len(c.lower()) == 1 else c for c in value])
        out: list = [()] * (n + 1)

        def add(end: int, start: int, cost: float, kind: str) -> None:
            if not out[end]:
                out[end] = []
            out[end].append((start, cost, kind))

        for m in _DATE.finditer(value):
            years = 2.0  # a century of years, and the days of a year
            add(m.end(1), m.start(1), years + (math.log10(366) if len(m[1]) > 4 else 0), "date")
        plain = low.translate(LEET)
        for text, leet in ((low, 0.0), (plain, 0.6))[: 1 + (plain != low)]:
            for last, (size, cost) in self.finder.iter(text):
                start = last + 1 - size
                if leet and low[start : last + 1] == text[start : last + 1]:
                    continue
                cased = 0.0 if value[start : last + 1] == low[start : last + 1] else 0.6
                add(last + 1, start, cost + cased + leet, "word")
        codes = np.array([ord(c) for c in value], np.uint32)
        for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
            for first, end in _runs(codes[unit:] == codes[:-unit]):
                part = value[first : first + unit]
                if any(unit % d == 0 and part == part[:d] * (unit // d) for d in range(1, unit)):
                    continue  # a repeat of a shorter unit
                size = sum(map(_brute, part))
                for last in range(first + 2 * unit + (unit == 1), end + unit + 1):
                    add(last, first, size + math.log10((last - first) / unit), "repeat")
        steps = np.fromiter((pair in _STEP for pair in zip(low, low[1:])), bool, max(0, n - 1))
        for first, end in _runs(steps):
            for last in range(first + 3, end + 2):
                add(last, first, math.log10(47) + math.log10(2 * (last - first)), "walk")
        return out

    def cost(self, value: str) -> float:
        """Least cost of any segmentation; brute-force characters next to each other are one
        segment."""
        ends, n = self.segments_ending(value), len(value)
        best = [0.0] + [math.inf] * n  # of all splits of a prefix
        brute = math.inf  # of those that end in a brute-force segment
        price = {c: _brute(c) for c in set(value)}
        for end in range(1, n + 1):
            brute = min(best[end - 1] + _JOIN, brute) + price[value[end - 1]]
            least = brute
            for s, c, _ in ends[end]:
                least = min(least, best[s] + c + _JOIN)
            best[end] = least
        return best[n]


_guessers: dict[int, Guesser] = {}


def _guesser(words: Sequence[str] = ()) -> Guesser:
    """The guesser of some words; a worker keeps the last one."""
    key = hash(tuple(words))
    if key not in _guessers:
        _guessers.clear()
        _guessers[key] = Guesser(words)
    return _guessers[key]


def segments_ending(value: str) -> list[Sequence[tuple[int, float, str]]]:
    return _guesser().segments_ending(value)


def guess_cost(value: str) -> float:
    return _guesser().cost(value)


def contexts(text: str) -> Iterator[re.Match]:
    """Values in credential contexts, from left to right. The search goes on behind the first
    character of each, so that a credential word which is itself a value has its own value."""
    m = _CONTEXT.search(text)
    while m:
        yield m
        m = _CONTEXT.search(text, m.start(1))


_COUNTED = "word string, n long, in_context long, h_least long, h_most long, s_least long, s_most long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of batches of texts: how often in prose and in contexts, and the least and the
    greatest hash of the texts and of the sources that have them in prose."""
    names = [c.split()[0] for c in _COUNTED.split(", ")]

    def words_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        split = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
        words, owner = split.flatten(), pc.list_parent_indices(split)
        fit = pc.and_(pc.greater_equal(pc.utf8_length(words), WORD_LETTERS[0]), pc.less_equal(pc.utf8_length(words), WORD_LETTERS[1]))
        return words.filter(fit), owner.filter(fit)

    for batch in batches:
        texts, values = [], []
        for text in batch.column("text").to_pylist():
            low = text.lower()
            if any(h in low for h in _HINTS):
                values += [m[1] for m in contexts(text)]
                text = _CONTEXT.sub(" ", text)
            texts.append(text)
        words, owner = words_of(pa.array(texts, pa.string()))
        table = pa.table({"word": words, "h": batch.column("h").take(owner), "s": batch.column("s").take(owner)})
        prose = table.group_by("word").aggregate([([], "count_all"), ("h", "min"), ("h", "max"), ("s", "min"), ("s", "max")])
        zero = pa.array(np.zeros(len(prose), np.int64))
        columns = [prose[c].combine_chunks() for c in ("word", "count_all", "h_min", "h_max", "s_min", "s_max")]
        yield pa.RecordBatch.from_arrays([columns[0], columns[1], zero, *columns[2:]], names)
        counts = words_of(pa.array(values, pa.string()))[0].value_counts()
        if len(counts):
            none = pa.nulls(len(counts), pa.int64())
            zero = pa.array(np.zeros(len(counts), np.int64))
            yield pa.RecordBatch.from_arrays([counts.field("values"), zero, counts.field("counts"), none, none, none, none], names)


def common_words(docs: DataFrame, text_col: str = "text", source_col: str = "source", most: int = MOST_WORDS) -> list[str]:
    """The most frequent words of all texts, lower-cased, most frequent first: a dictionary
    for guessing. So what is found in a text depends on the corpus that it is scanned with.

    A word stands LEAST_TIMES in prose, in two different texts and, where there are several
    sources, in two of them, so that copies of a text with a secret teach nothing; and
    PROSE_TIMES as often in prose as in credential contexts, so that a secret which is spoken
    of elsewhere is none. At most `most` words reach the driver: where counts of about one
    size would pass that, none with them or lower ones joins. Null texts have no words, a null
    source is a source; without source_col all texts have one.
    """
    bounded_batches(docs.sparkSession)
    source = F.xxhash64(F.col(source_col).cast("string")) if source_col in docs.columns else F.lit(0).cast("long")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h"), source.alias("s"))
    counted = rows.mapInArrow(lean(_counted), _COUNTED).groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("in_context").alias("in_context"), F.min("h_least").alias("h_least"), F.max("h_most").alias("h_most"),
        F.min("s_least").alias("s_least"), F.max("s_most").alias("s_most"),
    )
    words, path = save(counted.filter(F.col("n") >= LEAST_TIMES), "words")
    one_source = words.agg(F.min("s_least") == F.max("s_most")).first()[0]
    spread = (F.col("h_least") < F.col("h_most")) & (F.lit(bool(one_source)) | (F.col("s_least") < F.col("s_most")))
    fit = words.filter(spread & (F.col("n") >= PROSE_TIMES * F.col("in_context"))).select("word", "n")
    size = F.floor(64 * F.log2("n")).cast("int")  # some 4,000 sizes at most
    least, total = 1 << 30, 0
    for at, n in sorted(map(tuple, fit.groupBy(size.alias("size")).count().collect()), reverse=True):
        total += n
        if total > most:
            break
        least = at
    top = fit.filter(size >= least).collect()
    drop(docs.sparkSession, path)
    return [r.word for r in sorted(top, key=lambda r: (-r.n, r.word))]


def find_secrets(text: str, guesser: Guesser | None = None) -> tuple[list[tuple[int, int, str]], float]:
    """Spans (start, end, kind) by start, then kind as in KINDS; and the highest cost of a
    value in a credential context (0 without any)."""
    guess_cost = (guesser or _guesser()).cost
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    assign = [(m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if hinted else []
    spans = [(s, e, "assign") for s, e, _ in assign]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    most = max((guess_cost(v) for _, _, v in assign), default=0.0)
    covered = 0
    for m in contexts(text) if hinted else ():
        start, end = m.span(1)
        if start < covered:
            continue  # part of a value that is a secret as a whole
        cost = guess_cost(m[1])
        most = max(most, cost)
        if cost >= MIN_COST and not any(s < end and start < e for s, e, _ in assign):
            spans.append((start, end, "guess"))
        if cost >= MIN_COST:
            covered = end
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])), most


def _scan(words: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guesser = _guesser(words)
        for batch in batches:
            found = [find_secrets(t or "", guesser) for t in batch["text"]]
            said = [[f"{k}:{s}:{e}" for s, e, k in spans] for spans, _ in found]
            base = [[x for x in one if not x.startswith("guess")] for one in said]
            counts = {f"n_{k}": [sum(x[2] == k for x in spans) for spans, _ in found] for k in KINDS}
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    **counts,
                    "base_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in base],
                    "spans": [",".join(x) for x in said],
                    "max_guess_log10": [cost for _, cost in found],
                }
            )

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, n_guess,
    base_sha256, spans, max_guess_log10. Positions are code points, ends exclusive. words:
    ranked words besides WORDS that guessers know, as from common_words.

    A null text counts as empty and has no span; a null id stays null; repeated rows give
    a row each; with words from a corpus the guess spans depend on that corpus; an empty table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInPandas(_scan(words), f"doc_id long, {counts}, base_sha256 string, spans string, max_guess_log10 double")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", words: Sequence[str] = ()) -> DataFrame:
    """docs with every secret span of the text replaced by mark; null texts stay null, other
    columns and repeated rows as they are; an empty table stays empty."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for start, end, _ in find_secrets(text, _guesser(words))[0]:
                if end > at:
                    out += [text[at : max(at, start)], mark if start >= at else ""]
                    at = end
            return "".join(out) + text[at:]

        return texts.map(one)

    return docs.withColumn(text_col, redact(F.col(quoted(text_col))))
