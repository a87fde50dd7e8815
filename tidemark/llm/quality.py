"""Operator 3: a quality classifier of supervised subword embeddings.

Features of a document are hashed words, hashed character n-grams of words, and a mark
for each word that repeats the one before. Each feature has a learned vector; the vectors
are averaged over the document, and a linear layer with softmax gives the class. The
model is fitted by numpy stochastic gradient descent on a bounded sample of labelled
documents. As the layer is linear, a word's features add the same amount to a document's
logit wherever it stands: scoring adds one number for each word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, lean
from tidemark.llm.labelled import not_held_out, training_rows

#: Labelled documents of each class that the model is fitted on, at most.
ROWS_PER_LABEL = 1200
BUCKETS, DIMENSIONS, NGRAM = 1 << 16, 8, 3
EPOCHS, BATCH, RATE, VECTOR_RATE, SEED = 8, 32, 0.6, 10, 7
#: Words that a worker remembers, and characters of one at most.
_MEMORY_WORDS, _MEMORY_CHARS = 120_000, 80
#: n-grams of a long word that are held at a time.
_SLICE = 1 << 14


def word_features(word: str) -> Iterator[list[int]]:
    """Buckets of a word, in slices: the word itself and all its n-grams between marks."""
    marked, own = f"<{word}>", [f"\0{word}"]
    for at in range(0, max(1, len(marked) - NGRAM + 1), _SLICE):
        end = min(at + _SLICE, len(marked) - NGRAM + 1)
        grams = own + [marked[i : i + NGRAM] for i in range(at, end)]
        yield [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]
        own = []


_REPEAT = zlib.crc32(b"\1same word again") % BUCKETS
#: A repeated word weighs about as much as the n-grams of a word.
_REPEAT_WEIGHT = 8


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, which sum to 1."""
    words = text.split()
    counts = np.zeros(BUCKETS)
    ids, times = [], []

    def add() -> None:
        nonlocal counts
        counts += np.bincount(np.array(ids, np.int64), np.array(times, np.float64), BUCKETS)
        ids.clear()
        times.clear()

    for word, n in Counter(words).items():
        for found in word_features(word):
            ids += found
            times += [n] * len(found)
            if len(ids) >= _SLICE:
                add()
    add()
    counts[_REPEAT] += _REPEAT_WEIGHT * sum(map(str.__eq__, words, words[1:]))
    used = np.flatnonzero(counts)
    return used, counts[used] / max(counts.sum(), 1)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: what it adds to the logit of class 1, times its share
    bias: float

    def __post_init__(self) -> None:
        self.memory: dict[str, float] = {}
        self.listed = self.weights.tolist()

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def word(self, word: str) -> float:
        """Sum of the weights of a word's features, of which there are len(word) + 1."""
        found = self.memory.get(word)
        if found is None:
            found = sum([sum(map(self.listed.__getitem__, at)) for at in word_features(word)])
            if len(self.memory) < _MEMORY_WORDS and len(word) <= _MEMORY_CHARS:
                self.memory[word] = found
        return found

    def score(self, text: str | None) -> float:
        """Probability of class 1; an empty text has that of the bias alone."""
        words = (text or "").split()
        logit = self.bias
        if words:
            again = _REPEAT_WEIGHT * sum(map(str.__eq__, words, words[1:]))
            size = sum(map(len, words)) + len(words)
            logit += (sum(map(self.word, words)) + again * self.listed[_REPEAT]) / (size + again)
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Model:
    """Stochastic gradient descent over mini-batches. A document moves each of its features
    by its share, so the vectors take VECTOR_RATE times the step of the layer.

    Without rows every score is 0.5; with one class only, the bias follows its share.
    """
    y = np.array(labels, dtype=np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = np.array([0.0, np.log(share / (1 - share))])
    if len(np.unique(y)) < 2:
        return Model(np.zeros(BUCKETS), float(bias[1]))
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer = np.zeros((DIMENSIONS, 2))
    steps, done = EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            rows = order[at : at + BATCH]
            batch = [features[r] for r in rows]
            mean = np.array([share @ table[ids] for ids, share in batch])
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            step = rate * VECTOR_RATE * p @ layer.T
            layer -= rate * mean.T @ p
            bias -= rate * p.sum(axis=0) / len(rows)
            for (ids, share), move in zip(batch, step, strict=True):
                table[ids] -= share[:, None] * move
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, condition=None) -> Model:
    """Fit on labels.quality of at most rows_per_label documents of each class.

    Features are counted on the executors; the driver gets bucket shares, whose size is
    bounded by the rows and BUCKETS, not by the texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [document_features(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "label": batch["label"],
                    "ids": [f[0].astype(np.int32) for f in found],
                    "shares": [f[1].astype(np.float32) for f in found],
                }
            )

    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "quality", rows_per_label, condition)
    got = rows.mapInPandas(count, "doc_id long, label int, ids array<int>, shares array<float>").toArrow().to_pandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    features = [(np.asarray(i), np.asarray(s, dtype=np.float64)) for i, s in zip(got["ids"], got["shares"], strict=True)]
    return fit(features, got["label"].tolist())


def quality_score(text: Column, model: Model) -> Column:
    """Probability of label 1, as a double."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model.score, na_action=None).astype(float)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(scores)(batches)

    return score(text)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, score, predicted. Null texts count as empty, null
    ids stay null, repeated rows score alike; an empty table gives an empty result."""
    return docs.select(F.col(id_col), quality_score(F.col(text_col), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without those whose score is below 0.5. Null texts count as empty, repeated rows
    stay or go together, an empty table stays empty; all columns are kept."""
    return docs.filter(quality_score(F.col(f"`{text_col}`"), model) >= 0.5)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of a model that never saw held-out rows: a row for
    each row of docs. A null or wordless text has the score of the bias alone; a null id is not
    held out and has no label; repeated rows score alike; without labels all score 0.5 or
    more; an empty table gives an empty result; other columns are not read."""
    model = train(docs, labels, condition=not_held_out())
    held_out = F.coalesce(~not_held_out(), F.lit(False))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
