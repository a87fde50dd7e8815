"""Operator 4: severity of toxic language by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector w for all thresholds t_k. x has,
for each word and each character n-gram of words in the vocabulary, 1 + log of how often
it occurs; the vocabulary is sparse, namely the features whose log-odds stand out most,
and soft thresholding drops more of them. The labels mark toxic documents only; ordered
grades follow from how strongly a toxic document carries the features of toxic ones: 0
not toxic, then 1, 2 and 3 for the thirds of the toxic documents by that sum.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.labelled import training_rows, unlike_rows

#: Labelled documents of each class that the model is fitted on, at most.
ROWS_PER_LABEL = 1000
#: Lengths of n-grams; features in fewer training documents are left out; the vocabulary
#: holds the MOST_FEATURES whose log-odds are the most standard errors from 0, at least MARK_Z.
NGRAMS, LEAST_DOCUMENTS, MOST_FEATURES, MARK_Z = (3, 4, 5), 5, 600, 4.0
STEPS, RATE, SPARSITY, GRADES = 300, 0.3, 0.0005, 4
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter:
    """Lower-cased words and how often each occurs."""
    return Counter(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    """The n-grams of the word between marks, each as often as it occurs, and that itself
    where it is longer than all n-grams."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return grams + [marked] * (len(marked) > max(NGRAMS))


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray  # ascending, one less than the grades

    def __post_init__(self) -> None:
        self.finder = None

    def counts(self, text: str | None) -> Counter:
        """How often each feature with a weight occurs: all are found in one pass."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for feature in self.weights:
                self.finder.add_word(feature, feature)
            self.finder.make_automaton()
        words = _WORD.findall((text or "").lower())
        if not words or not self.weights:
            return Counter()
        return Counter(f for _, f in self.finder.iter(f"<{'><'.join(words)}>"))

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        x = math.fsum(self.weights[f] * (1 + math.log(n)) for f, n in self.counts(text).items())
        return 1 / (1 + np.exp(-np.clip(x - self.thresholds, -40, 40)))


def design(counts: list[Counter], names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, 1 + log of the count) of all features; names grows as needed."""
    ids_of: dict[str, np.ndarray] = {}
    doc, col, val = [], [], []
    for d, one in enumerate(counts):
        for word in sorted(one.keys() - ids_of.keys()):
            ids_of[word] = np.array([names.setdefault(f, len(names)) for f in word_features(word)])
        if one:
            ids = np.concatenate([ids_of[w] for w in one])
            times = np.repeat(list(one.values()), [len(ids_of[w]) for w in one])
            used, place = np.unique(ids, return_inverse=True)
            doc.append(np.full(len(used), d))
            col.append(used)
            val.append(1 + np.log(np.bincount(place, times)))
    none = [np.empty(0, np.int64)]
    return np.concatenate(doc or none), np.concatenate(col or none), np.concatenate(val or none)


def log_odds(doc: np.ndarray, col: np.ndarray, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """For each feature the log-odds that a document with it is toxic against one without,
    in standard errors; 0 for features in too few documents."""
    a = np.bincount(col[toxic[doc]], minlength=n_features)
    b = np.bincount(col[~toxic[doc]], minlength=n_features)
    n1, n0 = toxic.sum(), (~toxic).sum()
    logit = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
    return np.where(a + b >= LEAST_DOCUMENTS, logit / error, 0.0)


def fit(counts: list[Counter], labels: list[int]) -> Model:
    """Proximal gradient descent on the likelihood of the grades, over the features whose
    log-odds stand out. Without a toxic document every text gets grade 0."""
    toxic = np.array(labels, dtype=np.int64) == 1
    if not toxic.any():
        return Model({}, np.full(GRADES - 1, 40.0))
    names: dict[str, int] = {}
    doc, col, val = design(counts, names)
    odds = log_odds(doc, col, toxic, len(names))
    chosen = np.argsort(-np.abs(odds), kind="stable")[:MOST_FEATURES]
    chosen = np.sort(chosen[np.abs(odds[chosen]) >= MARK_Z])
    place_of = np.full(len(names), -1)
    place_of[chosen] = np.arange(len(chosen))
    keep = place_of[col] >= 0
    doc, col, val = doc[keep], place_of[col[keep]], val[keep]
    n, w = len(counts), np.zeros(len(chosen))
    strength = np.bincount(doc, val * np.maximum(odds[chosen], 0)[col], n)
    thirds = np.quantile(strength[toxic], (1 / 3, 2 / 3))
    grades = np.where(toxic, 1 + np.searchsorted(thirds, strength, "right"), 0)
    # thresholds as the lowest one and the logarithms of the gaps, so that they stay in order
    share = np.array([(np.mean(grades > k) * n + 0.5) / (n + 1) for k in range(GRADES - 1)])
    first = np.log((1 - share) / share)
    place = np.r_[first[0], np.log(np.maximum(np.diff(first), 0.05))]
    squares, place_squares = np.full(len(w), 1e-8), np.full(len(place), 1e-8)
    each = np.arange(n)
    for _ in range(STEPS):
        t = place[0] + np.r_[0, np.cumsum(np.exp(place[1:]))]
        x = np.bincount(doc, val * w[col], n) if len(doc) else np.zeros(n)
        over = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -40, 40)))
        cell = np.c_[np.ones(n), over][each, grades] - np.c_[over, np.zeros(n)][each, grades]
        slope = np.c_[np.zeros(n), over * (1 - over), np.zeros(n)]
        cell = np.maximum(cell, 1e-6)
        low, high = slope[each, grades] / cell, slope[each, grades + 1] / cell
        gradient = np.bincount(col, val * (high - low)[doc], len(w)) / n if len(doc) else np.zeros(0)
        squares += gradient**2
        rate = RATE / np.sqrt(squares)
        w -= rate * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SPARSITY, 0)
        of_t = np.array([low[grades == k + 1].sum() - high[grades == k].sum() for k in range(GRADES - 1)]) / n
        gradient = np.r_[of_t.sum(), np.exp(place[1:]) * np.cumsum(of_t[::-1])[::-1][1:]]
        place_squares += gradient**2
        place = place - RATE * gradient / np.sqrt(place_squares)
        place[1:] = np.clip(place[1:], -3, 3)
    t = place[0] + np.r_[0, np.cumsum(np.exp(place[1:]))]
    listed = list(names)
    return Model({listed[c]: float(x) for c, x in zip(chosen, w, strict=True) if x}, t)


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Model:
    """Fit on labels.toxic of at most rows_per_label documents of each class, less near
    copies among them. The driver gets their distinct words and counts. Null texts count as
    empty; without labelled documents every text gets grade 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [word_counts(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "label": batch["label"],
                    "words": [list(c.keys()) for c in found],
                    "counts": [list(c.values()) for c in found],
                }
            )

    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", rows_per_label)
    got = rows.mapInPandas(count, "doc_id long, label int, words array<string>, counts array<int>").toArrow().to_pandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    counts = [Counter(dict(zip(w, c.tolist(), strict=True))) for w, c in zip(got["words"], got["counts"], strict=True)]
    kept = unlike_rows([list(c) for c in counts])
    return fit([counts[i] for i in kept], got["label"].iloc[kept].tolist())


def grade_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, toxic (1 if a grade above 0 is likelier than
    not), severity (expected grade, 0 to 3), grade (most likely), p_toxic.

    A null text counts as empty, a null id stays null, repeated rows are graded alike; an
    empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            over = np.array([model.exceed(t) for t in batch["text"]]).reshape(-1, GRADES - 1)
            cells = np.c_[np.ones(len(over)), over] - np.c_[over, np.zeros(len(over))]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "toxic": (over[:, 0] >= 0.5).astype(int),
                    "severity": over.sum(axis=1),
                    "grade": cells.argmax(axis=1),
                    "p_toxic": over[:, 0],
                }
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, toxic int, severity double, grade int, p_toxic double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades of all docs by a model fitted on the labelled ones: a row for each row of docs.
    The grades it learns from are thirds of the toxic documents by a sum of the same features
    that are then fitted, so severity orders documents as p_toxic does. Null and wordless texts
    have no features; null ids have no label; repeated rows grade alike; an empty table gives
    an empty result; other columns are not read."""
    return grade_documents(docs, train(docs, labels))
