"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over sparse word features is shared by all ordered
thresholds. Features are the words of a text and the beginnings of longer ones, each 0 or 1. Weights are learned
with an L1 penalty by proximal steps, so that only words that speak for a grade keep one; scoring looks words up and
never needs the rest. Grades are those that the labels hold, in their order, and may be any number from two on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, as_bytes, small_batches, uniform

#: Texts of each grade that are learned from, and bytes of such a text, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 20_000
MAX_GRADES = 20
#: Bytes of a longer word's beginnings, which are features too: compounds share them.
PREFIXES = (4, 5)


def features(text: bytes | None) -> set[bytes]:
    words = set(text.translate(WORDS).split()) if text else set()
    for n in PREFIXES:
        words |= {w[:n] + b"*" for w in words if len(w) > n and w[-1:] != b"*"}
    return words


class Model:
    """Weights by word, ascending thresholds, and the grades they stand between."""

    def __init__(self, weights: dict[bytes, float], thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, np.asarray(thresholds, float), grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - np.asarray(score, float)[:, None], -500, 500)))
        edges = np.concatenate([np.zeros((len(below), 1)), below, np.ones((len(below), 1))], axis=1)
        return np.diff(edges, axis=1)

    def score(self, words: set[bytes]) -> float:
        return sum(sorted(map(self.weights.__getitem__, words & self.weights.keys())))

    def predict(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and likeliest grade of each text."""
        p = self.probabilities(np.array([self.score(features(t)) for t in texts], float).reshape(-1))
        g = np.array(self.grades, float)
        return p @ g, np.array(self.grades)[p.argmax(1)] if len(p) else np.empty(0, int)


def fit(texts: list[bytes | None], grades: list[int], penalty: float = 1e-3, rounds: int = 250, least_docs: int = 3) -> Model:
    """Learn from texts and grades, each grade weighing the same. One grade, or none, gives a model without weights."""
    known = sorted(set(grades))
    if len(known) < 2:
        return Model({}, np.empty(0), known or [0])
    sets = [features(t) for t in texts]
    seen = Counter(w for s in sets for w in s)
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least_docs))}
    row, col = [], []
    for i, s in enumerate(sets):
        for w in s:
            j = vocab.get(w)
            if j is not None:
                row.append(i)
                col.append(j)
    row, col = np.array(row, np.int64), np.array(col, np.int64)
    y = np.searchsorted(known, grades)
    k, n = len(known), len(y)
    share = np.bincount(y, minlength=k)
    weight = (1 / (k * share))[y]
    w, t = np.zeros(len(vocab)), np.log(np.arange(1, k) / (k - np.arange(1, k)))
    v, s, momentum = w.copy(), t.copy(), 1.0
    length = np.bincount(row, minlength=n).astype(float)
    step = 4.0 / max(float((weight * (length + 1)).sum()), 1e-9)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(rounds):
        z = np.bincount(row, v[col], n)
        edges = np.concatenate([[-np.inf], np.maximum.accumulate(s), [np.inf]])
        hi, lo = sigmoid(edges[y + 1] - z), sigmoid(edges[y] - z)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
        grad_w = np.bincount(col, (d_hi - d_lo)[row], len(vocab)) if len(row) else np.zeros(len(vocab))
        grad_t = np.array([d_lo[y == j + 1].sum() - d_hi[y == j].sum() for j in range(k - 1)])
        new_w = v - step * grad_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_t = np.maximum.accumulate(s - step * grad_t)
        up = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, s = new_w + (momentum - 1) / up * (new_w - w), new_t + (momentum - 1) / up * (new_t - t)
        w, t, momentum = new_w, new_t, up
    return Model({x: float(w[i]) for x, i in vocab.items() if w[i]}, t, [int(g) for g in known])


def smallest(rows: DataFrame, key: Column, grade: str = "grade", n: int = SAMPLE_ROWS, max_grades: int = MAX_GRADES) -> DataFrame:
    """Of each grade the ``n`` rows of the smallest random numbers of ``key``, found without a sort in one task.

    More than ``max_grades`` grades raise ValueError; null ones are left out.
    """
    rows = rows.where(F.col(grade).isNotNull())
    known = [r[0] for r in rows.select(grade).distinct().limit(max_grades + 1).collect()]
    if len(known) > max_grades:
        raise ValueError(f"more than {max_grades} grades")
    parts = [rows.where(F.col(grade) == g).orderBy(uniform(key, "toxicity"), key).limit(n) for g in sorted(known)]
    return reduce(DataFrame.union, parts) if parts else rows.limit(0)


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, max_grades: int = MAX_GRADES) -> Model:
    """Learn from a bounded sample of ``rows`` (text, grade int): ``sample_rows`` distinct texts of each grade at most, of
    at most ``sample_bytes`` bytes. Null texts and grades are left out; more than ``max_grades`` grades raise ValueError."""
    rows = rows.select(as_bytes().alias("text"), F.col("grade").cast("int").alias("grade")).where(F.col("text").isNotNull() & (F.octet_length("text") <= sample_bytes))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # at most sample_rows rows of each of max_grades grades
    chosen = F.broadcast(smallest(rows.select("grade", "h").distinct(), F.col("h"), n=sample_rows, max_grades=max_grades))
    got = rows.join(chosen, ["grade", "h"]).groupBy("grade", "h").agg(F.min("text").alias("text")).select("text", "grade")
    got = sorted((bytes(r[0]), r[1]) for r in got.toLocalIterator())
    return fit([t for t, _ in got], [g for _, g in got])


def severity(docs: DataFrame, model: Model, toxic_from: float | None = None) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) for each row of ``docs`` (doc_id, text); whole texts count.

    expected_severity is the mean grade under the model, grade the likeliest one, and toxic says that the severity
    is nearer to a higher grade than to the least (``toxic_from`` sets another mark). Null and empty texts have no
    features, so their severity is that of a score of 0; an empty table gives an empty result, and rows that repeat
    get one result each. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    low = model.grades[0]
    mark = toxic_from if toxic_from is not None else low + 0.5 * ((model.grades[1] if len(model.grades) > 1 else low + 1) - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean, grade = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean, pa.float64()), pa.array(grade, pa.int32()), pa.array(mean >= mark, pa.bool_())], ["doc_id", "expected_severity", "grade", "toxic"])

    return docs.select("doc_id", as_bytes()).mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean")
