"""Toxicity by logistic regression on hashed word n-grams and skip-grams, fitted with FTRL.

Features of a text are the presence of its words, of neighbouring pairs and of pairs with one
word between, hashed into a table of weights. FTRL-proximal keeps a learning rate for each
coordinate and sets weights to exactly zero until their gradients outgrow the L1 term. What is
broadcast for scoring is the list of weights that are left.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_sample
from .rows import append, bounded_batches, schema_of, without
from .shingles import mixed, word_hashes

#: Marks and spaces beyond ASCII; they become blanks before a text is taken as bytes.
_APART = re.compile(r"[^\w\x00-\x7F]+")
#: Bytes of words: letters, digits and all bytes of characters beyond ASCII.
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Places in the table of weights; the last one is the constant.
DIMENSIONS = 1 << 20
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None) -> np.ndarray:
    """Places of all features of a text, repeats included."""
    text = text.lower() if text else ""
    if not text.isascii():
        text = _APART.sub(" ", text)
    h = word_hashes(text.encode(), _IN_WORD)
    rolled = np.concatenate([h, h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + (h[2:] ^ _PAIR)])
    return (mixed(rolled) % np.uint64(DIMENSIONS - 1)).astype(np.int32)


class Ftrl:
    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        scale = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / scale)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        """``at`` holds each present feature once, the constant among them."""
        w = self.weights(at)
        g = (sigmoid(w.sum()) - label) * weight
        n = self.n[at]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - step * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable, rows: int = 20_000,
                 epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 10.0,
                 l2: float = 1.0, positive_weight: float = 4.0, label: str = "toxic", text: str = "text") -> dict[int, float]:
    """Weights other than zero by place, from at most ``rows`` labelled documents.

    The model is fitted in one task on that bounded sample, in the order of the ids' hashes, so
    runs agree. A toxic text counts ``positive_weight`` times. Without labelled rows there are no weights and every text scores one half.
    """
    sample = training_sample(docs, labels, label, usable, rows, text)

    def run(batches):
        seen = []
        for batch in bounded_batches(batches):
            for value, answer in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                present = np.unique(features(value))
                seen.append((np.append(present, DIMENSIONS - 1), answer))
        model = Ftrl(alpha, beta, l1, l2)
        for _ in range(epochs):
            for present, answer in seen:
                model.learn(present, answer, positive_weight if answer else 1.0)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"place": pa.array(at, pa.int32()), "weight": w[at]})

    fitted = (sample.repartition(1).sortWithinPartitions("order", "text")
              .mapInArrow(run, "place int, weight double").toArrow())
    return dict(zip(fitted["place"].to_pylist(), fitted["weight"].to_pylist()))


def score_toxicity(docs: DataFrame, weights: dict[int, float], threshold: float = 0.5,
                   text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    A null or empty text has the constant only. Each row is scored on its own and as a whole;
    repeated rows score alike. Columns of ``docs`` with the new names are replaced.
    """
    made = ["score", "predicted"]
    keep = without(docs, made)
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(
        (np.array(list(weights), np.int64), np.array(list(weights.values()), float)))

    def run(batches):
        table = np.zeros(DIMENSIONS)
        places, values = shared.value
        table[places] = values
        known = table != 0
        for batch in bounded_batches(batches):
            sums = []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                at = features(value)
                sums.append(table[np.unique(at[known[at]])].sum() + table[-1])
            score = sigmoid(np.array(sums))
            yield append(batch, keep, {
                "score": pa.array(score, pa.float64()),
                "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())})

    return source.mapInArrow(run, schema_of(source, keep, "score double, predicted int"))
