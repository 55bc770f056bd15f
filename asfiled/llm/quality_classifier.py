"""A quality score from preference pairs (Bradley and Terry), cut at a score quantile.

The probability that one text is preferred to another is the logistic function of the difference
of their scores, and a score is linear in the text's features. So the weights come from a
logistic regression without a constant on feature differences of pairs. The cut is the quantile
of the scores that separates the labels best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from ..operators.ranking import number_rows
from .labelled import usable_labels
from .quality_rules import Measures
from .rows import append, bounded_batches, schema_of, without

FEATURES = ("words", "symbols", "capitals", "exclamations", "bars", "repeated lines",
            "repeated phrases", "distinct words", "word length", "digits", "line length")


#: Partners that a labelled text is compared with at least, if there are so many.
PARTNERS = 4


def features(text: str | None) -> list[float]:
    m = Measures(text)
    n, chars, lines = max(m.n_words, 1), max(m.word_chars, 1), max(m.n_lines, 1)
    return [
        np.log1p(m.n_words) / 10, min(1, 4 * m.n_symbols / n), min(1, 4 * m.n_capitals / chars),
        min(1, 4 * m.n_exclamations / n), min(1, 4 * m.text.count("|") / n), m.n_dup_lines / lines,
        m.n_repeat_words / n, np.log((m.n_distinct_words + 1) / (n + 1)) / np.log(n + 2),
        min(1, abs(chars / n - 5.5) / 5), min(1, sum(map(m.text.count, "0123456789")) / chars),
        min(1, n / lines / 500)]


def feature_rows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the array ``features``."""
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)

    def run(batches):
        for batch in bounded_batches(batches):
            values = [features(v) for v in
                      batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield append(batch, keep, {"features": pa.array(values, pa.list_(pa.float64()))})

    return source.mapInArrow(run, schema_of(source, keep, "features array<double>"))


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int, seed: int, l2: float = 1e-3):
    """Weights by Newton steps on pairs of a preferred and another row, drawn by ``seed``."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
        gradient = d.T @ (1 - p) / pairs - l2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_quantile(scores: np.ndarray, label: np.ndarray, steps: int = 400) -> float:
    """The score quantile at which the two labels are told apart best, on average of both."""
    cuts = np.unique(np.quantile(scores, np.linspace(0, 1, steps + 1)))
    cuts = np.concatenate([(cuts[:-1] + cuts[1:]) / 2, cuts[:1]])
    good, bad = np.sort(scores[label == 1]), np.sort(scores[label == 0])
    if not len(good) or not len(bad):
        return float(cuts[-1])
    right = (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
    return float(np.median(cuts[right == right.max()]))


def labelled_features(docs: DataFrame, labels: DataFrame, usable, label: str,
                      text: str) -> DataFrame:
    """(doc_id, order, label, features) of every usable labelled document, one row per id.

    Features are taken before ids meet, so whole texts are not shuffled. Of several documents of
    one id the one whose text hashes lowest counts.
    """
    told = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("at")).filter(
        F.col("doc_id").isNotNull() & usable)
    made = feature_rows(told, ["doc_id", "at"]).join(usable_labels(labels, label, usable), "doc_id")
    return made.groupBy("doc_id", "order", "label").agg(F.min_by("features", "at").alias("features"))


def paired(rows: DataFrame, good: int, bad: int, pairs: int) -> DataFrame:
    """``d``: features of a preferred row less those of another, over partners dealt in turn.

    ``rows`` are numbered from 1 per label. Every row of the larger label gets the same number of
    partners, ``PARTNERS`` or what makes ``pairs`` in all, and every row of the other is as often a
    partner, give or take one; with few rows these are all pairs.
    """
    most, least, larger = max(good, bad), min(good, bad), int(good >= bad)
    each = min(least, max(PARTNERS, -(-pairs // most)))
    place = (F.col("row_number") - 1 + F.col("nth")) % least
    many = (rows.filter(F.col("label") == larger)
            .withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
            .select(place.alias("place"), F.col("features").alias("a")))
    few = rows.filter(F.col("label") != larger).select(
        (F.col("row_number") - 1).alias("place"), F.col("features").alias("b"))
    first, second = ("a", "b") if larger else ("b", "a")
    return many.join(few, "place").select(
        F.zip_with(first, second, lambda p, q: p - q).alias("d"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _summed(df: DataFrame, sums) -> np.ndarray:
    """What ``sums`` makes of each task's batches, added up: one short row per task is moved."""
    def run(batches):
        parts = [sums(batch) for batch in batches]
        if parts:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "sums": pa.array([np.sum(parts, 0).tolist()], pa.list_(pa.float64()))})

    found = df.mapInArrow(run, "part int, sums array<double>").toArrow().sort_by("part")
    return np.sum(np.array(found["sums"].to_pylist(), float), 0)


def fit_all_pairs(pairs: DataFrame, l2: float = 1e-3) -> np.ndarray:
    """Weights by the Newton steps of :func:`fit_pairs` over a written table of differences."""
    k = len(FEATURES)
    w = np.zeros(k)
    for _ in range(25):
        def sums(batch, w=w):
            d = _matrix(batch.column(0))
            p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
            return np.concatenate([d.T @ (1 - p), ((d * (p * (1 - p))[:, None]).T @ d).ravel(),
                                   [len(d)]])

        found = _summed(pairs, sums)
        gradient = found[:k] / found[-1] - l2 * w
        hessian = found[k:-1].reshape(k, k) / found[-1] + l2 * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_quantile_of(scored: DataFrame, good: int, bad: int, steps: int = 400) -> float:
    """:func:`best_quantile` of all (score, label) rows of a table.

    One sort over ranges gives the rows at the quantiles; one more pass counts the labels
    below each cut. ``order`` and ``doc_id`` tell rows of one score apart.
    """
    n = good + bad
    at = np.linspace(0, 1, steps + 1) * (n - 1)
    below = np.floor(at).astype(int)
    above = np.minimum(below + 1, n - 1)
    numbered = number_rows(scored, [], [F.col("score"), F.col("order"), F.col("doc_id")])
    wanted = sorted({int(i) + 1 for i in np.concatenate([below, above])})
    value = {r["row_number"]: r["score"] for r in numbered.filter(
        F.col("row_number").isin(wanted)).select("row_number", "score").collect()}
    low, high = (np.array([value[i + 1] for i in side]) for side in (below, above))
    cuts = np.unique(low + (high - low) * (at - below))
    cuts = np.sort(np.concatenate([(cuts[:-1] + cuts[1:]) / 2, cuts[:1]]))

    def sums(batch):
        score, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        place = np.searchsorted(cuts, score, side="right")
        return np.concatenate([np.bincount(place[label == v], minlength=len(cuts) + 1)
                               for v in (1, 0)]).astype(float)

    found = _summed(scored.select("score", "label"), sums).reshape(2, -1)[:, :-1].cumsum(1)
    right = (1 - found[0] / good) + found[1] / bad
    return float(np.median(cuts[right == right.max()]))


def fit_quality(docs: DataFrame, labels: DataFrame, usable, pairs: int = 100_000,
                threshold: float = 0.7, label: str = "quality", text: str = "text") -> dict:
    """A model from all usable labelled documents; only sums and quantiles reach the driver.

    ``pairs`` is the least number of pairs, as far as there are so many; larger tables give more.
    Without rows of both labels all weights are zero and every text scores ``threshold``.
    """
    model = {"weights": [0.0] * len(FEATURES), "cut": 0.0,
             "shift": float(np.log(threshold / (1 - threshold)))}
    rows = materialise(labelled_features(docs, labels, usable, label, text), "quality_features")
    counts = dict(rows.groupBy("label").count().collect())
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return model
    numbered = number_rows(rows, ["label"], [F.col("order"), F.col("doc_id")])
    w = fit_all_pairs(materialise(paired(numbered, good, bad, pairs), "quality_pairs"))

    def run(batches):
        for batch in batches:
            yield append(batch, ["label", "order", "doc_id"], {
                "score": pa.array(_matrix(batch.column("features")) @ w, pa.float64())})

    kept = ["label", "order", "doc_id"]
    scored = materialise(rows.select(*kept, "features").mapInArrow(
        run, schema_of(rows, kept, "score double")), "quality_scores")
    return model | {"weights": w.tolist(), "cut": best_quantile_of(scored, good, bad)}


def score_quality(docs: DataFrame, model: dict, threshold: float = 0.7,
                  text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    A null text counts as an empty one. Each row is scored on its own and as a whole; repeated
    rows score alike. Columns of ``docs`` with the new names are replaced.
    """
    keep = without(docs, ["score", "predicted"])
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)
    w, cut, shift = np.array(model["weights"]), model["cut"], model["shift"]

    def run(batches):
        for batch in bounded_batches(batches):
            x = np.array([features(v) for v in
                          batch.column(batch.schema.get_field_index(text)).to_pylist()], float)
            above = x.reshape(-1, len(w)) @ w - cut
            score = 1 / (1 + np.exp(-np.clip(above + shift, -35, 35)))
            predicted = (score >= threshold) | (above >= 0)
            yield append(batch, keep, {
                "score": pa.array(np.where(predicted, np.maximum(score, threshold), score)),
                "predicted": pa.array(predicted.astype(np.int32), pa.int32())})

    return source.mapInArrow(run, schema_of(source, keep, "score double, predicted int"))
