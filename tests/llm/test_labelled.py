"""Labelled ids that repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from asfiled.llm import quality_classifier as quality
from asfiled.llm.labelled import training_sample


def test_a_repeated_id_gives_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert sorted(r.label for r in training_sample(docs, labels, "toxic", F.lit(True), 10).collect()) == [0, 1]


def _prose(spark, n):
    """Good texts are plain, bad ones shout; every seventh is the other way round."""
    def row(i):
        good = i % 2 if i % 7 else 1 - i % 2
        words = [f"word{(i * k) % 53}" for k in range(1, 20 + i % 5)]
        return i, " ".join(words if good else [w.upper() + "!" * (k % 3) for k, w in enumerate(words)]), i % 2

    made = spark.createDataFrame([row(i) for i in range(n)], "doc_id long, text string, quality int")
    return made.select("doc_id", "text"), made.select("doc_id", "quality")


def test_quality_is_fitted_on_every_labelled_document(spark):
    docs, labels = _prose(spark, 300)
    found = quality.labelled_features(docs, labels, F.lit(True), "quality", "text")
    assert found.count() == 300
    numbered = quality.number_rows(found, ["label"], [F.col("order"), F.col("doc_id")])
    assert quality.paired(numbered, 150, 150, 1).count() == quality.PARTNERS * 150
    assert quality.paired(numbered, 150, 150, 10**6).count() == 150 * 150
    assert quality.paired(numbered.filter("label = 1 or row_number <= 7"), 150, 7, 1).count() == 4 * 150
    # Weights and cut are those of the same rows fitted at once.
    model = quality.fit_quality(docs, labels, F.lit(True), pairs=10**6)
    rows = found.collect()
    x, y = np.array([r.features for r in rows]), np.array([r.label for r in rows])
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    w = np.array(model["weights"])
    p = 1 / (1 + np.exp(-d @ w))
    assert np.abs(d.T @ (1 - p) / len(d) - 1e-3 * w).max() < 1e-7
    assert model["cut"] == pytest.approx(quality.best_quantile(x @ w, y))


def test_a_label_beyond_the_former_bound_changes_the_model(spark):
    """20,000 rows were the most; the rows whose ids hash highest must count as well."""
    n = 20_050
    ids = spark.range(n).withColumn("at", F.xxhash64("id", F.lit("quality")))
    last = [r.id for r in ids.orderBy(F.desc("at")).limit(50).collect()]
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(last), "BAD | BAD | BAD!")
                      .otherwise("some plain words").alias("text"))
    labels = docs.select("doc_id", (~F.col("doc_id").isin(last)).cast("int").alias("quality"))
    model = quality.fit_quality(docs, labels, F.lit(True), pairs=1000)
    assert np.abs(model["weights"]).max() > 0
