"""Every operator and stage on odd rows and on an empty table."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asfiled.llm import (
    decontaminate, jaccard_join, licenses, lm_scoring, mixing, pii, quality_classifier,
    quality_rules, token_counts, toxicity,
)

BPE = public_tokenizers.path("byte_bpe_50k.json")


def items(spark, rows=((1, "w1q w2q w3q"), (2, None), (None, ""), (3, "?!"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).union(
        spark.sql("select 11L, null, null union all select 11L, 0, 1 union all select null, 1, 1"))


OPERATORS = {
    "op1": lambda s, d: lm_scoring.score_documents(d, *lm_scoring.fit_network(d)),
    "op2": lambda s, d: pii.replace_entities(d, "k", count="n_entities"),
    "op3": lambda s, d: mixing.mix(d),
    "op4": lambda s, d: decontaminate.contamination(d, items(s)),
    "op5": lambda s, d: quality_rules.quality_verdicts(
        d, report=("n_words", "n_repeat_words"), always=quality_rules.BASE_RULES),
    "op6": lambda s, d: token_counts.prefix_token_counts(d, BPE, (3,)),
    "op7": lambda s, d: quality_classifier.score_quality(
        d, quality_classifier.fit_quality(d, labels(s, d), F.lit(True), pairs=50)),
    "op8": lambda s, d: toxicity.score_toxicity(
        d, toxicity.fit_toxicity(d, labels(s, d), F.lit(True))),
    "op9": lambda s, d: jaccard_join.jaccard_components(d),
    "op10": lambda s, d: licenses.scan_licenses(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_odd_row_has_one_result(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    assert len(got) == 15
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_one(spark, none, name):
    assert OPERATORS[name](spark, none).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stages_take_odd_rows_and_none(spark, odd, none, stage, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, odd, str(tmp_path))
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert got.columns == odd.columns
    assert 0 < got.count() <= 15
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_equal_rows_get_equal_results(spark, odd):
    for name in ("op1", "op4", "op5", "op6", "op9", "op10"):
        twins = [r for r in OPERATORS[name](spark, odd).collect() if r.doc_id == 1]
        assert len(twins) == 2 and twins[0] == twins[1], name


def test_defined_results_of_empty_texts(spark, odd):
    blank = {3, 4, 5}

    def of(name):
        return {r.doc_id: r for r in OPERATORS[name](spark, odd).collect() if r.doc_id in blank}
    assert all(r.n_tokens == 0 and r.per_token is None for r in of("op1").values())
    assert all(r.n_entities == 0 for r in of("op2").values())
    assert all(r.size == r.taken == 0 for r in of("op3").values())
    assert all(r.n_words == r.n_hit == 0 and r.items == [] for r in of("op4").values())
    assert all(r.base_failed and not r.kept for r in of("op5").values())
    assert [of("op6")[i].n_tokens for i in (3, 4)] == [0, 0]
    assert all(r.n_shingles == 0 and r.component_id == i for i, r in of("op9").items())
    assert all(r.license is None and r.coverage == 0 for r in of("op10").values())


def test_empty_benchmark_labels_and_templates(spark, odd):
    got = decontaminate.contamination(odd, items(spark, ()).limit(0))
    assert got.filter("contaminated or n_items_ > 0" if "n_items_" in got.columns
                      else "contaminated").count() == 0
    no = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_toxicity(
        odd, toxicity.fit_toxicity(odd, no, F.lit(True))).collect()} == {0.5}
    model = quality_classifier.fit_quality(odd, no, F.lit(True), pairs=10)
    assert {round(r.score, 9) for r in quality_classifier.score_quality(odd, model).collect()} == {0.7}
    assert licenses.scan_licenses(odd, {}).filter("license is not null").count() == 0
