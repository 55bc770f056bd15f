"""Columns named like those that operators make on the way come out as they went in."""

import random

import pytest
from pyspark.sql import functions as F

from asfiled.llm import decontaminate, lm_scoring, pii
from llm_samples import prose

INTERNAL = ("_doc", "_key", "_KEY_", "_own_key", "_spans", "_found", "_own", "_later", "_check",
            "_more", "_text", "_words", "_copies", "_at", "m", "e", "j", "attempt", "spans", "items")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    item = prose(rng, 12)
    rows = [(1, f"{prose(rng, 30)} {item} {prose(rng, 30)}"), (2, prose(rng, 40)), (3, None),
            (4, "Mr John Smith wrote to a.b@x.org and called 803-555-5351"), (None, "a@b.c and b@b.c")]
    rows += [(10 + i, f"{chr(97 + i)}@b.c") for i in range(26)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in INTERNAL:
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df, spark.createDataFrame([(1, item)], "item_id long, text string")


def unharmed(frame, docs, n):
    rows = frame.collect()
    assert frame.columns == docs.columns and len(rows) == n
    assert all(r[name] == f"own {name}" for r in rows for name in INTERNAL)
    return {r.doc_id: r.text for r in rows}


def test_decontamination(docs):
    df, items = docs
    assert 1 not in unharmed(decontaminate.decontaminate(df, items), df, 30)
    cut = unharmed(decontaminate.decontaminate(df, items, remove="spans"), df, 31)
    assert items.first().text not in cut[1] and cut[3] is None


def test_surrogates_that_have_to_move_on(docs):
    df, _ = docs
    got = unharmed(pii.replace_entities(df, "k"), df, 31)
    before = {r.doc_id: r.text for r in df.collect()}
    moved = [got[10 + i] for i in range(26)]
    assert "John" not in got[4] and len(set(moved)) == 26 and not set(moved) & set(before.values())


def test_scores(docs):
    df, _ = docs
    plain = df.select("doc_id", "text")
    model = lm_scoring.fit_network(plain)
    scored = lm_scoring.score_documents(df, *model)
    want = {r.doc_id: r.pseudo_log_likelihood for r in lm_scoring.score_documents(plain, *model).collect()}
    rows = scored.collect()
    assert all(r[name] == f"own {name}" for r in rows for name in INTERNAL)
    assert {r.doc_id: r.pseudo_log_likelihood for r in rows} == want
