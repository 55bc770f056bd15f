"""Mixing, decontamination, rules, surrogates, scores and the pipeline against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asfiled.llm import jaccard_join, lm_scoring, mixing, pii, quality_rules, toxicity
from asfiled.llm.decontaminate import contamination, decontaminate
from asfiled.llm.quality_classifier import best_quantile, fit_pairs
from llm_samples import prose


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


# -- mixing ----------------------------------------------------------------------------------

def test_mix_meets_its_targets(spark):
    import random
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 60)) + " #" * rng.randrange(9),
             rng.choice(["a", "a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    got = mixing.mix(docs_of(spark, rows).repartition(5)).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    total = sum(size.values())
    by = {}
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        assert r.epochs in (int(r.target // r.source_size), int(r.target // r.source_size) + 1)
        by.setdefault((r.source_size, r.target), []).append(r)
    assert len(by) == 5 and abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (source_size, target), part in by.items():
        assert target <= 2 * source_size + 1e-9
        assert abs(sum(r.taken for r in part) - target) <= max(r.size for r in part) / 2
    again = mixing.mix(docs_of(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_heavier_documents_come_first(spark):
    rows = [(i, "w " * 20 + ("# " * 10 if i % 2 else "x " * 10), "b") for i in range(600)]
    rows += [(10_000 + i, "w " * 30, "a") for i in range(1200)]
    got = mixing.mix(docs_of(spark, rows), share=0.5).filter("doc_id < 10000").collect()
    taken = Counter(r.doc_id % 2 for r in got if r.taken)
    assert taken[0] > 1.5 * taken[1] > 0


# -- decontamination --------------------------------------------------------------------------

def test_spans_are_removed_and_the_rest_stays(spark):
    item = " ".join(f"b{i}" for i in range(14))
    items = spark.createDataFrame([(1, item), (12, "Q1 q2, q3"), (2, None)], "item_id long, text string")
    text = f"-- Start. {item.upper()}! middle q1 (Q2) q3 end"
    docs = docs_of(spark, [(1, text, "a"), (2, "clean text", "a"), (3, None, None), (2, "q1 q2 q3", "a")])
    found = {(r.doc_id, r.n_words): r for r in contamination(docs, items).collect()}
    assert found[1, 20].n_hit == 17 and found[1, 20]["items"] == ["1", "12"]
    assert [tuple(s) for s in found[1, 20].spans] == [(2, 15), (17, 19)]
    assert found[2, 3].contaminated and not found[2, 2].contaminated and found[3, 0].n_hit == 0
    kept = decontaminate(docs, items, "spans").collect()
    assert {r.text for r in kept} == {"-- Start. middle end", "clean text", None, ""}
    assert {r.text for r in decontaminate(docs, items).collect()} == {"clean text", None}


def test_a_large_benchmark_goes_in_several_passes(spark):
    import random
    rng = random.Random(2)
    items = spark.createDataFrame([(i, prose(rng, 25)) for i in range(20)], "item_id long, text string")
    rows = [(i, prose(rng, 30) + (" " + r.text if i % 3 == 0 else ""), "a")
            for i, r in enumerate(items.collect() * 2)]
    docs = docs_of(spark, rows)
    one, many = (sorted(str(r) for r in contamination(docs, items, broadcast_windows=n).collect())
                 for n in (10 ** 6, 60))
    assert one == many and sum("contaminated=True" in r for r in one) == 14


# -- rules -------------------------------------------------------------------------------------

def test_the_order_of_rules_changes_no_verdict(spark, odd):
    rules = quality_rules.RULES
    one = quality_rules.quality_verdicts(odd, rules).select("doc_id", "kept")
    two = quality_rules.quality_verdicts(odd, rules[::-1], sample_rows=1).select("doc_id", "kept")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    figures = {"a": (1.0, 0.5), "b": (0.1, 0.1), "c": (2.0, 0.0)}
    order = quality_rules.ordered(tuple(quality_rules.Rule(n, None) for n in "abc"), figures)
    assert [r.name for r in order] == ["b", "a", "c"]


def test_repeated_words_by_brute_force():
    import random
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randrange(15))]
        seen = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1
                  for k in range(3)}
        assert quality_rules.Measures(" ".join(words)).n_repeat_words == len(inside)


# -- surrogates ---------------------------------------------------------------------------------

TEXTS = [
    "Mail Foo.52@mail0.example.com or foo.52@mail0.example.com, call +1 (803) 555-5351.",
    "+1 803 555 5351, card 4111 1111 1111 1111 or 4111111111111111; ip 208.98.142.209, v 1.2.3.4.5",
    'token = "186661156f3f9905942d70850a01cbf23a203f82" on 12.05.2020, ssn 123-45-6789',
    "Mrs. Anna Smith met Mr Smith and Herr Jonas Müller; Госпожа Анна Петрова; иван@почта.рф",
    "nothing 12 to 34 see", "", None]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
               for i, c in enumerate(reversed(digits))) % 10


def test_surrogates_keep_kind_format_and_coreference(spark):
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(TEXTS)])
    got = {r.doc_id: r for r in pii.replace_entities(docs, "key", count="n").collect()}
    one = re.match(r"Mail (\w+\.\d\d@\w+\.\w+\.com) or (\S+\.com), call (\+1 \(\d{3}\) \d{3}-\d{4})\.$",
                   got[0].text)
    assert one and one[1].lower() == one[2] and one[1][0].isupper() and "foo" not in got[0].text.lower()
    two = re.match(r"(\+1 \d{3} \d{3} \d{4}), card ((?:\d{4} ){3}\d{4}) or (\d{16}); ip ([\d.]+), v 1.2.3.4.5$",
                   got[1].text)
    digits = [re.sub(r"\D", "", x) for x in (one[3], two[1], two[2], two[3])]
    assert digits[0] == digits[1] != "18035555351" and digits[2] == digits[3] != "4" + "1" * 15
    assert luhn(digits[2]) == luhn("4111111111111111") and digits[2][0] == "4"
    assert all(0 < int(p) < 256 for p in two[4].split(".")) and [len(p) for p in two[4].split(".")] == [3, 2, 3, 3]
    three = re.match(r'token = "([0-9a-f]{40})" on 12.05.2020, ssn (\d{3}-\d{2}-\d{4})$', got[2].text)
    assert three and not three[1].startswith("18666115") and three[2] != "123-45-6789"
    four = re.match(r"Mrs\. (\w+)a (\w+) met Mr (\w+) and Herr (\w+)n (\w+); Госпожа ([а-я]+)а ([а-я]+); ([а-я]+)@",
                    got[3].text, re.I)
    assert four and four[2] == four[3] and "Smith" not in got[3].text and "Анна" not in got[3].text
    assert [got[i].text for i in (4, 5, 6)] == TEXTS[4:] and [got[i].n for i in (0, 1, 2, 3, 4, 6)] == [3, 4, 2, 5, 0, 0]
    other = {r.doc_id: r.text for r in pii.replace_entities(docs, "other").collect()}
    assert all(other[i] != got[i].text for i in range(4))


def test_crowded_formats_stay_distinct(spark):
    """More addresses of one format than surrogates of it would stay apart by luck."""
    rows = [(i, f"at {1 + i % 9}.{1 + i // 9 % 9}.{1 + i // 81 % 9}.{1 + i // 729}", "a") for i in range(1500)]
    got = pii.replace_entities(docs_of(spark, rows), "k").collect()
    made, real = [r.text for r in got], {t for _, t, _ in rows}
    assert len(set(made)) == len(rows) and not real & set(made)


# -- learned scores -------------------------------------------------------------------------------

def test_pairs_recover_the_order_of_scores():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=4000) > 0).astype(int)
    w = fit_pairs(x, y, 20_000, 3)
    assert abs(w[1] / w[0] + 0.5) < 0.12 and abs(w[2]) < 0.15
    cut = best_quantile(x @ w, y)
    known = ((x @ [2.0, -1.0, 0.0] > 0) == y).mean()  # no rule does better than the true scores
    assert known - 0.02 < ((x @ w >= cut) == y).mean() <= known + 0.02


def test_ftrl_keeps_what_matters_and_nothing_else(spark):
    import random
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + (" vile" if i % 4 == 0 else ""), "a") for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    weights = toxicity.fit_toxicity(docs_of(spark, rows), labels, F.col("doc_id") < 900)
    assert 0 < len(weights) < 200
    got = toxicity.score_toxicity(docs_of(spark, rows), weights).filter("doc_id >= 900").collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got)


def test_network_learns_what_stands_between_words(spark):
    """After training, a word in its place is likelier than the same words shuffled."""
    import random
    rng = random.Random(6)
    rows = [(i, " ".join(f"a{k % 5} b{k % 7}" for k in range(rng.randrange(9), 60)), "a") for i in range(300)]
    words, net = lm_scoring.fit_network(docs_of(spark, rows), 10, 4, 8, stride=2, rounds=3)
    mixed = [(i, " ".join(rng.sample(t.split(), len(t.split()))), s) for i, t, s in rows]
    good, bad = (lm_scoring.score_documents(docs_of(spark, r), words, net).agg(F.avg("per_token")).first()[0]
                 for r in (rows, mixed))
    assert good > bad + 0.5 and good > -np.log(14)
    ids = words.of(rows[0][1])
    around = lm_scoring.windows(ids, words.classes)
    z = net.logits(net.hidden(around))
    p = np.exp(z - z.max(1, keepdims=True))
    brute = np.log(p / p.sum(1, keepdims=True))[np.arange(len(ids)), ids]
    assert np.allclose(net.log_probabilities(around, ids), brute, atol=1e-4)


# -- pipeline --------------------------------------------------------------------------------------

def test_pipeline_equals_its_stages_in_plain_python(spark):
    """Every stage by brute force on the driver's smallest tables; surrogates by their patterns."""
    sf_dir = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {i: r for i, r in rows.items()
            if quality_rules.passes(quality_rules.Measures(r["text"]), quality_rules.RULES)}

    sets = {}
    for i, r in kept.items():
        w = r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    top = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and 180 * len(sets[a] & sets[b]) >= 80 * (len(sets[a]) + len(sets[b])):
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = {i: new if t == old else t for i, t in top.items()}
    kept = {i: r for i, r in kept.items() if top[i] == i}

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = word.findall(r.text.lower())
        known |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    for i in list(kept):
        w = word.findall(kept[i]["text"].lower())
        if any(tuple(w[k:k + 10]) in known for k in range(len(w) - 9)):
            del kept[i]

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(kept) and 0 < len(kept) < len(rows)
    for i, r in kept.items():  # surrogates keep the number of words
        assert got[i].size == len(r["text"].encode().split())
    total = sum(r.size for r in got.values())
    assert abs(sum(r.taken for r in got.values()) - 1.5 * total) < 0.1 * total


def test_surrogate_stage_changes_entities_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.surrogates(spark, docs, "").collect()}
    entity = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b"
                        r"|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-fA-F]{40}\b")
    for r in docs.collect():
        real = entity.findall(r.text)
        assert not any(e in got[r.doc_id].text for e in real)
        assert [x for x in re.split(r"\S*\d\S*", got[r.doc_id].text) if x.strip()] == \
            [x for x in re.split(r"\S*\d\S*", r.text) if x.strip()] or real
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text)
