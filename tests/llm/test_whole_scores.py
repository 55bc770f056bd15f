"""Word probabilities of op1: shares of words in their classes, and training on every word."""

import random

import numpy as np
import pytest

from asfiled.llm import lm_scoring
from llm_samples import prose


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("common", [1, 1 << 16])
def test_shares_follow_the_counts_of_all_words(spark, common):
    """Told by the driver's list or by the join, a rarer word of a class is less likely."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 40, 50)) for i in range(60)] + [(99, "often " * 7 + "seldom")] * 2
    docs = docs_of(spark, rows)
    words = lm_scoring.vocabulary(docs, 3, 2, common=common)
    assert (words.rare is None) == (common > 1)
    net = lm_scoring.Network(words.classes, 4, 1)
    counts = {}
    for w in " ".join(t for _, t in rows).split():
        counts[w] = counts.get(w, 0) + 1
    hashed = {w: words.hashes(w)[0] for w in [*counts, "zqxj"]}
    tail = [w for w in counts if hashed[w] not in words.frequent]
    texts = [(1, "seldom"), (2, "often"), (3, "zqxj"), (4, "often zqxj often the"), (5, None),
             (6, "seldom"), (6, "seldom"), (7, tail[0])]
    got = lm_scoring.score_documents(docs_of(spark, texts), words, net).collect()
    assert len(got) == len(texts)
    for r, text in ((r, r.text or "") for r in got):
        ids, want = words.of(text), 0.0
        if len(ids):
            want = net.log_probabilities(lm_scoring.windows(ids, words.classes), ids).sum()
        for w in text.split():
            if hashed[w] in words.frequent:
                continue
            same = [v for v in tail if hashed[v] % np.uint64(words.shared) == hashed[w] % np.uint64(words.shared)]
            once = sum(counts[v] == 1 for v in same)
            want += np.log(counts.get(w, (once + 1) / (len(counts) + 1)) / (sum(counts[v] for v in same) + once + 1))
        assert np.isclose(r.pseudo_log_likelihood, want, atol=1e-5)
        assert r.per_token is None if not text else np.isclose(r.per_token, want / len(ids), atol=1e-5)


def test_classes_grow_with_the_words(spark):
    few, many = (lm_scoring.vocabulary(docs_of(spark, [(1, " ".join(f"v{i}" for i in range(n)))]), 4, 2)
                 for n in (9, 10_000))
    assert (len(few.frequent), few.shared) == (4, 2) and (len(many.frequent), many.shared) == (25, 8)


def test_every_word_is_a_target_once(spark, monkeypatch, tmp_path):
    """Also in texts of one to a few words."""
    rng = random.Random(4)
    texts = [" ".join(f"t{i}w{k}" for k in range(rng.randrange(1, 8))) for i in range(40)]
    docs = docs_of(spark, list(enumerate(texts))).coalesce(1)
    folder = str(tmp_path)

    def learn(self, around, center, memory, rate):
        with open(f"{folder}/seen", "a") as out:
            out.writelines(f"{c}\n" for c in center)
    monkeypatch.setattr(lm_scoring.Network, "learn", learn)
    # The patched class travels to the workers by value.
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(lm_scoring)
    try:
        words, _ = lm_scoring.fit_network(docs)
    finally:
        cloudpickle.unregister_pickle_by_value(lm_scoring)
    seen = sorted(map(int, open(f"{folder}/seen").read().split()))
    assert seen == sorted(int(c) for t in texts for c in words.of(t))


def test_titles_of_one_word_train_the_network(spark):
    words, net = lm_scoring.fit_network(docs_of(spark, [(i, f"title{i % 3}") for i in range(60)]))
    assert not np.array_equal(net.flat(), lm_scoring.Network(words.classes, 16, 1).flat())


def test_two_levels_are_one_softmax():
    """Places that no class has weigh nothing, wild scores overflow nowhere, blocks do not matter."""
    rng = np.random.default_rng(2)
    for classes in (1, 2, 5, 30):
        net = lm_scoring.Network(classes, 4, 1)
        for scale in (1, 900):
            for a in (net.e, net.w, net.v):
                a *= scale
            assert net.tame() == (scale == 1)
            sizes = rng.integers(0, 9, 300)
            ids = rng.integers(0, classes, sizes.sum())
            around = lm_scoring.windows(ids, classes, sizes)
            cuts = np.split(ids, np.cumsum(sizes)[:-1])
            assert np.array_equal(around, np.concatenate([lm_scoring.windows(c, classes) for c in cuts]))
            every = net.logits(net.hidden(around))
            assert every.shape == (len(ids), classes) and np.allclose(np.exp(every).sum(1), 1, atol=1e-4)
            got = net.log_probabilities(around, ids)
            assert np.allclose(got, every[np.arange(len(ids)), ids], atol=1e-2, rtol=1e-4)
            assert np.array_equal(got[7:50], net.log_probabilities(around[7:50], ids[7:50]))


def test_step_follows_the_gradient_of_the_likelihood():
    """One step with a fresh memory moves every number by the rate, against its numeric gradient."""
    rng = np.random.default_rng(3)
    classes, n = 11, 60
    ids = rng.integers(0, classes, n)
    around = lm_scoring.windows(ids, classes)
    net, memory = lm_scoring.Network(classes, 3, 1), lm_scoring.Network(classes, 3, 1)
    memory.load(np.zeros(net.flat().shape))
    start = net.flat().astype(float)
    double = lm_scoring.Network(classes, 3, 1)
    for name in "ewbvc":
        setattr(double, name, getattr(double, name).astype(float))

    def loss(flat):
        return -double.load(flat).log_probabilities(around, ids).mean()

    net.learn(around, ids, memory, 0.01)
    moved, past = net.flat() - start, memory.flat()
    for i in range(len(start)):
        if start[i] < -1:
            assert moved[i] == 0
            continue
        up, down = start.copy(), start.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        gradient = (loss(up) - loss(down)) / 2e-4
        assert np.isclose(past[i], gradient * gradient, atol=2e-4, rtol=0.05)
        if abs(gradient) > 5e-3:
            assert np.isclose(moved[i], -0.01 * np.sign(gradient), rtol=0.05)


def test_texts_score_above_their_words_shuffled(spark):
    """The driver's smallest documents, nearly all in their own order the likelier ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lm_scoring.fit_network(docs)
    rng, rows = random.Random(5), []
    for r in docs.filter("size(split(text, ' ')) between 100 and 1000").collect():
        words = r.text.split()
        rows += [(2 * r.doc_id, " ".join(words)), (2 * r.doc_id + 1, " ".join(rng.sample(words, len(words))))]
    score = {r.doc_id: r.per_token for r in lm_scoring.score_documents(docs_of(spark, rows), *model).collect()}
    above = [score[i] > score[i + 1] for i in score if i % 2 == 0]
    assert len(above) > 100 and np.mean(above) >= 0.95
