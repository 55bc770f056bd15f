import random
import re
from itertools import combinations

import numpy as np
import pytest

from llm_samples import prose

from asfiled.llm import jaccard_join, signature_tree
from asfiled.llm.jaccard_join import jaccard_components, one_per_component
from asfiled.llm.shingles import shingle_set, word_hashes



def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    sets, top = sets_of([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                top[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Exact copies, near copies around one text, a chain whose ends differ, a shared passage."""
    rng = random.Random(11)
    base = prose(rng, 200).split()
    texts = [" ".join(base)] * 15
    texts += [" ".join(edited(rng, base, rng.randrange(8))) for _ in range(60)]
    chain = prose(rng, 150).split()
    for i in range(30):
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, rng.randrange(1, 40))} {passage} {prose(rng, rng.randrange(1, 40))}"
              for _ in range(60)]
    texts += [prose(rng, rng.randrange(1, 12), 3) for _ in range(60)]
    texts += ["", " ", "A b C d", "a B c D", "one two three four five", "one two three four five six"]
    ids = rng.sample(range(10 ** 6), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("chunk, spines", [(2000, 2), (7, 0)])
def test_components_equal_brute_force(spark, corpus, monkeypatch, chunk, spines):
    """Also with blocks cut into small chunks and everything left to the trees."""
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "SPINES", spines)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(6)
    got = sorted(tuple(r) for r in jaccard_components(df).collect())
    assert got == brute(corpus)


def test_one_document_of_each_group_stays(spark, corpus):
    df = spark.createDataFrame([*corpus, corpus[0]], "doc_id long, text string")
    kept = sorted(r.doc_id for r in one_per_component(df).collect())
    assert kept == sorted(d for d, _, c in brute(corpus) if d == c)


def test_words_are_told_apart_by_their_bytes():
    words = [f"w{i}" for i in range(5000)] + ["é", "e", "日本", "日", "a" * 5000, "a" * 4999]
    hashes = word_hashes(" \t".join(words).encode())
    assert len(set(hashes.tolist())) == len(words)
    assert (word_hashes(b"x  y\x0bx") == word_hashes(b"\nx y x ")).all()
    assert len(shingle_set("A b", 5)) == 1 and (shingle_set("A b", 5) == shingle_set("a B", 5)).all()


def test_dual_traversal_cuts_no_similar_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 56, 300, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 280, False),
                                      rng.integers(0, 1 << 56, k % 30, np.uint64)]))
            for k in range(60)]
    sets += [np.unique(rng.integers(0, 1 << 56, rng.integers(200, 400), np.uint64)) for _ in range(60)]
    width = 256
    bits = np.array([np.frombuffer(signature_tree.bitmap(s, width), np.uint8) for s in sets])
    n = np.array([len(s) for s in sets])
    tree = signature_tree.SignatureTree(bits, n, np.arange(len(sets)))
    found = {(int(a), int(b)) for i, j in signature_tree.dual_traversal(tree, tree, 80)
             for a, b in zip(i, j)}
    similar = {(a, b) for a, b in combinations(range(len(sets)), 2)
               if 1.8 * len(np.intersect1d(sets[a], sets[b])) >= 0.8 * (n[a] + n[b])}
    assert similar and similar <= found
    assert len(found) < len(sets) * (len(sets) - 1) // 4
