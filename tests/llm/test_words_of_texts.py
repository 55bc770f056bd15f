import random

import numpy as np
import pytest

from llm_samples import prose

from asfiled.llm import lm_scoring, shingles
from asfiled.llm.lm_scoring import _Places, fit_network, score_documents
from asfiled.llm.shingles import LOWER_BYTES, word_hashes, words_of_texts


@pytest.mark.parametrize("most", [1, 300, 1 << 16])
def test_words_of_many_texts_are_those_of_each(most):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    texts += [None, "", " \t\n\x0b\x0c\r", "Ab é日本\x00x\x85y\x1fz ", None, " lead", "trail ", "x" * 900, ""]
    rng.shuffle(texts)
    for some in (texts, [None, ""], []):
        alone = [word_hashes((t or "").encode().translate(LOWER_BYTES)) for t in some]
        hashes, sizes = words_of_texts(some, most)
        assert sizes.tolist() == [len(h) for h in alone]
        assert hashes.tolist() == [w for h in alone for w in h.tolist()]


def test_short_texts_are_hashed_together(monkeypatch):
    runs, words = [], shingles._words
    monkeypatch.setattr(shingles, "_words", lambda data: runs.append(len(data)) or words(data))
    words_of_texts(["some short text"] * 1000, 1 << 12)
    assert len(runs) == 4 and max(runs) < 2 << 12


def test_places_are_those_of_a_search():
    rng = np.random.default_rng(2)
    spread = np.unique(rng.integers(0, 1 << 64, 700, np.uint64))
    close = np.arange(50, dtype=np.uint64) * np.uint64(3)  # all begin with the same bits
    ends = np.array([0, (1 << 64) - 1], np.uint64)
    for table in (spread, close, ends, spread[:1], spread[:0]):
        h = np.concatenate([table, table + np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64), ends])
        at, held = _Places(table).found(h)
        assert held.tolist() == np.isin(h, table).tolist()
        assert (table[at[held]] == h[held]).all() if len(table) else not held.any()


def test_pieces_of_batches_change_no_score(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 80)) + (f" rare{i % 9}" * (i % 4))) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[3], (90, None), (91, " ")], "doc_id long, text string").coalesce(1)

    def scores():
        words, network = fit_network(df)
        words.common, words.logs = words.common[:5], words.logs[:5]
        words.rare = lm_scoring.count_words(df)  # some of them are told by the table alone
        words.rare = words.rare.filter(~words.rare.word.isin(words.common.view(np.int64).tolist()))
        return sorted(map(tuple, score_documents(df, words, network).drop("text").collect()))

    whole = scores()
    monkeypatch.setattr(lm_scoring, "_PIECE", 300)
    for one, other in zip(scores(), whole, strict=True):
        assert one == (*other[:2], *(x and pytest.approx(x, rel=1e-12) for x in other[2:]))
