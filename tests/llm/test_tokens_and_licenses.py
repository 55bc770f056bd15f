import random
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

from asfiled.llm.licenses import TEMPLATES, best_coverage, longest_rise, patience_pairs, scan_licenses, words_of
from asfiled.llm.token_counts import (
    PrefixCounter, chars_within, prefix_token_counts, tokens_of_prefix, total,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'re", "'ll", "don't", "é", "ñ", "日本", "😀", "!", "23",
         "<|endoftext|>", "<|end", "oftext|>", "\xa0", "　", "The ", "unbelievable", "=====",
         "    ", "\r\n", "\x1c", "²", "Ⅷ"]


def test_every_prefix_has_the_count_of_the_library():
    count, library = PrefixCounter(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        deltas = count.deltas(text)
        counts = [len(library.encode(text[:n], add_special_tokens=False).ids)
                  for n in range(len(text) + 1)]
        assert [tokens_of_prefix(deltas, n) for n in range(len(text) + 1)] == counts, text
        for budget in (0, 1, 3):
            fits = max(n for n, c in enumerate(counts) if c <= budget)
            assert chars_within(deltas, budget) == fits


def test_counts_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(PATH)
    rows = prefix_token_counts(docs, PATH, (100,)).collect()
    for r in rows[:60]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) == total(r.token_deltas) and r.n_bytes == len(r.text.encode())
        cut = library.encode(r.text[:r.chars_within_100], add_special_tokens=False).ids
        assert len(cut) == min(100, len(ids)) or len(cut) in (99, 100)


def test_a_long_piece_without_breaks():
    count, library = PrefixCounter(PATH), Tokenizer.from_file(PATH)
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))
    assert total(count.deltas(text)) == len(library.encode(text, add_special_tokens=False).ids)


def test_longest_rise_is_longest():
    rng = random.Random(5)
    for _ in range(200):
        values = rng.sample(range(50), rng.randrange(9))
        kept = [values[i] for i in longest_rise(values)]
        assert kept == sorted(kept)
        assert len(kept) == max(k for k in range(len(values) + 1)
                                for c in combinations(values, k) if list(c) == sorted(c))


def test_alignment_pairs_equal_words_in_order():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        pairs = patience_pairs(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
    words = words_of(TEMPLATES["MIT"])
    assert len(patience_pairs(words, words)) == len(words)


def test_licenses_in_documents(spark):
    mit = TEMPLATES["MIT"].split()
    broken = " ".join(mit[:20] + ["odd", "insert"] + mit[20:70] + mit[74:])
    rows = [(1, "Intro. " + TEMPLATES["MIT"] + " More text.", "MIT"), (2, broken.upper(), "MIT"),
            (3, " ".join(mit[:30]), None), (4, "some license text of the software", None),
            (5, "x. Released under the MIT License.", "MIT-notice"), (6, None, None),
            (7, TEMPLATES["Apache-2.0"], "Apache-2.0")]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert {i: r.license for i, r in got.items()} == {i: want for i, _, want in rows}
    assert got[1].coverage == 1.0 and 0.9 < got[2].coverage < 1.0
    assert (got[1].first_word, got[1].last_word) == (1, len(words_of(TEMPLATES["MIT"])))
    assert "Apache-2.0-notice" in got[7].licenses


def test_a_hidden_notice_is_found_by_every_window():
    rng = random.Random(9)
    notice = words_of(TEMPLATES["GPL-3.0-notice"])
    for _ in range(50):
        noise = [rng.choice(["this", "the", "work", "x", "y", "license"]) for _ in range(200)]
        at = rng.randrange(200)
        cover, first, last = best_coverage(noise[:at] + ["z"] * 9 + notice + ["z"] * 9 + noise[at:], notice)
        assert cover >= 0.8
