"""BPE by a distinct-word table: against the tokenizers library, and back to the text."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from asfiled.llm import bpe_codec as codec

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "'re", "'ll", "don't", "é", "ñ", "日本", "😀", "!", "23",
         "<|endoftext|>", "<|end", "oftext|>", "\xa0", "　", "The ", "unbelievable", "=====",
         "    ", "\r\n", "\x1c", "²", "Ⅷ", "\x85", " ", " ", "\x00", "—"]


def ids_of(text):
    return tuple(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark):
    rng, library = random.Random(3), Tokenizer.from_file(PATH)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    rows += [(None, None), (-1, None), (-2, ""), (7, "x" * 50_000), (8, "a b " * 1000)]
    rows += [(9, "the same text")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, tuple(r.ids), r.back) for r in
                  codec.decode(codec.encode(df, PATH), PATH, text="back").collect())
    assert got == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "")
                          for i, t in rows)


def test_words_cover_the_text_and_encode_apart():
    rng, library = random.Random(4), Tokenizer.from_file(PATH)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 20)))
        raw = text.encode()
        starts = codec.word_starts(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64)).tolist()
        words = [raw[i:j].decode() for i, j in zip(starts, [*starts[1:], len(raw)])]
        assert "".join(words) == text
        apart = [i for w in words for i in library.encode(w, add_special_tokens=False).ids]
        assert apart == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"every row says w{i % 7} again") for i in range(500)],
                                 "doc_id long, text string").repartition(6)
    pages = codec._pages(docs, ["doc_id"], "text", 4).filter("bucket >= 0").collect()
    words = Counter()
    for r in pages:
        data = codec.unpacked(r.payload)
        ends = np.cumsum(np.frombuffer(codec.unpacked(r.buckets), np.uint32)).tolist()
        words.update((r.bucket, data[i:j]) for i, j in zip([0, *ends], ends))
    # A word arrives once per page and always in the same bucket.
    assert max(words.values()) <= 6 and len(words) == len({w for _, w in words}) == 11


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = rng.integers(0, 1 << rng.integers(1, 32, n), n)
        assert codec.from_varints(codec.unpacked(codec.packed(codec.varints(values)))).tolist() \
            == values.tolist()


def test_odd_rows_clashing_names_and_none(spark, odd, none):
    want = {r.doc_id: ids_of(r.text) for r in odd.collect()}
    for name in ("page", "bucket", "payload", "rows", "row", "t", "IDS", "_"):
        odd = odd.withColumn(name, F.lit("own"))
    got = codec.encode(odd, PATH)
    assert got.columns == [c for c in odd.columns if c not in ("text", "IDS")] + ["ids"]
    rows = got.collect()
    assert len(rows) == 15 and all(r.page == r.rows == r.t == r._1 == "own" if hasattr(r, "_1") else
                                   r.page == r.rows == r.t == "own" for r in rows)
    assert all(tuple(r.ids) == want[r.doc_id] for r in rows if r.doc_id is not None and r.doc_id != 1)
    assert codec.encode(none, PATH).collect() == []
    assert codec.decode(codec.encode(none, PATH), PATH).collect() == []
    alone = codec.encode(odd.select("text"), PATH)
    assert alone.columns == ["ids"] and alone.count() == 15


def test_decode_of_ids_from_elsewhere(spark):
    rows = [([15496, None, -5, 99_999_999, 995],), ([],), (None,), ([50256],), ([447],)]
    df = spark.createDataFrame(rows, "ids array<int>")
    texts = [r.text for r in codec.decode(df, PATH).collect()]
    assert texts == ["Hello world", "", "", "<|endoftext|>", Tokenizer.from_file(PATH).decode([447])]


def test_another_kind_of_vocabulary_is_refused(spark):
    with pytest.raises(ValueError):
        codec.encode(spark.createDataFrame([("a",)], "text string"),
                     public_tokenizers.path("word_bpe_49k.json"))


def test_query_over_whole_documents(spark):
    from hashlib import sha256

    from asfiled.llm.registry import QUERIES
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in QUERIES["op11_bpe_codec"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
