"""Byte-level BPE encoding by a distinct-word table, and decoding by an id-to-piece join.

1. **Words.** A text is cut before each run of ASCII white space that follows something else. The
   vocabulary's own splitting never crosses such a cut, so words can be encoded apart.
2. **Pages.** Documents are taken in pages of bounded size. A page lists its distinct words from
   frequent to rare and replaces each word of a text by its place in that list.
3. **Encoding.** The lists are dealt by a hash of the word; a word that occurs everywhere arrives
   once per page, and is encoded once where its bucket meets.
4. **Joining back.** The ids return to their page, where places become ids.

Texts never move: a page's places and the ids of its words do. Decoding joins ids with the pieces
of the vocabulary, a table of fixed size that is laid out by id.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from .rows import bounded_batches, schema_of, without
from .token_counts import byte_letters

#: Bytes of text in a page; one long document may exceed it.
PAGE_BYTES = 8 << 20
#: Bytes of ids that decoding works on at a time.
IDS_BYTES = 4 << 20
#: Words a task remembers per bucket; beyond that memory starts afresh and some are encoded again.
REMEMBERED = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The last two bytes of white space beyond ASCII; a cut after it would not be one.
_WIDE_SPACE = np.array([0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF,
                        0x819F], np.uint16)
_CODEC = pa.Codec("zstd", compression_level=1)


def packed(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True) if raw else b""


def unpacked(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return _CODEC.decompress(blob[8:], decompressed_size=size, asbytes=True) if blob else b""


def varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, low ones first; the eighth says that more follow."""
    values = values.astype(np.uint32)
    width = np.ones(len(values), np.int8)
    for s in (7, 14, 21, 28):
        width += values >= 1 << s
    ends = np.cumsum(width, dtype=np.int32)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        more = np.flatnonzero(width > k)
        low = (values[more] >> np.uint32(7 * k) & np.uint32(127)).astype(np.uint8)
        low[width[more] > k + 1] |= 128
        out[ends[more] - width[more] + k] = low
    return out.tobytes()


def from_varints(blob: bytes) -> np.ndarray:
    at = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(at < 128).astype(np.int32)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int32) if len(ends) else ends
    out = (at[starts] & 127).astype(np.int32)
    more, width = np.flatnonzero(ends > starts), 1
    while len(more):
        out[more] |= (at[starts[more] + width] & 127).astype(np.int32) << (7 * width)
        width += 1
        more = more[ends[more] - starts[more] >= width]
    return out


def word_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where words start in the bytes of texts that stand one after the other."""
    cut = _SPACE[data]
    cut[1:] &= ~cut[:-1]
    cut[:1] = False
    wide = np.flatnonzero(cut[2:] & (data[1:-1] >= 0x80)) + 2
    before = data[wide - 2].astype(np.uint16) << 8 | data[wide - 1]
    cut[wide[np.isin(before, _WIDE_SPACE)]] = False
    cut[text_starts[text_starts < len(data)]] = True
    return np.flatnonzero(cut)


def bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """A hash of each word, as sums of its bytes times powers of an odd number."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    odd, h = np.uint64(0x9E3779B97F4A7C15), lengths.astype(np.uint64)
    # Nearly all words are short: one step per place of a byte, for those that have it.
    rest = np.flatnonzero(lengths > 0)
    for k in range(int(min(lengths.max(initial=0), 64))):
        rest = rest[lengths[rest] > k]
        h[rest] = (h[rest] ^ data[offsets[rest] + k]) * odd
        h[rest] ^= h[rest] >> np.uint64(29)
    return (h % np.uint64(buckets)).astype(np.int64)


@lru_cache(maxsize=2)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def pieces_by_id(path: str) -> pa.Array:
    """All pieces, laid out by id and an empty one behind them; unused ids have no bytes."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    pieces = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()
              if all(c in letters for c in t)}
    pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return pa.array([pieces.get(i, b"") for i in range(max(pieces) + 2)], pa.binary())


def check_vocabulary(path: str) -> None:
    """Whether words can be encoded apart, which holds for plain byte-level BPE files."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec["pre_tokenizer"] or {}
    whole = all(not any(map(str.isspace, t["content"])) and not t["lstrip"] and not t["rstrip"]
                and not t["single_word"] for t in spec["added_tokens"])
    if (spec["normalizer"] is not None or split.get("type") != "ByteLevel" or not whole
            or not split.get("use_regex", True) or split.get("add_prefix_space")):
        raise ValueError("a byte-level BPE without normalizer and prefix space is needed")


def _pages(docs: DataFrame, kept: list[str], text: str, buckets: int) -> DataFrame:
    """Rows of pages: bucket -1 holds the texts as places, the others lists of words.

    Equal texts of a page are one text with several rows.
    """
    kinds = dict(docs.dtypes)
    row = ", ".join(f"`{k}`: {kinds[k]}" for k in kept)
    source = docs.select(F.col(text).alias("t"), F.struct(*(F.col(f"`{k}`") for k in kept)).alias("row"))

    def run(batches):
        for batch in bounded_batches(batches, PAGE_BYTES):
            if not batch.num_rows:
                continue
            texts = pc.fill_null(batch.column(0), "").cast(pa.large_string()).dictionary_encode()
            owner = texts.indices.to_numpy()
            texts = texts.dictionary
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:offsets[-1]]
            page = blake2b(digest_size=16)
            for part in (data, offsets, np.ascontiguousarray(owner)):
                page.update(memoryview(part).cast("B"))
            for r in batch.column(1).to_pylist():
                page.update(repr(r).encode("utf-8", "surrogatepass"))
            page = page.digest()
            starts = word_starts(data, offsets[:-1]) if len(data) else np.empty(0, np.int64)
            ends = np.append(starts, len(data)).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            coded = words.dictionary_encode()
            places, known = coded.indices.to_numpy(), coded.dictionary
            order = np.argsort(-np.bincount(places, minlength=len(known)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            known = known.take(pa.array(order))
            bucket = bucket_of(known, buckets)
            counts = np.diff(np.append(np.searchsorted(starts, offsets[:-1]), len(starts)))
            by_text = np.argsort(owner, kind="stable")
            rows = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner[by_text], np.arange(len(texts) + 1)), pa.int32()),
                batch.column(1).take(pa.array(by_text)))
            # Lists of rows by text, one list for the page: counts say where texts end.
            copies = np.diff(rows.offsets.to_numpy())
            whole = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), rows.values)
            yield pa.RecordBatch.from_arrays([
                pa.array([page], pa.binary()), pa.array([-1], pa.int32()),
                pa.array([packed(varints(rank[places]))], pa.binary()),
                pa.array([packed(bucket.astype(np.uint32))], pa.binary()),
                pa.array([np.stack([counts, copies], 1).ravel()], pa.list_(pa.int64())),
                whole], names=["page", "bucket", "payload", "buckets", "counts", "rows"])
            dealt = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[dealt], return_index=True)
            known = known.take(pa.array(dealt))
            at = np.frombuffer(known.buffers()[1], np.int64)[:len(known) + 1]
            raw = np.frombuffer(known.buffers()[2] or b"", np.uint8)
            first = np.append(first, len(known))
            lists = [(packed(raw[at[a]:at[b]]), packed(np.diff(at[a:b + 1]).astype(np.uint32)))
                     for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array([page] * len(used), pa.binary()), pa.array(used, pa.int32()),
                pa.array([p for p, _ in lists], pa.binary()),
                pa.array([n for _, n in lists], pa.binary()),
                pa.nulls(len(used), pa.list_(pa.int64())), pa.nulls(len(used), whole.type)],
                names=["page", "bucket", "payload", "buckets", "counts", "rows"])

    return source.mapInArrow(run, "page binary, bucket int, payload binary, buckets binary, "
                                  f"counts array<bigint>, rows array<struct<{row}>>")


def _encoded_words(lists: DataFrame, vocabulary: str) -> DataFrame:
    """The ids of each list's words; within a bucket every distinct word is encoded once."""
    def run(batches):
        encode, bucket, known = library(vocabulary), None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                page, b, payload, lengths = (c[i].as_py() for c in batch.columns)
                if b != bucket or len(known) > REMEMBERED:
                    bucket, known = b, {}
                data = unpacked(payload)
                ends = np.cumsum(np.frombuffer(unpacked(lengths), np.uint32), dtype=np.int64).tolist()
                words = [data[i:j] for i, j in zip([0, *ends], ends)]
                fresh = [w for w in words if w not in known]
                for w, e in zip(fresh, encode.encode_batch_fast(
                        [w.decode() for w in fresh], add_special_tokens=False)):
                    known[w] = np.array(e.ids, np.uint32).tobytes()
                ids = [known[w] for w in words]
                yield pa.RecordBatch.from_pydict({
                    "page": pa.array([page], pa.binary()), "bucket": pa.array([b], pa.int32()),
                    "payload": pa.array([packed(b"".join(ids))], pa.binary()),
                    "buckets": pa.array([packed(np.array([len(i) // 4 for i in ids], np.uint32))],
                                        pa.binary())})

    dealt = (lists.select("page", "bucket", "payload", "buckets")
             .repartition("bucket").sortWithinPartitions("bucket"))
    return dealt.mapInArrow(run, "page binary, bucket int, payload binary, buckets binary")


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids",
           buckets: int | None = None, repeatable: bool = False, after=None) -> DataFrame:
    """``docs`` without ``text``, with the column ``ids`` (array<int>).

    Ids are those that the tokenizers library gives for the whole text without added special
    tokens, truncation or padding; strings of special tokens in a text become that token.
    ``vocabulary`` is the path of a byte-level BPE file in JSON, readable on every executor.
    ``buckets`` is into how many parts the distinct words are dealt, at first the session's number
    of shuffle partitions; a task holds the distinct words of one.

    Pages are cut twice, once for the words and once for the texts. Both times must see the rows
    in the same order, as scans of tables do; ``repeatable`` says that this is so. Otherwise pages
    are written to the shared folder first.

    ``after``, a pair of a function and the DDL of the columns it adds, goes on with the ids where
    they are made: it gets an iterator of (Arrow batch of the other columns, list array of ids)
    and yields such batches with its columns. The ids are then not returned.

    A null or empty text has no ids. A text is worked on whole and needs a few times its size in
    memory. Repeated rows stay, a column of ``docs`` named as ``ids`` is replaced, all others are
    carried along whatever they are named. An empty table gives an empty one.
    """
    check_vocabulary(vocabulary)
    kept = without(docs, [text, ids])
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(docs.dtypes)
    # A struct needs a field even where only the text is given.
    marked = docs if kept else docs.withColumn("_", F.lit(True))
    fields = kept or ["_"]
    pages = _pages(marked, fields, text, buckets)
    pages = pages if repeatable else materialise(pages, "pages")
    words = _encoded_words(pages.filter("bucket >= 0"), vocabulary)
    joined = (pages.filter("bucket < 0")
              .unionByName(words, allowMissingColumns=True)
              .repartition("page").sortWithinPartitions("page", "bucket"))

    def finished(texts: dict, lists: list[tuple[bytes, bytes]]):
        lengths = np.frombuffer(b"".join(unpacked(n) for _, n in lists), np.uint32).astype(np.int64)
        values = np.frombuffer(b"".join(unpacked(v) for v, _ in lists), np.int32)
        bucket = np.frombuffer(unpacked(texts["buckets"]), np.uint32)
        if len(lengths) != len(bucket):
            raise RuntimeError("pages differ between two passes: the input is not repeatable")
        # Lists stand by bucket, and within one in the page's order.
        order = np.argsort(bucket, kind="stable")
        ends = np.concatenate([[0], np.cumsum(lengths)])
        begin, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        begin[order], size[order] = ends[:-1], lengths
        places = from_varints(unpacked(texts["payload"]))
        counts, copies = np.array(texts["counts"], np.int64).reshape(-1, 2).T
        row, done = 0, 0
        for n, several in zip(counts.tolist(), copies.tolist()):
            at = places[done:done + n]
            done += n
            long, upto = size[at], np.cumsum(size[at])
            out = values[np.arange(upto[-1] if n else 0) + np.repeat(begin[at] - (upto - long), long)]
            yield row, several, out
            row += several

    def done(batches):
        texts, lists = None, []

        def pages_done():
            most, held, first, offsets, parts = IDS_BYTES // 4, 0, 0, [0], []
            rows = texts["rows"]
            for row, several, out in finished(texts, lists):
                for _ in range(several):
                    parts.append(out)
                    held += len(out)
                    offsets.append(held)
                    if held > most:
                        yield batch_of(rows.slice(first, len(parts)), offsets, parts)
                        first, held, offsets, parts = first + len(parts), 0, [0], []
            if parts:
                yield batch_of(rows.slice(first, len(parts)), offsets, parts)

        for batch in batches:
            for i in range(batch.num_rows):
                page, b, payload, numbers = (batch.column(k)[i].as_py() for k in range(4))
                if b < 0:
                    if texts:
                        yield from pages_done()
                    texts = {"page": page, "payload": payload, "buckets": numbers,
                             "counts": batch.column(4)[i].as_py(), "rows": batch.column(5)[i].values}
                    lists = []
                else:
                    if not texts or texts["page"] != page:
                        raise RuntimeError("pages differ between two passes: the input is not repeatable")
                    lists.append((payload, numbers))
        if texts:
            yield from pages_done()

    def batch_of(rows, offsets, parts):
        made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                        pa.array(np.concatenate(parts), pa.int32()))
        return pa.RecordBatch.from_arrays([rows.field(k) for k in range(len(fields))],
                                          names=fields), made

    go_on, added = after or (None, f"`{ids}` array<int>")

    def run(batches):
        if go_on:
            yield from go_on(done(batches))
        else:
            for batch, made in done(batches):
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*fields, ids])

    made = joined.mapInArrow(run, ", ".join([*(f"`{k}` {kinds.get(k, 'boolean')}" for k in fields), added]))
    return made.select(*(f"`{c}`" for c in made.columns if c in kept or c not in fields))


def texts_of(lists: pa.Array, vocabulary: str):
    """Yield the text of each list of ids: the ids joined with the pieces, laid out by id."""
    pieces = pieces_by_id(vocabulary)
    none = len(pieces) - 1
    flat = pc.fill_null(lists.flatten(), none).to_numpy()
    flat = np.where((flat < 0) | (flat > none), none, flat)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    joined = pieces.take(pa.array(flat, pa.int32()))
    data = memoryview(joined.buffers()[2] or b"")
    cuts = np.frombuffer(joined.buffers()[1], np.int32)[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    for i, j in zip(cuts, cuts[1:]):
        yield str(data[i:j], "utf-8", "replace")


def decode(frame: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``frame`` with the column ``text``: the pieces of its ids, special ones included.

    Ids that the vocabulary does not hold, and null ones, stand for nothing. Bytes that are no
    UTF-8 become replacement characters. Null or empty ids give an empty text. Rows are handled
    one by one; other columns stay, and one named as ``text`` is replaced.
    """
    keep = without(frame, [text])

    def run(batches):
        for batch in bounded_batches(batches, IDS_BYTES):
            lists = batch.column(batch.schema.get_field_index(ids))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(k)) for k in keep),
                 pa.array(texts_of(lists, vocabulary), pa.string())], names=[*keep, text])

    return frame.mapInArrow(run, schema_of(frame, keep, f"`{text}` string"))


def digests(vocabulary: str):
    """For ``after`` of :func:`encode`: the number of ids, the SHA-256 of them as unsigned 32-bit
    little-endian integers, and that of the text they decode to in UTF-8."""
    def go_on(batches):
        for batch, lists in batches:
            raw = memoryview(lists.flatten().to_numpy()).cast("B")
            ends = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists.value_lengths().cast(pa.int64()),
                 pa.array([sha256(raw[i:j]).hexdigest() for i, j in zip(ends, ends[1:])], pa.string()),
                 pa.array([sha256(t.encode()).hexdigest() for t in texts_of(lists, vocabulary)],
                          pa.string())],
                names=[*batch.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return go_on, "n_tokens long, ids_sha256 string, decoded_sha256 string"
