"""Token counts at every prefix of a text, for a byte-level BPE vocabulary.

The encoding of a prefix ends in exactly one token that may follow the encoding of what stands
before it. So one pass over a piece of text finds, for each end, that last token and thereby the
count: ``count[end] = count[end - len(token)] + 1``. Whether two tokens may stand side by side is
settled by merging their bytes once; the answers are remembered.

What is stored per text is the change of the count from each prefix to the next, one signed byte
per character. Sums of it answer "how many tokens do the first k characters have" and "how many
characters fit into a budget" without encoding anything again. The counts are those the library
gives for the prefix as a text of its own: a trailing run of white space is one piece, half a
contraction is two, half a special string is ordinary text, a whole one is one token.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .rows import append, bounded_batches, schema_of, without

#: The split of the byte-level vocabularies and their longer contractions.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
          r"|\s+(?!\S)|\s+")
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")

BLANKS = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))

#: Pieces and token pairs remembered per worker; beyond that memory starts afresh.
REMEMBERED = 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """A dictionary that makes what it misses."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        self[key] = made = self.make(key)
        return made


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = {raw(t) for t in spec["model"]["vocab"] if t not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocabulary))
        self.beside = Remembered(lambda pair: self.merged(b"".join(pair)) == list(pair))
        self.alone = Remembered(lambda token: self.merged(token) == [token])
        self.pieces = regex.compile(PIECES)
        self.deltas_of = Remembered(self.piece_deltas)
        self.split_at = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of a few bytes, by merging the pair of lowest rank until none is left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def prefix_counts(self, data: bytes) -> list[int]:
        """Token count of ``data[:end]`` for every end, as one piece."""
        counts, last = [0], [b""]
        vocabulary, beside, alone = self.vocabulary, self.beside, self.alone
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = data[start:end]
                if token in vocabulary and (
                        beside[last[start], token] if start else alone[token]):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary does not hold every byte")
        return counts

    def piece_deltas(self, piece: str) -> bytes:
        data = piece.encode()
        counts = self.prefix_counts(data)
        if piece in LONG_CONTRACTIONS:
            counts[2] = 2
        if len(data) != len(piece):
            ends = [i for i in range(1, len(data) + 1)
                    if i == len(data) or data[i] & 0xC0 != 0x80]
            counts = [0, *(counts[i] for i in ends)]
        return bytes((b - a) & 255 for a, b in zip(counts, counts[1:]))

    def plain_deltas(self, text: str) -> bytes:
        pieces = self.pieces.findall(text)
        deltas = list(map(self.deltas_of.__getitem__, pieces))
        # The last character of a run of white space is split off, alone or with the word after
        # it; in a prefix that ends there, the run is still one piece.
        for i in range(1, len(pieces)):
            if pieces[i][0] in BLANKS and pieces[i - 1][-1] in BLANKS:
                step = (total(self.deltas_of[pieces[i - 1] + pieces[i][0]])
                        - total(self.deltas_of[pieces[i - 1]]))
                owed = signed(deltas[i][0]) - step
                deltas[i] = bytes([step & 255]) + deltas[i][1:]
                at, inside = (i, 1) if len(deltas[i]) > 1 else (i + 1, 0)
                changed = bytearray(deltas[at])
                changed[inside] = (changed[inside] + owed) & 255
                deltas[at] = bytes(changed)
        return b"".join(deltas)

    def deltas(self, text: str) -> bytes:
        """One signed byte per character: the count's change from prefix to prefix."""
        out, at = [], 0
        for hit in self.split_at.finditer(text):
            open_end = self.plain_deltas(text[at:hit.end() - 1])
            before = total(open_end[:hit.start() - at])
            out += [open_end, bytes([(before + 1 - total(open_end)) & 255])]
            at = hit.end()
        out.append(self.plain_deltas(text[at:]))
        return b"".join(out)

    def forget(self) -> None:
        for memory in (self.deltas_of, self.beside):
            if len(memory) > REMEMBERED:
                memory.clear()


def signed(byte: int) -> int:
    return byte - 256 if byte > 127 else byte


def total(deltas: bytes) -> int:
    return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))


def tokens_of_prefix(deltas: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters."""
    return total(deltas[:max(0, n_chars)])


def chars_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    counts = np.frombuffer(deltas, np.int8).cumsum(dtype=np.int64)
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) and budget >= 0 else 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_token_counts(docs: DataFrame, vocabulary: str, budgets: tuple[int, ...] = (),
                        text: str = "text", keep_prefixes: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens``, ``chars_within_<budget>`` and ``token_deltas``.

    ``vocabulary`` is the path of a byte-level BPE file in JSON, readable on every executor.
    ``token_deltas`` (left out if ``keep_prefixes`` is false) is what :func:`tokens_of_prefix` and
    :func:`chars_within` read. Columns of ``docs`` with these names are replaced.

    A null or empty text has no bytes, no tokens and empty deltas. Rows are handled one by one,
    so repeated rows repeat. A text is worked on whole, whatever its length; one needs a few times
    its size in memory. An empty table gives an empty one.
    """
    made = {"n_bytes": "long", "n_tokens": "long"}
    made |= {f"chars_within_{b}": "long" for b in budgets}
    made |= {"token_deltas": "binary"} if keep_prefixes else {}
    keep = without(docs, list(made))
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)

    def run(batches):
        count = counter(vocabulary)
        for batch in bounded_batches(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            deltas = [count.deltas(t) if t else b"" for t in texts]
            columns = {
                "n_bytes": pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                "n_tokens": pa.array([total(d) for d in deltas], pa.int64())}
            for b in budgets:
                columns[f"chars_within_{b}"] = pa.array(
                    [chars_within(d, b) for d in deltas], pa.int64())
            if keep_prefixes:
                columns["token_deltas"] = pa.array(deltas, pa.binary())
            count.forget()
            yield append(batch, keep, columns)

    ddl = ", ".join(f"{k} {v}" for k, v in made.items())
    return source.mapInArrow(run, schema_of(source, keep, ddl))
