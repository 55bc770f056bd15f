"""Distinct word shingles of a text as 56-bit hashes, in numpy on its bytes.

Nothing here makes a Python object per word. With ``T`` a random number per byte value and ``K``
an odd number, the bytes of a text are summed up as ``T[byte] * K**position`` modulo 2**64; the
difference of two such sums, shifted back to position zero, hashes the word between them.
"""

from __future__ import annotations

import numpy as np

#: Lower case for A-Z, as a table over bytes.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 1 for bytes of words, 0 for ASCII white space, as a table over bytes.
_INSIDE = bytes(b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256))

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_K = int(_rng.integers(0, 1 << 64, dtype=np.uint64)) | 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; any bit of the input touches all bits of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of a number modulo 2**64, as many as the longest text so far has needed."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = self.known[-1:] * self.base
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


_UP, _BACK = _Powers(_K), _Powers(pow(_K, -1, 1 << 64))


def word_hashes(data: bytes, inside: np.ndarray | None = None) -> np.ndarray:
    """A hash for each word; words are runs of anything but ASCII white space, or of the byte
    values that the table ``inside`` marks."""
    return _words(data, inside)[0]


def _words(data: bytes, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and where it starts."""
    at = np.frombuffer(data, np.uint8)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    member = np.zeros(len(at) + 2, bool)
    member[1:-1] = np.frombuffer(
        data.translate(_INSIDE if inside is None else inside.astype(bool).tobytes()), bool)
    edges = np.flatnonzero(member[1:] != member[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(at) + 1, np.uint64)
    scaled = _BYTE.take(at)
    scaled *= _UP.upto(len(at))
    np.cumsum(scaled, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _BACK.upto(len(at))[starts]), starts


def words_of_texts(texts: list[str | None], most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, A-Z lower-cased, and the number
    of words of each. Hashes do not depend on the place, so short texts are hashed together, in
    joined runs of about ``most`` bytes that stay in the cache."""
    parts, sizes, held, length = [], [], [], 0

    def told():
        hashes, starts = _words(b" ".join(held).translate(LOWER_BYTES))
        ends = np.cumsum([len(t) + 1 for t in held])
        parts.append(hashes)
        sizes.append(np.diff(np.searchsorted(starts, ends), prepend=0))

    for text in texts:
        held.append(text.encode() if text else b"")
        length += len(held[-1])
        if length >= most:
            told()
            held, length = [], 0
    if held:
        told()
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(parts), np.concatenate(sizes)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer than ``size`` words has one, without words none."""
    hashes = word_hashes(text.encode().translate(LOWER_BYTES)) if text else ()
    if not len(hashes):
        return np.empty(0, np.uint64)
    width = min(size, len(hashes))
    rolled = np.full(len(hashes) - width + 1, np.uint64(width))
    for i in range(width):
        rolled = rolled * _ODD + hashes[i:len(hashes) - width + 1 + i]
    return np.unique(mixed(rolled) >> np.uint64(8))
