"""Signature trees: which pairs of token sets can overlap enough, from bitmaps and sizes alone.

A leaf is one set: a bitmap of its tokens' hashes and its size. A node above holds the OR of its
children's bitmaps and the range of their sizes. Two sets below nodes x and y share at most

    popcount(bits_x & bits_y) + min(slack_x, slack_y)

tokens, where the slack of a node is the largest number of tokens by which a set below it exceeds
the bits it sets. Where that is less than what the similarity asks of the smallest sizes, or the
sizes are too far apart, no pair below can qualify and the traversal of both trees stops there.
It also stops where everything below belongs to one known component.
"""

from __future__ import annotations

import math

import numpy as np

FAN = 4
_FRONTIER_BYTES = 32 << 20


def size_class(n: int, percent: int) -> int:
    """Sizes of similar sets lie in the same class or in neighbouring ones."""
    return int(math.log(max(n, 1)) / math.log(101 / percent))


def bitmap_bytes(a_class: int, percent: int) -> int:
    """At least four bits for each token of a set of that class; a power of two, 8 at least."""
    return 8 * 2 ** max(0, math.ceil(math.log2(4 * (101 / percent) ** (a_class + 1) / 64)))


def bitmap(tokens: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width * 8, bool)
    bits[(tokens & np.uint64(width * 8 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """The bitmap that the tokens would have with ``width`` bytes, no more than it has."""
    out = np.frombuffer(bits, np.uint8).reshape(-1, width)
    return np.bitwise_or.reduce(out, axis=0)


def least_overlap(sizes, percent: int):
    """Fewest common tokens of two sets of ``sizes`` tokens in all that are similar enough."""
    return -(-percent * sizes // (100 + percent))


def may_link(bits_a: bytes, n_a: int, bits_b: bytes, n_b: int, percent: int) -> bool:
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    width = min(len(bits_a), len(bits_b))
    a, b = folded(bits_a, width), folded(bits_b, width)
    common = int(np.bitwise_count(a & b).sum())
    slack = min(n_a - int(np.bitwise_count(a).sum()), n_b - int(np.bitwise_count(b).sum()))
    return common + slack >= least_overlap(n_a + n_b, percent)


class SignatureTree:
    """Leaves stay in the given order, which should put similar sets side by side."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        bits = np.ascontiguousarray(bits).view(np.uint64)
        slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, slack, group, group)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._above(*self.levels[-1]))

    @staticmethod
    def _above(bits, low, high, slack, first, last):
        starts = np.arange(0, len(bits), FAN)
        return (np.bitwise_or.reduceat(bits, starts, axis=0), np.minimum.reduceat(low, starts),
                np.maximum.reduceat(high, starts), np.maximum.reduceat(slack, starts),
                np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts))

    def __len__(self) -> int:
        return len(self.levels[0][0])


def _possible(x, i, y, j, percent: int) -> np.ndarray:
    (bits_x, low_x, high_x, slack_x, first_x, last_x) = (part[i] for part in x)
    (bits_y, low_y, high_y, slack_y, first_y, last_y) = (part[j] for part in y)
    common = np.bitwise_count(bits_x & bits_y).sum(axis=1, dtype=np.int64)
    enough = common + np.minimum(slack_x, slack_y) >= least_overlap(low_x + low_y, percent)
    near = (100 * high_x >= percent * low_y) & (100 * high_y >= percent * low_x)
    joined = (first_x == last_x) & (first_y == last_y) & (first_x == first_y)
    return enough & near & ~joined


def _below(tree: SignatureTree, level: int, nodes: np.ndarray):
    """First child and number of children; above its root a tree is its root."""
    if level >= len(tree.levels):
        return nodes, np.ones_like(nodes)
    first = nodes * FAN
    return first, np.minimum(FAN, len(tree.levels[level - 1][0]) - first)


def dual_traversal(x: SignatureTree, y: SignatureTree, percent: int):
    """Yield arrays (i, j) of leaves that may be similar; ``y is x`` gives each pair once, i < j."""
    if not len(x) or not len(y):
        return
    level = max(len(x.levels), len(y.levels)) - 1
    step = max(1, _FRONTIER_BYTES // (x.levels[0][0].shape[1] * 8))
    todo = [(level, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > step:
            todo += [(level, i[step:], j[step:]), (level, i[:step], j[:step])]
            continue
        at_x, at_y = (t.levels[min(level, len(t.levels) - 1)] for t in (x, y))
        hold = _possible(at_x, i, at_y, j, percent)
        i, j = i[hold], j[hold]
        if level == 0:
            if x is y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        (from_i, many_i), (from_j, many_j) = _below(x, level, i), _below(y, level, j)
        pairs = many_i * many_j
        nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = np.repeat(many_j, pairs)
        i, j = np.repeat(from_i, pairs) + nth // wide, np.repeat(from_j, pairs) + nth % wide
        if x is y:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            todo.append((level - 1, i, j))
