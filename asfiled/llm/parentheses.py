"""Balanced parentheses of a tree: one opens when a node begins, its partner closes it.

The excess at a position is how many are open behind it. It is kept with the least excess of every
block and, pair by pair, of ever larger runs of blocks, so that the partner of an opening one, the
first place after it with less excess, is found by climbing and descending the minima.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64
_QUERIES = 1 << 14


class Parentheses:
    def __init__(self, opening: np.ndarray):
        self.opening = opening.astype(bool)
        self.opened = np.concatenate([[0], np.cumsum(self.opening)])
        excess = np.cumsum(np.where(self.opening, 1, -1))
        leaf = self.opening.copy()
        leaf[:-1] &= ~self.opening[1:]
        self.leaf_rank = np.concatenate([[0], np.cumsum(leaf)])
        self.excess = excess
        blocks = np.full(-(-len(excess) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        blocks[:len(excess)] = excess
        self.blocks = blocks.reshape(-1, BLOCK)
        self.minima = [self.blocks.min(axis=1)]
        while len(self.minima[-1]) > 1:
            below = self.minima[-1]
            if len(below) % 2:
                below = np.append(below, np.iinfo(np.int64).max)
            self.minima.append(np.minimum(below[::2], below[1::2]))

    def positions(self) -> np.ndarray:
        """Where nodes open, in preorder."""
        return np.flatnonzero(self.opening)

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The partner of each opening parenthesis."""
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), _QUERIES):
            out[i:i + _QUERIES] = self._find_close(at[i:i + _QUERIES])
        return out

    def _find_close(self, at: np.ndarray) -> np.ndarray:
        goal, block = self.excess[at] - 1, at // BLOCK
        inside = (self.blocks[block] <= goal[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        beyond = np.flatnonzero(~inside.any(axis=1))
        block[beyond] = self._next_block(block[beyond], goal[beyond])
        inside[beyond] = self.blocks[block[beyond]] <= goal[beyond, None]
        return block * BLOCK + inside.argmax(axis=1)

    def _next_block(self, block: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first block behind ``block`` whose least excess is at most ``goal``."""
        out, todo, node = block.copy(), np.arange(len(block)), block.copy()
        for level, least in enumerate(self.minima):
            if not len(todo):
                break
            right = np.minimum(node + 1, len(least) - 1)
            hit = (node % 2 == 0) & (node + 1 < len(least)) & (least[right] <= goal[todo])
            found, spot = todo[hit], node[hit] + 1
            for below in self.minima[:level][::-1]:
                spot = 2 * spot
                spot += below[spot] > goal[found]
            out[found] = spot
            todo, node = todo[~hit], node[~hit] // 2
        return out

    def nodes_before(self, at: np.ndarray) -> np.ndarray:
        return self.opened[at]

    def leaves_between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Childless nodes that open at ``first`` or later and before ``last``."""
        return self.leaf_rank[last] - self.leaf_rank[first]


class RangeMinimum:
    """Least value of a slice of an array, from minima over runs of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            below, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp((end - first).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            run = self.levels[k]
            out[at] = np.minimum(run[first[at]], run[end[at] - (1 << int(k))])
        return out
