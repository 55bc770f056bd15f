"""Metric trees by the anchors hierarchy, and exact nearest-entry assignment with them.

A tree is built from the middle out: about sqrt(n) anchors take the points nearest to them, the
two balls whose union is smallest are joined until one is left, and the points below each anchor
are treated alike. Points lie in the order of the leaves, so a ball is a range of them, and its
count and sum come from running sums.

A traversal hands each ball a list of entries that may be nearest to a point in it. An entry goes
when the one nearest to the ball's middle is nearer for every point of the ball; children inherit
what is left. A ball with one entry left is owned by it whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 24
#: Rounding errors of the distances that prune stay far below this share of them.
_SLACK = 1e-9


@dataclass
class BallTree:
    points: np.ndarray   # distinct points in the order of the leaves, int64
    weight: np.ndarray   # how many rows have the point
    place: np.ndarray    # for each row, its point
    start: np.ndarray    # for each ball, its range of points
    end: np.ndarray
    left: np.ndarray     # its children, -1 for a leaf
    right: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    count: np.ndarray    # rows below
    total: np.ndarray    # componentwise sum over rows below

    def pack(self) -> list[bytes]:
        return [a.tobytes() for a in (self.points, self.weight, self.place, self.start, self.end,
                                      self.left, self.right)]

    @classmethod
    def unpack(cls, parts: list[bytes], width: int) -> BallTree:
        points, weight, place, *nodes = (np.frombuffer(p, np.int64) for p in parts)
        return _with_caches(points.reshape(-1, width), weight, place, *nodes)


def _with_caches(points, weight, place, start, end, left, right) -> BallTree:
    rows = np.concatenate([[0], np.cumsum(weight)])
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64),
                           np.cumsum(points * weight[:, None], axis=0)])
    count, total = rows[end] - rows[start], sums[end] - sums[start]
    middle = total / count[:, None]
    radius = np.empty(len(start))
    for level in _levels(start, end, left, right):
        size = end[level] - start[level]
        which = np.repeat(level, size)
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start[level] - (ends - size), size)
        away = ((points[at] - middle[which]) ** 2).sum(axis=1)
        radius[level] = np.sqrt(np.maximum.reduceat(away, ends - size))
    return BallTree(points, weight, place, start, end, left, right, middle, radius, count, total)


def _levels(start, end, left, right):
    level = np.zeros(1, np.int64)
    while len(level):
        yield level
        inner = level[left[level] >= 0]
        level = np.concatenate([left[inner], right[inner]])


def _anchors(points: np.ndarray, many: int):
    """(owner of each point, anchors, their radii); an anchor steals what is nearer to it."""
    first = points[0]
    away = np.sqrt(((points - first) ** 2).sum(axis=1))
    owner, chosen = np.zeros(len(points), np.int64), [first]
    while len(chosen) < many:
        far = int(away.argmax())
        if away[far] == 0:
            break
        new = points[far]
        between = np.sqrt(((np.array(chosen) - new) ** 2).sum(axis=1))
        # A point less than half as far from its anchor as the new one is cannot be nearer to it.
        maybe = np.flatnonzero(away * 2 > between[owner])
        d = np.sqrt(((points[maybe] - new) ** 2).sum(axis=1))
        nearer = d < away[maybe]
        taken = maybe[nearer]
        owner[taken], away[taken] = len(chosen), d[nearer]
        owner[far], away[far] = len(chosen), 0.0
        chosen.append(new)
    return owner, np.array(chosen, float), away


def build(rows: np.ndarray) -> BallTree:
    """The tree of the rows of an integer matrix."""
    points, place, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    place = place.reshape(-1)
    left, right, leaf_points = [], [], {}

    def node(a: int = -1, b: int = -1) -> int:
        left.append(a)
        right.append(b)
        return len(left) - 1

    def grow(ids: np.ndarray) -> int:
        if len(ids) <= LEAF:
            made = node()
            leaf_points[made] = ids
            return made
        own = points[ids].astype(float)
        owner, anchor, away = _anchors(own, max(2, int(np.sqrt(len(ids)))))
        held = [np.flatnonzero(owner == k) for k in range(len(anchor))]
        balls = [grow(ids[h]) for h in held]
        radius = np.array([away[h].max() for h in held])
        # Distance between anchors plus both radii is the width of what encloses both balls.
        gap = np.sqrt(((anchor[:, None] - anchor[None]) ** 2).sum(axis=2))
        size = np.array([len(h) for h in held], float)
        np.fill_diagonal(gap, np.inf)
        last, joined = 0, np.zeros(len(balls), bool)
        for _ in range(len(balls) - 1):
            i, j = divmod(int((gap + radius[:, None] + radius[None]).argmin()), len(radius))
            balls[i], last = node(balls[i], balls[j]), i
            middle = (anchor[i] * size[i] + anchor[j] * size[j]) / (size[i] + size[j])
            reach = max(np.sqrt(((anchor[k] - middle) ** 2).sum()) + radius[k] for k in (i, j))
            joined[j] = True
            anchor[i], radius[i], size[i] = middle, reach, size[i] + size[j]
            gap[i] = gap[:, i] = np.where(joined, np.inf,
                                          np.sqrt(((anchor - middle) ** 2).sum(axis=1)))
            gap[i, i] = np.inf
            gap[j] = gap[:, j] = np.inf
        return balls[last]

    root = grow(np.arange(len(points)))
    # Balls in preorder, so that children and points of a ball stand side by side.
    order, begin, finish, stack, laid, done = [], {}, {}, [(root, False)], [], 0
    while stack:
        at, closing = stack.pop()
        if closing:
            finish[at] = done
            continue
        order.append(at)
        begin[at] = done
        if left[at] < 0:
            laid.append(leaf_points[at])
            done += len(leaf_points[at])
            finish[at] = done
        else:
            stack += [(at, True), (right[at], False), (left[at], False)]
    number = {b: k for k, b in enumerate(order)} | {-1: -1}
    laid = np.concatenate(laid)
    moved = np.empty(len(laid), np.int64)
    moved[laid] = np.arange(len(laid))
    nodes = [np.array([f(b) for b in order], np.int64) for f in
             (begin.__getitem__, finish.__getitem__, lambda b: number[left[b]],
              lambda b: number[right[b]])]
    return _with_caches(points[laid], weight[laid].astype(np.int64), moved[place], *nodes)


def owned(tree: BallTree, entries: np.ndarray):
    """Yield ("ball", balls, entries) for balls owned whole and ("point", points, entries) for the
    points of other leaves: every point lies in exactly one of them. Ties go to lower indexes."""
    exact, entry = entries.astype(np.int64), entries.astype(float)
    apart = np.sqrt(((entry[:, None] - entry[None]) ** 2).sum(axis=2))
    # Of equal entries only the first can be the nearest one.
    listed = np.zeros((1, len(entry)), bool)
    listed[0, np.unique(exact, axis=0, return_index=True)[1]] = True
    balls = np.zeros(1, np.int64)
    while len(balls):
        d = ((tree.middle[balls][:, None] - entry[None]) ** 2).sum(axis=2)
        d[~listed] = np.inf
        best = d.argmin(axis=1)
        nearest = d[np.arange(len(balls)), best][:, None]
        # For a point at most r from the middle the difference of the two squared distances moves
        # by at most 2 r times the distance between the entries.
        margin = 2 * tree.radius[balls][:, None] * apart[best]
        listed = listed & (d - nearest <= margin + _SLACK * (d + nearest + 1))
        listed[np.arange(len(balls)), best] = True
        alone = listed.sum(axis=1) == 1
        yield "ball", balls[alone], best[alone]
        leaf = ~alone & (tree.left[balls] < 0)
        if leaf.any():
            which = np.flatnonzero(leaf)
            size = tree.end[balls[which]] - tree.start[balls[which]]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(tree.start[balls[which]] - (ends - size), size)
            far = ((tree.points[at][:, None] - exact[None]) ** 2).sum(axis=2)
            far[~np.repeat(listed[which], size, axis=0)] = np.iinfo(np.int64).max
            yield "point", at, far.argmin(axis=1)
        inner = ~alone & ~leaf
        balls = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]])
        listed = np.concatenate([listed[inner], listed[inner]])


def sums(tree: BallTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, componentwise sums) of what each entry is nearest to."""
    count = np.zeros(len(entries), np.int64)
    total = np.zeros(entries.shape, np.int64)
    for kind, at, entry in owned(tree, entries):
        if kind == "ball":
            np.add.at(count, entry, tree.count[at])
            np.add.at(total, entry, tree.total[at])
        else:
            np.add.at(count, entry, tree.weight[at])
            np.add.at(total, entry, tree.points[at] * tree.weight[at][:, None])
    return count, total


def assigned(tree: BallTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row."""
    entry = np.empty(len(tree.points), np.int64)
    for kind, at, found in owned(tree, entries):
        if kind == "point":
            entry[at] = found
        else:
            size = tree.end[at] - tree.start[at]
            ends = np.cumsum(size)
            if len(ends):
                spots = np.arange(ends[-1]) + np.repeat(tree.start[at] - (ends - size), size)
                entry[spots] = np.repeat(found, size)
    far = ((tree.points - entries.astype(np.int64)[entry]) ** 2).sum(axis=1)
    return entry[tree.place], far[tree.place]
