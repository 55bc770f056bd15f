"""Anchors trees and product quantisation against plain distances."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from asfiled.llm.anchors import BallTree, assigned, build, owned, sums
from asfiled.llm.vector_codes import vector_codes, with_group_error

SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("n,width,entries,spread", [
    (1, 4, 3, 5), (30, 4, 8, 3), (500, 2, 5, 4), (2000, 4, 64, 150), (3000, 4, 64, 2), (400, 1, 9, 50)])
def test_trees_assign_as_all_distances_do(n, width, entries, spread):
    rng = np.random.default_rng(n)
    for _ in range(3):
        rows = np.floor(rng.normal(0, spread, (n, width))).astype(np.int64)
        book = rows[rng.integers(0, n, entries)]  # with equal entries, too
        tree = BallTree.unpack(build(rows).pack(), width)
        far = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        want = far.argmin(axis=1)
        entry, error = assigned(tree, book)
        assert (entry == want).all() and (error == far.min(axis=1)).all()
        count, total = sums(tree, book)
        expected = np.zeros_like(total)
        np.add.at(expected, want, rows)
        assert (count == np.bincount(want, minlength=entries)).all() and (total == expected).all()


def test_balls_hold_their_points_and_cached_sums():
    rows = np.random.default_rng(2).integers(-90, 90, (1500, 4))
    tree = build(rows)
    for b in range(len(tree.start)):
        own = tree.points[tree.start[b]:tree.end[b]]
        weight = tree.weight[tree.start[b]:tree.end[b]]
        assert np.sqrt(((own - tree.middle[b]) ** 2).sum(axis=1)).max() <= tree.radius[b] + 1e-6
        assert tree.count[b] == weight.sum() and (tree.total[b] == (own * weight[:, None]).sum(0)).all()
        if tree.left[b] >= 0:
            l, r = tree.left[b], tree.right[b]
            assert (tree.start[l], tree.end[l], tree.end[r]) == (tree.start[b], tree.start[r], tree.end[b])


def test_separate_groups_are_owned_as_whole_balls():
    rng = np.random.default_rng(3)
    middles = np.array([[0, 0], [5000, 0], [0, 5000], [5000, 5000]])
    rows = (middles[rng.integers(0, 4, 2000)] + rng.integers(-50, 50, (2000, 2))).astype(np.int64)
    tree = build(rows)
    looked_at = sum(len(at) for kind, at, _ in owned(tree, middles) if kind == "point")
    assert looked_at == 0


def brute(rows, parts, entries, rounds):
    kept = [r for r in rows if r[2] and all(x is not None and np.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cells = [[[int(np.floor(256 * np.float32(x))) for x in r[2]][p::1] for p in (0,)][0] for r in kept]
    width = len(cells[0]) // parts
    cut = [[c[p * width:(p + 1) * width] for p in range(parts)] for c in cells]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(col) // len(g) for col in zip(*g)]
    out = []
    for r, c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((r[0], r[1], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def test_codes_against_plain_python_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, None]), [rng.gauss(0, .3) for _ in range(8)]) for i in range(300)]
    same = [0.25] * 8
    rows += [(1000 + i, 3, same) for i in range(150)] + [(5, 1, [0.1] * 8), (None, 1, [0.2] * 8)]
    rows += [(-9, 1, None), (-8, 1, []), (-7, 2, [None] + [0.0] * 7), (-6, 2, [float("nan")] * 8),
             (-5, 2, [float("inf")] + [0.0] * 7), (900, None, [0.0] * 4 + [-0.0] * 4)]
    rows = [(i, l, v and [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows]
    want, books = brute(rows, 4, 16, 2)
    df = spark.createDataFrame([*rows, (950, 1, [0.0] * 6)], SCHEMA).repartition(3)
    for name in ("CODE", "row", "rows", "vec", "trees", "slot", "n", "t0", "i", "v"):
        df = df.withColumn(name, F.lit("own"))
    coded, found = vector_codes(df, parts=4, entries=16)
    got = with_group_error(coded).collect()
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    assert found.tolist() == [[list(e) for e in b] for b in books]
    totals = defaultdict(int)
    for _, label, _, error in want:
        totals[label] += error
    assert all(r.label_error == totals[r.label] and r.trees == r.v == "own" for r in got)


def test_no_rows_no_usable_rows_and_few_rows(spark):
    for rows in ([], [(1, 1, None), (2, None, [])]):
        coded, books = vector_codes(spark.createDataFrame(rows, SCHEMA))
        assert coded.collect() == [] and books.size == 0
        assert with_group_error(coded).collect() == []
    coded, books = vector_codes(spark.createDataFrame([(1, 1, [0.5] * 16), (2, 1, [1.5] * 16)], SCHEMA))
    assert books.shape == (16, 2, 1)
    assert sorted((r.code, r.error) for r in coded.collect()) == [("00" * 16, 0), ("01" * 16, 0)]


def test_what_cannot_be_cut_or_held_is_refused(spark):
    with pytest.raises(ValueError):
        vector_codes(spark.createDataFrame([(1, 1, [0.5] * 7)], SCHEMA))
    with pytest.raises(Exception, match="not supported"):
        vector_codes(spark.createDataFrame([(1, 1, [1e30] * 16)], SCHEMA))
