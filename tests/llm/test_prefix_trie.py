"""Balanced parentheses and the prefix trie against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from asfiled.llm.parentheses import Parentheses, RangeMinimum
from asfiled.llm.prefix_trie import prefix_trie, rebuilt, turn_lists

SCHEMA = "conv_id long, turn long, role string, text string"


def random_tree(rng, n):
    bits, left, depth = [], n, 0
    while left or depth:
        if left and (depth == 0 or rng.random() < 0.55):
            bits.append(True)
            left, depth = left - 1, depth + 1
        else:
            bits.append(False)
            depth -= 1
    return np.array(bits)


@pytest.mark.parametrize("n", [1, 2, 50, 400, 5000])
def test_partners_and_leaves_of_random_trees(n):
    rng = random.Random(n)
    for _ in range(3):
        bits = random_tree(rng, n)
        tree, stack, partner = Parentheses(bits), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                partner[stack.pop()] = i
        at = tree.positions()
        close = tree.find_close(at)
        assert close.tolist() == [partner[i] for i in at.tolist()]
        leaves = [sum(bits[j] and not bits[j + 1] for j in range(i, partner[i])) for i in at[:50].tolist()]
        assert tree.leaves_between(at, close)[:50].tolist() == leaves


def test_a_path_of_one_child_each():
    bits = np.repeat([True, False], 3000)
    tree = Parentheses(bits)
    assert tree.find_close(tree.positions()).tolist() == list(range(5999, 2999, -1))


def test_range_minimum():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 99, 200)
    first = rng.integers(0, 199, 300)
    end = first + 1 + rng.integers(0, 200, 300) % (200 - first)
    assert RangeMinimum(values)(first, end).tolist() == [values[a:b].min() for a, b in zip(first, end)]


def plain(rows):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conversations[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in conversations.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
            if d:
                children[tuple(t[:d - 1])].add(tuple(t[:d]))
        ends[tuple(t)].append(c)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k],
                   saved[k], sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
                  for k, m in members.items())


def told(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs,
                   r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect())


def conversations(rng, several=True):
    rows = [(c, t if rng.random() < .95 or t else None, rng.choice(["u", "a", None]),
             rng.choice(["hi there", "hi there", "hi there", "x", None, "a b  c"]))
            for c in range(0, 190) for t in range(rng.choice([1, 1, 2, 3, 5]))]
    rows += [(None, 1, "u", "t"), (None, None, None, None)]
    # A long conversation and one like it, and many equal ones in a row.
    rows += [(c, t, "u", f"turn {t}") for c in (400, 420) for t in range(120)]
    if several:
        rows += [(c, t, "u", "again and again") for c in range(1000, 1150) for t in range(4)]
    return [r for r in rows if rng.random() < .95]


@pytest.mark.parametrize("shard", [1, 3, 20, 500, 1 << 16])
def test_nodes_whatever_the_shards(spark, shard):
    rows = conversations(random.Random(shard))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("group", "node_key", "a", "b", "words", "turns", "seen"):
        df = df.withColumn(name, F.lit("own"))
    assert told(prefix_trie(rebuilt(df), shard)) == plain(rows)


def test_no_conversations_and_turnless_ones(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(rebuilt(empty)).collect() == []
    # 1 and 2 have fewer turns than they would take from a conversation that does not exist.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(41, 60)}
    ids = [c for c in h if h[c]][:3]
    rows = [(c, 0, "u", "gone") for c in ids]
    got = told(prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA))))
    assert got == plain(rows) and len(got) == 1 and got[0][3] == 3


def test_repeated_rows_and_equal_turn_numbers_have_one_order(spark):
    rows = [(3, 1, "u", "a"), (3, 1, "u", "b"), (3, 1, "u", "a"), (3, None, "u", "first")]
    lists = [turn_lists(spark.createDataFrame(rows, SCHEMA).repartition(k)).head().turns for k in (1, 3)]
    assert lists[0] == lists[1] and len(lists[0]) == 4 and lists[0][0].turn is None
