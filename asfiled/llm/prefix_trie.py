"""The trie of the prefixes of conversations, with what sharing them would save.

Conversations are put in the order of their turns and cut into shards. A shard's trie is written
as balanced parentheses: the partner of a node's parenthesis delimits its subtree, ranks count the
childless nodes in it, and running sums over the preorder give what it saves.

Only nodes on the first and the last path of a shard, its spines, can stand in other shards too.
They are merged by a hash of the path; what a shared node was counted too often is put right on
one spine that holds it and summed up towards the root along that path. Everything else is final
where it was made.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialise
from .parentheses import Parentheses, RangeMinimum
from .rows import SPACED_WORD

#: Turns or conversations of a shard; one longer conversation is a shard by itself.
SHARD = 1 << 16
NO_ENDS = sha256(b"").hexdigest()

_NODE = ("spine boolean, node_key binary, parent_key binary, shard binary, side int, seen int, "
         "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, leaf long, saved long, words long, first_end long, ends string, "
         "ends_sha256 string")
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", "ends_sha256"]


def turn_lists(conversations: DataFrame, group=None) -> DataFrame:
    """(group, conv_id, turns): the turns of each conversation in order, nulls of ``turn`` first.

    A turn is ``struct<turn, a, b, words>``, with a 128-bit hash of role and text in place of them;
    null roles and texts count as empty. Turns of one number are ordered by that hash. Rows without
    a ``conv_id`` belong to no conversation. ``group`` (by default the conversation) is a column
    expression of ``conv_id``; conversations of one group are put into the same partition.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    group = F.col("conv_id") if group is None else group
    turns = (conversations.filter("conv_id is not null").select(
        group.alias("group"), F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(7), role).alias("b"),
        F.size(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))).cast("long").alias("words"))
        .repartition("group"))
    return turns.groupBy("group", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "a", "b", "words"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns) with the first turns of each conversation taken from another one.

    Conversation c begins with the first h turns of c - c % ``every``, all if there are fewer and
    none if there is no such conversation; its own turns after the first h follow. h is the CRC-32
    of c in decimal, modulo ``most``.
    """
    own = turn_lists(conversations, F.col("conv_id") - F.col("conv_id") % every)
    heads = (own.filter(F.col("conv_id") == F.col("group"))
             .select("group", F.slice("turns", 1, most - 1).alias("head")))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    return (own.join(heads, "group", "left").withColumn("h", h).select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(turns, 1, 0)")),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    ).alias("turns")))


def _path_keys(path: np.ndarray) -> list[bytes]:
    """A hash for each prefix of a path of turns, the empty one first."""
    state = blake2b(digest_size=16)
    keys, raw = [state.digest()], path.tobytes()
    for at in range(0, len(raw), 16):
        state.update(raw[at:at + 16])
        keys.append(state.copy().digest())
    return keys


def _shard(ids: np.ndarray, lengths: np.ndarray, path: np.ndarray, words: np.ndarray):
    """Rows of ``_NODE`` for conversations in the order of their paths."""
    n = len(ids)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    shared = np.zeros(n, np.int64)
    for i in range(1, n):
        m = int(min(lengths[i - 1], lengths[i]))
        same = (path[begin[i - 1]:begin[i - 1] + m] == path[begin[i]:begin[i] + m]).all(axis=1)
        shared[i] = m if same.all() else int(same.argmin())
    shared[0] = -1  # the root opens with the first conversation
    opens = lengths - shared
    closes = np.append(lengths[:-1] - shared[1:], lengths[-1] + 1)
    runs = np.stack([opens, closes], 1).ravel()
    tree = Parentheses(np.repeat(np.tile([True, False], n), runs))

    total = int(opens.sum())
    maker = np.repeat(np.arange(n), opens)
    new = np.concatenate([[0], np.cumsum(opens)])
    depth = np.arange(total) - new[maker] + shared[maker] + 1
    word = np.zeros(total, np.int64)
    inner = depth > 0
    word[inner] = words[begin[maker[inner]] + depth[inner] - 1]
    parent, path_nodes = np.arange(-1, total - 1), np.empty(int(lengths.max()) + 1, np.int64)
    for i in range(n):
        if opens[i]:
            if i:
                parent[new[i]] = path_nodes[shared[i]]
            path_nodes[shared[i] + 1:lengths[i] + 1] = np.arange(new[i], new[i + 1])

    at = tree.positions()
    close = tree.find_close(at)
    last = tree.nodes_before(close)  # behind the last node of the subtree
    ends = new[1:] - 1               # a conversation ends at the newest node
    beyond = np.searchsorted(ends, last - 1, "right")
    n_convs = beyond - maker
    least = RangeMinimum(ids)(maker, beyond)
    saving = np.concatenate([[0], np.cumsum((n_convs - 1) * word)])
    saved = saving[last] - saving[np.arange(total)]
    n_leaves = tree.leaves_between(at, close)
    n_children = np.bincount(parent[1:], minlength=total)
    end_from = np.searchsorted(ends, np.arange(total), "left")
    end_upto = np.searchsorted(ends, np.arange(total), "right")

    first_path = np.arange(lengths[0] + 1)
    last_path = path_nodes[:lengths[-1] + 1]
    on_spine = np.zeros(total, bool)
    on_spine[first_path] = on_spine[last_path] = True
    names = list(map(str, ids.tolist()))

    def text(v: int) -> str:
        return ",".join(names[end_from[v]:end_upto[v]])

    def column(values, kind):
        return pa.array(values, kind)

    def batch(v: np.ndarray, **made) -> pa.RecordBatch:
        size = len(v)
        figures = {"conv_id": least, "depth": depth, "n_convs": n_convs, "n_children": n_children,
                   "n_leaves": n_leaves, "saved": saved, "words": word, "leaf": n_children == 0}
        arrays = {k: column(a[v].astype(np.int64), pa.int64()) for k, a in figures.items()} | made
        kinds = {"spine": pa.bool_(), "node_key": pa.binary(), "parent_key": pa.binary(),
                 "shard": pa.binary(), "side": pa.int32(), "seen": pa.int32(), "ends": pa.string(),
                 "ends_sha256": pa.string()}
        order = [f.split()[0] for f in _NODE.split(", ")]
        return pa.RecordBatch.from_arrays(
            [arrays[k] if k in arrays else pa.nulls(size, kinds.get(k, pa.int64())) for k in order],
            names=order)

    keys: dict[int, bytes] = {}
    for nodes, i in ((first_path, 0), (last_path, n - 1)):
        keys |= zip(nodes.tolist(), _path_keys(path[begin[i]:begin[i] + lengths[i]]))
    shard = blake2b(path[:lengths[0]].tobytes() + str(ids[0]).encode(), digest_size=16).digest()

    v = np.flatnonzero(~on_spine)
    above = parent[v]
    yield batch(v, spine=column([False] * len(v), pa.bool_()),
                parent_conv_id=pa.array(least[above], pa.int64(), mask=on_spine[above]),
                parent_key=column([keys.get(p) for p in above.tolist()], pa.binary()),
                ends_sha256=column([sha256(text(k).encode()).hexdigest() if end_upto[k] > end_from[k]
                                    else NO_ENDS for k in v.tolist()], pa.string()))
    for side, nodes in enumerate((first_path, last_path)):
        # A node on both paths counts on the first; on the last it only links its descendants.
        seen = np.ones(len(nodes), bool) if side == 0 else nodes >= len(first_path)
        ending = [end_upto[k] > end_from[k] and s for k, s in zip(nodes.tolist(), seen)]
        yield batch(nodes, spine=column([True] * len(nodes), pa.bool_()),
                    node_key=column([keys[k] for k in nodes.tolist()], pa.binary()),
                    parent_key=column([None, *(keys[k] for k in nodes.tolist()[:-1])], pa.binary()),
                    shard=column([shard] * len(nodes), pa.binary()),
                    side=column([side] * len(nodes), pa.int32()),
                    seen=column(seen.astype(np.int32), pa.int32()),
                    first_end=column([int(ids[end_from[k]]) if e else None
                                      for k, e in zip(nodes.tolist(), ending)], pa.int64()),
                    ends=column([text(k) if e else None
                                 for k, e in zip(nodes.tolist(), ending)], pa.string()))


def _shards(lists: DataFrame, shard: int) -> DataFrame:
    ordered = (lists.select(
        "conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("path"),
        F.col("turns.words").alias("words"))
        .repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"))

    def run(batches):
        held, size = [], 0

        def emit():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, path, words = (table.column(k).combine_chunks() for k in range(3))
            lengths = words.value_lengths().to_numpy().astype(np.int64)
            yield from _shard(ids.to_numpy(), lengths, path.flatten().to_numpy().reshape(-1, 2),
                              words.flatten().to_numpy())

        for batch in batches:
            weight = 1 + batch.column(2).value_lengths().to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(weight[at:]), shard - size, "right")
                take = int(room) if room or held else 1
                if take:
                    held.append(batch.slice(at, take))
                    size += int(weight[at:at + take].sum())
                    at += take
                if at < batch.num_rows:
                    yield from emit()
                    held, size = [], 0
        if held:
            yield from emit()

    return ordered.mapInArrow(run, _NODE)


def _ends(spines: DataFrame) -> DataFrame:
    """(node_key, ends_sha256) of the conversations that end at a spine's node, in one stream."""
    def run(batches):
        key, state = None, None
        for batch in batches:
            for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state:
                        yield pa.RecordBatch.from_pydict({"node_key": pa.array([key], pa.binary()),
                                                          "ends_sha256": [state.hexdigest()]})
                    key, state = k, sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
        if state:
            yield pa.RecordBatch.from_pydict({"node_key": pa.array([key], pa.binary()),
                                              "ends_sha256": [state.hexdigest()]})

    told = (spines.filter("ends is not null").select("node_key", "ends", "first_end")
            .repartition("node_key").sortWithinPartitions("node_key", "first_end"))
    return told.select("node_key", "ends").mapInArrow(run, "node_key binary, ends_sha256 string")


def _merged(spines: DataFrame) -> DataFrame:
    """One row for each node that stands on a spine."""
    once = spines.filter("seen = 1").groupBy("node_key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("children"), F.sum("leaf").alias("leaves_told"),
        F.count(F.lit(1)).alias("shards"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("words").alias("words"),
        F.min(F.struct("shard", "side")).alias("owner"))
    # A shared node was taken for a leaf wherever a shard saw nothing below it, and its first
    # member was left out of the saving in each of its shards.
    once = materialise(once.withColumn(
        "leaf_change", F.expr("if(leaves_told = shards, 1, 0) - leaves_told")).withColumn(
        "saved_change", F.expr("(shards - 1) * words")), "spine_nodes")
    owned = once.select("node_key", "owner.shard", "owner.side", "leaf_change", "saved_change")
    below = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    change = (spines.select("node_key", "shard", "side", "depth")
              .join(owned, ["node_key", "shard", "side"], "left")
              .select("node_key", *(F.sum(F.coalesce(c, F.lit(0))).over(below).alias(c)
                                    for c in ("leaf_change", "saved_change")))
              .groupBy("node_key").agg(F.sum("leaf_change").alias("more_leaves"),
                                       F.sum("saved_change").alias("more_saved")))
    again = once.groupBy(F.col("parent_key").alias("node_key")).agg(
        F.sum(F.col("shards") - 1).alias("children_again"))
    above = once.select(F.col("node_key").alias("parent_key"),
                        F.col("conv_id").alias("parent_conv_id"))
    return (once.join(change, "node_key").join(again, "node_key", "left")
            .join(above, "parent_key", "left").join(_ends(spines), "node_key", "left")
            .select("node_key", "conv_id", "depth", "parent_conv_id", "n_convs",
                    (F.col("children") - F.coalesce("children_again", F.lit(0))).alias("n_children"),
                    (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
                    (F.col("saved") + F.col("more_saved")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def prefix_trie(lists: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each different sequence of the first turns of conversations, the empty one too.

    ``lists`` has ``conv_id`` (long, each once, not null) and ``turns`` as :func:`turn_lists` makes
    them; other columns are not looked at. Members of a node are the conversations that start with
    its turns. ``conv_id`` is its smallest member, ``parent_conv_id`` that of its parent (null for
    the root); ``n_children`` and ``n_leaves`` count children and the childless nodes of its
    subtree; ``saved_tokens`` sums over the subtree the words of a node's last turn, for each
    member but one. ``ends_sha256`` is the hash of the ids, ascending and joined by commas, of the
    conversations that end at the node.

    Without conversations there are no nodes. Conversations without turns are members of the root.
    A conversation travels as 24 bytes a turn and must fit into a task; a shard holds about
    ``shard`` turns. Equal conversations may be any number: they are cut between shards like others.
    """
    nodes = materialise(_shards(lists, shard), "trie")
    spines = nodes.filter("spine")
    merged = materialise(_merged(spines), "merged")
    inner = nodes.filter("not spine").withColumn("saved_tokens", F.col("saved"))
    # Only children of spine nodes still ask for their parent's smallest member.
    asking = (inner.filter("parent_key is not null").drop("parent_conv_id")
              .join(merged.select(F.col("node_key").alias("parent_key"),
                                  F.col("conv_id").alias("parent_conv_id")), "parent_key"))
    return (inner.filter("parent_key is null").select(_COLUMNS)
            .unionByName(asking.select(_COLUMNS)).unionByName(merged.select(_COLUMNS)))
