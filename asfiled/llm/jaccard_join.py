"""Exact Jaccard join of documents on word shingles, and the groups that its links make.

1. **Order.** Shingles are ordered from rare to frequent by a counting sketch of fixed size over
   all documents; any total order is right, this one keeps passages that many documents share
   out of the way.
2. **Blocks.** Two sets of similarity 0.8 share one of the first fifth of their shingles in that
   order. Each such shingle makes a block of the sets that have it there.
3. **Spine.** Each member of a block is compared with one set of the block, bitmaps first, whole
   sets then, and in blocks of several components again with another one. This is linear in the
   members and joins most groups of near copies, however large.
4. **Signature trees.** In blocks that still hold several components, trees over the members'
   bitmaps are traversed against each other; node pairs that cannot overlap enough, or lie in
   one component, are cut. What is left is compared set by set.

Documents with equal sets are one set from the start. Sets move between tasks only for pairs
whose bitmaps allow a link. A block too large for one task is cut into chunks, and every pair of
chunks is traversed: no block, member or candidate is capped.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import materialise
from .components import components
from .rows import bounded_batches
from .shingles import shingle_set
from .signature_tree import (
    SignatureTree, bitmap, bitmap_bytes, dual_traversal, folded, least_overlap, may_link,
    size_class,
)

#: Counters of the sketch and the parts it is added up in; the driver gets one byte per counter.
_COUNTERS, _PARTS = 1 << 20, 16
#: Members of a block that one tree may hold.
CHUNK = 2000
#: Rounds of comparing open blocks with drawn members before trees are built, and the number of
#: different draws that blocks of the same members make in a round.
SPINES, PIVOTS = 2, 4
#: Pairs or sets a task remembers having told; beyond that it may repeat some.
_TOLD = 300_000
#: Bits of the filters that spare most documents the second look and most bitmaps the shuffle.
_FILTER_BITS = 1 << 23
#: Tasks among which the trees of one anchor are dealt.
_SALTS = 8


def frequency_levels(docs: DataFrame, size: int, text: str) -> np.ndarray:
    """About eight steps per doubling of the number of documents that hold a shingle's counter."""
    def count(batches):
        counts = np.zeros(_COUNTERS, np.uint32)
        for batch in bounded_batches(batches):
            for value in batch.column(0).to_pylist():
                at = shingle_set(value, size) & np.uint64(_COUNTERS - 1)
                np.add.at(counts, at.astype(np.int64), 1)
        if counts.any():
            parts = [p.astype(np.uint64).tobytes() for p in np.split(counts, _PARTS)]
            salt = int(counts.sum()) % 64
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(range(_PARTS), pa.int32()),
                 "salt": pa.array([salt] * _PARTS, pa.int32()), "counts": parts})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                counts = np.frombuffer(counts, np.uint64)
                sums[part] = sums[part] + counts if part in sums else counts
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(list(sums), pa.int32()),
             "salt": pa.array([0] * len(sums), pa.int32()),
             "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    schema = "part int, salt int, counts binary"
    local = docs.select(text).mapInArrow(count, schema)
    sums = (local.repartition("part", "salt").mapInArrow(add, schema)
            .repartition(_PARTS, "part").mapInArrow(add, schema).collect())
    levels = np.zeros(_COUNTERS, np.uint8)
    for row in sums:
        at = row.part * (_COUNTERS // _PARTS)
        counts = np.frombuffer(row.counts, np.uint64).astype(float)
        levels[at:at + len(counts)] = np.minimum(255, 8 * np.log2(counts + 1)).astype(np.uint8)
    return levels


def _signatures(docs: DataFrame, levels, size: int, percent: int, doc_id: str,
                text: str) -> DataFrame:
    """Per document: id, hash of the text, number of the set, its size, block keys and bitmap.

    Equal sets have equal ones, so a task leaves out keys and bitmap of a set that it has just told.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                         F.col(text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def run(batches):
        rank, told = levels.value, set()
        for batch in bounded_batches(batches):
            sets, sizes, kinds, keys, bits = [], [], [], [], []
            for value in batch.column(2).to_pylist():
                tokens = shingle_set(value, size)
                n = len(tokens)
                prefix = n - -(-percent * n // 100) + 1 if n else 0
                order = (rank[(tokens & np.uint64(_COUNTERS - 1)).astype(np.int64)]
                         .astype(np.uint64) << np.uint64(56)) | tokens
                if prefix < n:
                    order = np.partition(order, prefix)[:prefix]
                sets.append(int.from_bytes(
                    blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(n)
                again = not n or sets[-1] in told
                keys.append(order.view(np.int64)[:0 if again else None])
                if len(told) > _TOLD:
                    told.clear()
                told.add(sets[-1])
                kinds.append(size_class(n, percent))
                bits.append(None if again else bitmap(tokens, bitmap_bytes(kinds[-1], percent)))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(kinds, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))),
                 pa.array(bits, pa.binary())],
                names=["doc_id", "text_hash", "set_id", "n", "size_class", "keys", "bits"])

    return source.mapInArrow(
        run, f"doc_id {kind}, text_hash long, set_id long, n long, size_class int, "
             "keys array<long>, bits binary")


def _blocks(signatures: DataFrame) -> DataFrame:
    """(key, set_id, lo, rows) for the sets of each block of several: its smallest set, and how
    many rows gave it its keys, at least one for each set. Keys move once, with their sets."""
    block = Window.partitionBy("key")
    return (signatures.filter("n > 0").select("set_id", F.explode("keys").alias("key"))
            .select("key", "set_id", F.min("set_id").over(block).alias("lo"),
                    F.max("set_id").over(block).alias("hi"),
                    F.count(F.lit(1)).over(block).alias("rows"))
            .filter("lo <> hi").drop("hi").distinct())


def _allowed(pairs: DataFrame, sets: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sizes and bitmaps allow a link.

    Sizes are compared first; bitmaps move for the pairs that are left.
    """
    sizes = sets.select("set_id", "n")
    near = (pairs.join(sizes.selectExpr("set_id as u", "n as n_u"), "u")
            .join(sizes.selectExpr("set_id as v", "n as n_v"), "v")
            .filter(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)"))
    near = materialise(near.select("u", "v", "n_u", "n_v"), "near")
    bits = materialise(_bits_of(near.select(F.col("u").alias("set_id")).union(near.select("v")),
                                bitmaps), "bits")
    both = (near.join(bits.selectExpr("set_id as u", "bits as bits_u"), "u")
            .join(bits.selectExpr("set_id as v", "bits as bits_v"), "v")
            .select("u", "v", "n_u", "n_v", "bits_u", "bits_v"))

    def run(batches):
        for batch in bounded_batches(batches):
            c = batch.to_pydict()
            ok = [may_link(*row, percent) for row in
                  zip(c["bits_u"], c["n_u"], c["bits_v"], c["n_v"])]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _bits_of(named: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(set_id, bits) of the named sets; a filter of fixed size keeps most others unshuffled.

    ``bitmaps`` may have a set several times, once for each task that met it.
    """
    named = named.distinct()
    wanted = bitmaps.sparkSession.sparkContext.broadcast(_filter_of(named, "set_id"))

    def run(batches):
        for batch in batches:
            yield batch.filter(_passes(batch.column(0), wanted.value))

    some = bitmaps.mapInArrow(run, "set_id long, bits binary")
    return some.join(named, "set_id", "left_semi").groupBy("set_id").agg(F.max("bits").alias("bits"))


def _passes(hashes: pa.Array, wanted: np.ndarray) -> pa.Array:
    at = hashes.to_numpy() % _FILTER_BITS
    return pa.array((wanted[at >> 3] >> (at & 7)) & 1 == 1)


def _filter_of(hashes: DataFrame, name: str = "text_hash") -> np.ndarray:
    """A bit for each hash, in a bitmap of fixed size."""
    words = (hashes.selectExpr(f"pmod({name}, {_FILTER_BITS}L) as b").groupBy(
        F.expr("cast(b div 64 as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toArrow())
    table = np.zeros(_FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint8)


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int,
            text: str) -> DataFrame:
    """Those of the pairs (u, v) that are similar enough, by their whole sets."""
    needed = (pairs.select(F.col("u").alias("set_id")).union(pairs.select("v")).distinct()
              .join(sets.select("set_id", "text_hash"), "set_id"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(needed))

    def tokens(batches):
        wanted = bits.value
        for batch in bounded_batches(batches):
            batch = batch.filter(_passes(batch.column(0), wanted))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(
                    [shingle_set(t, size).tobytes()
                     for t in batch.column(1).to_pylist()], pa.binary())],
                names=["text_hash", "tokens"])

    found = (docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
             .mapInArrow(tokens, "text_hash long, tokens binary")
             .groupBy("text_hash").agg(F.first("tokens").alias("tokens")))
    whole = needed.join(found, "text_hash").select("set_id", "tokens")
    both = (pairs.join(whole.selectExpr("set_id as u", "tokens as tokens_u"), "u")
            .join(whole.selectExpr("set_id as v", "tokens as tokens_v"), "v")
            .select("u", "v", "tokens_u", "tokens_v"))

    def check(batches):
        for batch in bounded_batches(batches):
            ok = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(common >= least_overlap(len(a) + len(b), percent))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "u long, v long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (key, set_id) with the component of each set."""
    return (members.select("key", "set_id")
            .join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
            .withColumn("component", F.coalesce("component", "set_id")))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: the components so far are stars among which the links run."""
    if links.isEmpty():
        return labels
    stars = labels.filter("node <> component").selectExpr("node as u", "component as v")
    return materialise(components(stars.union(links)), "labels")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of blocks that hold several components."""
    labelled = _labelled(members, labels)
    several = (labelled.groupBy("key").agg(
        F.min("component").alias("_a"), F.max("component").alias("_b"))
        .filter("_a <> _b").select("key"))
    return materialise(labelled.join(several, "key"), "open")


def _drawn(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (u, v) of members in other components than a set drawn from their block.

    Blocks of one group of near copies share their members; ``PIVOTS`` draws, by the key, give
    such a group as many different sets to meet in.
    """
    draw = F.xxhash64("set_id", F.pmod("key", F.lit(PIVOTS)), F.lit(turn))
    pivots = members.groupBy("key").agg(
        F.min_by(F.struct("set_id", "component"), draw).alias("pivot"))
    return (members.join(pivots, "key").filter("component <> pivot.component").selectExpr(
        "least(set_id, pivot.set_id) as u", "greatest(set_id, pivot.set_id) as v").distinct())


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (u, v, a, b) whose ends lie in different components a < b."""
    return (pairs.join(labels.selectExpr("node as u", "component as c_u"), "u", "left")
            .join(labels.selectExpr("node as v", "component as c_v"), "v", "left")
            .selectExpr("u", "v", "coalesce(c_u, u) as c_u", "coalesce(c_v, v) as c_v")
            .filter("c_u <> c_v")
            .selectExpr("u", "v", "least(c_u, c_v) as a", "greatest(c_u, c_v) as b"))


def _tree_pairs(members: DataFrame, sets: DataFrame, bitmaps: DataFrame, labels: DataFrame,
                percent: int) -> DataFrame:
    """Pairs (u, v) from blocks with several components, by dual traversal of signature trees."""
    # A set stands in the tree of its own size class and, as a partner, in that of the one below.
    rows = (_labelled(members, labels)
            .join(sets.select("set_id", "n", F.col("size_class").alias("own")), "set_id")
            .withColumn("below", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("tree", F.col("own") - F.col("below")))
    # Trees of one set, of one component or without owners hold no pair; of several blocks with
    # the same members one tree is enough. All this is settled before bitmaps move.
    trees_of = rows.groupBy("key", "tree").agg(
        F.count(F.lit(1)).alias("held"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi"),
        F.bit_xor(F.xxhash64("set_id", "below")).alias("mark"),
        F.count_if(F.col("below") == 0).alias("owners"),
        F.min("component").alias("a"), F.max("component").alias("b")
    ).filter("held > 1 and owners > 0 and a <> b")
    once = trees_of.groupBy("tree", "held", "lo", "hi", "mark").agg(
        F.min(F.struct("key", "a")).alias("one"))
    chosen = once.select("one.key", "tree", F.col("one.a").alias("anchor"), F.ceil(F.col("held") / CHUNK).cast("int").alias("chunks"))
    narrow = materialise(rows.join(chosen, ["key", "tree"]), "trees")
    wide = _bits_of(narrow.select("set_id"), bitmaps)
    spread = (narrow.join(wide, "set_id")
              .withColumn("chunk", F.pmod(F.xxhash64("set_id"), "chunks").cast("int"))
              .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
              .selectExpr("key", "tree", "least(chunk, other) as i", "greatest(chunk, other) as j",
                          "anchor", "chunk", "component", "n", "set_id", "below", "bits"))
    group = ["key", "tree", "i", "j"]
    # Blocks of one group of copies mostly have the same first component. Their trees, by pairs of
    # chunks, go to a few tasks, one after the other, so that a pair seen before is told again a
    # few times at most.
    salt = F.pmod(F.xxhash64("key"), F.lit(_SALTS))
    dealt = spread.repartition("anchor", "tree", "i", "j", salt).sortWithinPartitions(
        "anchor", *group, "chunk", "component", "n")

    def trees(rows: list[dict]):
        width = bitmap_bytes(rows[0]["tree"], percent)
        bits = np.array([folded(r["bits"], width) for r in rows])
        n, component, chunk, set_id, below = (
            np.array([r[k] for r in rows], np.int64)
            for k in ("n", "component", "chunk", "set_id", "below"))
        cut = int(np.searchsorted(chunk, chunk[0], "right"))
        parts = [slice(0, cut)] if cut == len(rows) else [slice(0, cut), slice(cut, None)]
        if len(parts) == 1 and rows[0]["i"] != rows[0]["j"]:
            return  # the other chunk is empty
        built = [SignatureTree(bits[p], n[p], component[p]) for p in parts]
        shift = 0 if len(parts) == 1 else cut
        for a, b in dual_traversal(built[0], built[-1], percent):
            b = b + shift
            owned = (below[a] == 0) | (below[b] == 0)
            a, b = set_id[a[owned]], set_id[b[owned]]
            differ = a != b
            yield np.minimum(a, b)[differ], np.maximum(a, b)[differ]

    def run(batches):
        held: list[dict] = []
        told: set[tuple[int, int]] = set()
        for batch in bounded_batches(batches):
            for row in batch.to_pylist():
                if held and any(held[0][g] != row[g] for g in group):
                    yield from pairs_of(held, told)
                    held = []
                held.append(row)
        if held:
            yield from pairs_of(held, told)

    def pairs_of(rows, told):
        for u, v in trees(rows):
            fresh = [p for p in zip(u.tolist(), v.tolist()) if p not in told]
            if len(told) > _TOLD:
                told.clear()
            told.update(fresh)
            yield pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in fresh], pa.int64()),
                                              "v": pa.array([p[1] for p in fresh], pa.int64())})

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _placed(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n, component_id), a row for each row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    levels = spark.sparkContext.broadcast(frequency_levels(docs, size, text))
    signatures = materialise(_signatures(docs, levels, size, percent, doc_id, text), "signatures")
    sets = materialise(signatures.filter("n > 0").groupBy("set_id").agg(
        F.max("n").alias("n"), F.max("size_class").alias("size_class"),
        F.min("text_hash").alias("text_hash")), "sets")
    bitmaps = signatures.filter("bits is not null").select("set_id", "bits")

    blocks = materialise(_blocks(signatures), "blocks")
    members = blocks.filter("rows > 2").select("key", "set_id")
    spine = blocks.filter("lo <> set_id").selectExpr("lo as u", "set_id as v").distinct()
    tested = materialise(_allowed(spine, sets, bitmaps, percent), "tested")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialise(_linked(pairs, docs, sets, size, percent, text), "links")

    labels = materialise(components(linked(tested)), "labels")
    for turn in range(SPINES + 1):
        members = _open(members, labels)
        if members.isEmpty():
            break
        if turn < SPINES:
            drawn = _drawn(members, turn)
            fresh = materialise(_allowed(drawn.join(tested, ["u", "v"], "left_anti"), sets,
                                         bitmaps, percent), "tested")
            tested = tested.union(fresh)
            labels = _merged(labels, linked(fresh))
            continue
        left = materialise(_tree_pairs(members, sets, bitmaps, labels, percent)
                           .join(tested, ["u", "v"], "left_anti"), "left")
        # One pair for every two components first; its links spare most of the others.
        first = materialise(_across(left, labels).groupBy("a", "b").agg(
            F.min(F.struct(F.xxhash64("u", "v").alias("draw"), "u", "v")).alias("p"))
            .select("p.u", "p.v"), "first")
        labels = _merged(labels, linked(first))
        rest = materialise(_across(left.join(first, ["u", "v"], "left_anti"), labels)
                           .select("u", "v"), "rest")
        labels = _merged(labels, linked(rest))

    placed = (signatures.select("doc_id", "text_hash", "set_id", "n")
              .join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
              .withColumn("component", F.coalesce("component", "set_id")))
    named = (placed.filter("n > 0").groupBy("component")
             .agg(F.min("doc_id").alias("component_id")))
    return (placed.filter("n > 0").join(named, "component")
            .select("doc_id", "text_hash", "n", "component_id")
            .union(placed.filter("n = 0").select("doc_id", "text_hash", "n", "doc_id")))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``.

    Two documents link when ``100 * common >= percent * all`` distinct shingles of ``size``
    words, A-Z lower-cased; ``component_id`` is the smallest id reachable by links. A text of
    fewer words is one shingle. A document without words or text has none, links with nothing
    and is its own component. A row without an id can link others; a component without any id
    has none. Repeated rows each keep a row. Texts count whole; other columns are not looked at.
    Shingles are told apart by 56-bit and sets by 64-bit hashes.
    """
    return _placed(docs, size, percent, doc_id, text).select(
        F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def one_per_component(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``docs`` with one row per component, the one of the smallest id; columns stay.

    Rows without words stay, and so do those of a component without any id. Of rows equal in id
    and text one stays; rows of one id with different texts are told apart by the text.
    """
    placed = materialise(_placed(docs, size, percent, doc_id, text), "placed")
    copies = (placed.filter("component_id is not null and not doc_id <=> component_id")
              .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct())

    def same(frame: DataFrame, other: DataFrame):
        return (frame[doc_id].eqNullSafe(other["_doc"])
                & (F.xxhash64(frame[text]) == other["_hash"]))

    kept = docs.join(copies, same(docs, copies), "left_anti")
    repeats = materialise(placed.groupBy(F.col("doc_id").alias("_doc"),
                                         F.col("text_hash").alias("_hash"))
                          .count().filter("count > 1").drop("count"), "repeats")
    if repeats.isEmpty():
        return kept
    again = kept.join(repeats, same(kept, repeats), "left_semi")
    return (kept.join(repeats, same(kept, repeats), "left_anti")
            .unionByName(again.dropDuplicates([doc_id, text])))
