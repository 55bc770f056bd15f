"""Product quantisation of vectors: codes of nearest codebook entries, part by part.

Vectors are cut into equal parts; each part position has a codebook that a few rounds of exact
integer k-means move. Blocks of rows are made into anchors-hierarchy trees once, one tree per part
position, and written to the shared folder; every round reads them. A ball that one entry owns adds
its cached count and sum to it, so a round looks at few points. What moves between tasks is one row
per codebook entry and task.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from .anchors import BallTree, assigned, build, sums
from .rows import schema_of, without

#: Rows whose parts make one tree each.
BLOCK = 4096
#: Scaled components stay below this, so that every distance and sum is exact in 64 bits.
LIMIT = 1 << 24
_ARRAYS = 7


def usable(vec: str) -> F.Column:
    """Whether a vector is neither null nor empty and holds finite components only."""
    column = F.col(f"`{vec}`")
    # Null or NaN makes the comparison fail; an empty vector has no parts.
    return (F.coalesce(F.forall(column, lambda x: F.coalesce(
        (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))), F.lit(False))
        & (F.size(column) > 0))


def scaled(vectors: pa.Array, width: int) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = np.floor(256 * values)
    if len(found) and np.abs(found).max() >= LIMIT:
        raise ValueError(f"vector components of {LIMIT // 256} and more are not supported")
    return found.astype(np.int64).reshape(-1, width)


def _trees(kept: DataFrame, columns: list[str], vec: str, width: int, parts: int) -> DataFrame:
    kinds = dict(kept.dtypes)
    row = ", ".join(f"`{k}`: {kinds[k]}" for k in columns)
    source = kept.select(F.struct(*(F.col(f"`{k}`") for k in columns)).alias("row"),
                         F.col(f"`{vec}`").alias("vec"))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = scaled(batch.column(1), width)
        packed = [a for part in np.split(numbers, parts, axis=1)
                  for a in build(np.ascontiguousarray(part)).pack()]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
             pa.array([packed], pa.list_(pa.binary()))], names=["rows", "trees"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                size += held[-1].num_rows
                if size >= BLOCK:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield block(whole.slice(0, BLOCK))
                    held, size = [whole.slice(BLOCK)], size - BLOCK
        if size:
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return source.mapInArrow(run, f"rows array<struct<{row}>>, trees array<binary>")


def _of(batch: pa.RecordBatch, i: int, width: int) -> list[BallTree]:
    arrays = batch.column("trees")[i].as_py()
    return [BallTree.unpack(arrays[k:k + _ARRAYS], width) for k in range(0, len(arrays), _ARRAYS)]


def _moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose used entries are the floored means of the parts nearest to them."""
    parts, entries, width = books.shape
    names = [f"t{k}" for k in range(width)]

    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros(books.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, tree in enumerate(_of(batch, i, width)):
                    n, t = sums(tree, books[p])
                    count[p] += n
                    total[p] += t
        slot = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot, pa.int32()), pa.array(count.ravel()[slot]),
             *(pa.array(total.reshape(-1, width)[slot, k]) for k in range(width))],
            names=["slot", "n", *names])

    added = (trees.select("trees").mapInArrow(
        run, "slot int, n long, " + ", ".join(f"{t} long" for t in names))
        .groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in names)))
    new = books.reshape(-1, width).copy()
    for r in added.collect():  # one row per codebook entry
        new[r.slot] = [r[t] // r.n for t in names]
    return new.reshape(books.shape)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2,
                 vec_id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(``vectors`` without ``vec`` but with ``code`` and ``error``, codebooks).

    Each component x counts as floor(256 x). The codebook of a part position starts as that part
    of the rows with the ``entries`` smallest ids; each round assigns all parts to the nearest
    entry (lower index in a tie) and moves every used entry to the floored mean of its parts.
    ``code`` has two hex digits per part, ``error`` the squared distances summed over the parts.

    Rows whose vector is null, empty or holds null or non-finite components are left out, and so
    are those whose length is not that of the row with the smallest id. Lengths that ``parts`` does
    not divide and components from 65,536 on raise ValueError. Ids may repeat; rows of equal ids
    are ordered by their vectors, null ids come last. Fewer rows than ``entries`` make smaller
    codebooks, none make none. Columns of ``vectors`` named ``code`` or ``error`` are replaced, all
    others are carried along.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits, so at most 256 entries")
    spark = vectors.sparkSession
    columns = without(vectors, [vec, "code", "error"])
    schema = schema_of(vectors, columns, "code string, error long")
    good = vectors.filter(usable(vec))
    ident, column = F.col(f"`{vec_id}`"), F.col(f"`{vec}`")
    least = good.agg(F.min(F.struct(ident.isNull(), ident, F.size(column).alias("size")))).head()[0]
    if least is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = least["size"]
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    kept = good.filter(F.size(column) == width)
    seeds = kept.select(ident.alias("i"), column.alias("v")).orderBy(
        F.col("i").asc_nulls_last(), "v").limit(entries).toArrow()
    books = scaled(seeds.column("v").combine_chunks(), width)
    books = np.ascontiguousarray(books.reshape(-1, parts, width // parts).transpose(1, 0, 2))
    trees = materialise(_trees(kept, columns, vec, width, parts), "trees")
    for _ in range(rounds):
        books = _moved(trees, books)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = [assigned(t, b) for t, b in zip(_of(batch, i, width // parts), books)]
                code = np.stack([e for e, _ in found], 1).astype(np.uint8).tobytes().hex()
                rows = batch.column("rows")[i].values
                yield pa.RecordBatch.from_arrays(
                    [*(rows.field(k) for k in range(len(columns))),
                     pa.array([code[k:k + 2 * parts] for k in range(0, len(code), 2 * parts)]),
                     pa.array(np.sum([d for _, d in found], axis=0))],
                    names=[*columns, "code", "error"])

    return trees.mapInArrow(run, schema), books


def with_group_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over rows of equal labels, nulls too.

    Sums combine before the shuffle; the join meets one row per label.
    """
    whole = materialise(coded.drop("label_error"), "codes")
    total = whole.groupBy(F.col(f"`{label}`").alias("_of")).agg(F.sum("error").alias("label_error"))
    return whole.join(total, whole[f"`{label}`"].eqNullSafe(total["_of"])).drop(total["_of"])
