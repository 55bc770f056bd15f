"""Small helpers that several operators share: columns, row keys, Arrow batches, words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` that an operator's own output columns do not replace.

    Spark compares names without case, so a column ``N_Words`` gives way to ``n_words``.
    """
    made = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in made]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has one of them; for columns on the way only."""
    taken, mark = {c.lower() for c in df.columns}, ""
    while any((n + mark).lower() in taken for n in names):
        mark += "_"
    return [n + mark for n in names]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart that share a doc_id; equal rows share it and get equal results."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def bounded_batches(batches, most_bytes: int = 16 << 20):
    """Slices of Arrow batches of at most about ``most_bytes``; one long row may exceed it."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, int(rows * most_bytes / max(batch.nbytes, 1))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def append(batch: pa.RecordBatch, keep: list[str], made: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    return pa.RecordBatch.from_arrays([*arrays, *made.values()], names=[*keep, *made])


def schema_of(df: DataFrame, keep: list[str], made: str) -> str:
    """DDL of the kept columns followed by ``made``."""
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), made])
