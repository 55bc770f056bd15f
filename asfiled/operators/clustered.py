"""Tables that keep their distribution by company, so that later reads need no exchange.

A bucket is read by one task. Companies with more rows than one task may hold are therefore kept
apart in a table without buckets, which any number of tasks read; what is built from both parts
is put together again. Each result row must depend on the rows of one company only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame

from ..durable import fresh_path, materialise
from .volume import ROW_LIMIT, heavy_keys, part_by_volume, tasks_for


def write_clustered(df: DataFrame, label: str, buckets: int | None = None, key: str = "entity_id",
                    row_limit: int = ROW_LIMIT) -> list[DataFrame]:
    """Write ``df`` as a table of ``buckets`` by ``key``; returns its parts as scans.

    The first part is an external table ``label_<unique>`` of the session's catalog in the shared
    folder, one file per bucket. A bucket is one task's share, so their number follows from the
    rows of ``df``; ``buckets`` is the least, by default one per core. The second one,
    there only if a key has more than ``row_limit`` rows, holds the rows of such keys. Rows
    without a key share a bucket, or the second part if they are many. No row is lost or doubled.
    """
    buckets = max(buckets or 1, tasks_for(df.count(), df.sparkSession))
    heavy = heavy_keys(df, [key], row_limit)
    ordinary, hot = (df, None) if heavy is None else part_by_volume(df, heavy, [key])
    name = f"{label}_{uuid4().hex}"
    # Tasks hold the rows of one bucket each, else every task would add a file to every bucket.
    (ordinary.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", fresh_path(df.sparkSession, label)).saveAsTable(name))
    parts = [df.sparkSession.table(name).select(*df.columns)]
    return parts if hot is None else [*parts, materialise(hot.select(*df.columns), label)]


def over_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` makes of each part, as one table."""
    return reduce(DataFrame.unionByName, map(build, parts))
