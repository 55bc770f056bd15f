"""Written tables in the shared folder: the one way this library cuts lineage.

A written table survives the loss of an executor and keeps column pruning and filter pushdown
for its readers. The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
local session that names none gets a folder of its own, as in tests.
"""

from __future__ import annotations

import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="asfiled-")


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/asfiled-{uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to a new folder and return a scan of what was written."""
    path = fresh_path(df.sparkSession, label)
    write_partitioned(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_partitioned(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Write Parquet by the values of some columns, in few files of about the advisory size.

    Rows are dealt by those columns first, else every task would add a file to every folder. The
    hint leaves it to the runtime to split what is large and to merge what is small, so a value
    that a third of all rows share is written by many tasks.
    """
    if partition_by:
        even = df.hint("rebalance", *map(F.col, partition_by))
        even.write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
