"""Checks that need one row at a time, counted while a mart is written: no pass of their own.

The counts are metrics observed at the top of the plan that is written, so they come from the
tasks that write the files, each counted once however often an executor is lost. Checks that
compare rows with each other (repeated keys, reconciliation) stay queries of ``quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..durable import fresh_path, write_partitioned
from .quality import INCONSISTENT_FLAGS, NEGATIVE_MAGNITUDE, REQUIRED, is_implausible

#: Plausible ranges that apply to the columns of a mart.
_RANGES = {"beneish": ("m_score",), "altman": ("z_score",),
           "accrual_returns": ("fwd_return_12m",)}


def row_checks(mart: str) -> dict[str, Column]:
    """Name and condition of each check on single rows of a mart; true is a violation."""
    checks = {f"null {c}": F.col(c).isNull() for c in REQUIRED.get(mart, ())}
    checks |= {f"implausible {c}": is_implausible(c) for c in _RANGES.get(mart, ())}
    if mart == "staged":
        checks["negative magnitudes"] = F.expr(NEGATIVE_MAGNITUDE)
    if mart == "screener":
        checks["inconsistent flag counts"] = F.expr(INCONSISTENT_FLAGS)
    return checks


def write_checked(df: DataFrame, mart: str, path: str | None = None,
                  partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Write ``df`` as Parquet; returns a scan of it and the violations per check, in one pass.

    The dictionary also holds ``rows``, the number of rows written. An empty table violates
    nothing. Without ``path`` the table gets a new folder in the shared one.
    """
    path = path or fresh_path(df.sparkSession, mart)
    checks = row_checks(mart)
    # Metrics have short names of their own, as those of checks hold spaces.
    names = {f"c{i}": name for i, name in enumerate(checks)}
    seen = Observation(mart)
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"),
                         *[F.count_if(checks[name]).alias(c) for c, name in names.items()])
    write_partitioned(counted, path, partition_by)
    found = {names.get(c, c): n for c, n in seen.get.items()}
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns), found


def violations(found: dict[str, dict[str, int]], like: DataFrame) -> DataFrame:
    """(mart, check, violations) of several marts as a table; a row per check, not per row."""
    rows = [(mart, check, n) for mart, counts in found.items() for check, n in counts.items()]
    return like.sparkSession.createDataFrame(rows, "mart string, check string, violations long")
