"""Connected components of a set of edges, as joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node hands the smallest node it knows to its larger, or to its other neighbours.

    An edge makes one row at most, besides the minima; the same row may come several times.
    """
    if larger:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        passed = both.join(least, "u").filter("v > u").selectExpr("v as u", "m as v")
    else:
        down = edges.selectExpr("greatest(u, v) as u", "least(u, v) as v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        passed = (down.join(least, "u").selectExpr("v as u", "m as v")
                  .unionByName(least.selectExpr("u", "m as v")))
    return passed.filter("u <> v")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and none of these has one itself."""
    ends = edges.selectExpr("stack(2, u, 1L, 0L, v, 0L, 1L) as (node, smaller, larger)")
    return (ends.groupBy("node")
            .agg(F.sum("smaller").alias("smaller"), F.sum("larger").alias("larger"))
            .filter("smaller > 1 or smaller = 1 and larger > 0").isEmpty())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); the smallest node names it.

    Rounds of large and small stars halve the paths, so their number grows with the logarithm of
    the longest one. Hubs are met by minima, never by a list of their neighbours. Each round is
    written to the shared folder; the driver only learns whether stars are all that is left.
    """
    edges = materialise(edges.filter("u <> v").selectExpr(
        "greatest(u, v) as u", "least(u, v) as v").distinct(), "edges")
    while not _is_star_forest(edges):
        edges = materialise(_star(_star(edges, True), False).distinct(), "edges")
    return edges.selectExpr("u as node", "v as component").unionByName(
        edges.selectExpr("v as node", "v as component").distinct())
