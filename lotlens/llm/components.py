"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREQUENT_SHARE, frequent_limit, join_frequent, materialise

MOST_ROUNDS = 60


def _least_neighbour(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v, least): ``edges`` with the least of u and its neighbours; ``rows`` is their number at most.

    A node with very many edges meets a broadcast, so its edges stay where they are.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("_v"), F.count("*").alias("_n"))
    known = least.select("u", "_v")
    if rows <= FREQUENT_SHARE:
        joined = edges.join(known, "u")
    else:
        joined = join_frequent(edges, known, "u", least.filter(F.col("_n") > frequent_limit(rows)))
    return joined.select("u", "v", F.least("u", "_v").alias("least"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge up and none down, or none up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or up > 0 and down > 0").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (columns u, v): the least node that it reaches.

    Alternates large stars (each larger neighbour moves to the node's least neighbour) and small
    stars (each smaller one does) until the edges are stars around the least nodes, in about log n
    rounds.  Edges lead down and never leave their component, so stars have the least node in the
    middle.  Every round is written to the shared folder; frequent nodes are combined before each
    shuffle.  Loops are ignored; without edges there are no rows.
    """
    own = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    own = materialise(own, "edges")
    for _ in range(MOST_ROUNDS):
        if _are_stars(own):
            break
        rows = own.count()
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both, 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "edges")
        small = _least_neighbour(large, rows)
        small = (
            small.select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(small.select("u", F.col("least").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        own = materialise(small, "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = own.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
