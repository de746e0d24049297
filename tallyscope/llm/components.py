"""Distributed connected components by alternating large-star and small-star steps.

A step takes the smallest neighbour of every node (an aggregate with a map-side part, so a hub costs one row for each
task) and joins it back onto the edges. That side is broadcast while the edges, and so the nodes, are counted to be few.
Beyond that it is written first: the join then has plain shuffles on both sides, and adaptive execution can split the
partition of a hub. No neighbour list is ever gathered. Every round is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyscope.llm.common import SMALL, materialize


def _joined(edges: DataFrame, least: DataFrame, key: str, small: bool) -> DataFrame:
    return edges.join(F.broadcast(least), key) if small else edges.join(materialize(least, "least").hint("merge"), key)


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = edges.select(F.inline(ends))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _joined(both, least, "u", small).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    # an edge leads its upper end, and its lower end if that is not the least, to the least neighbour of the upper
    return _joined(edges, least, "a", small).select(F.inline(ends)).where("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, and their number and a mark of their contents."""
    seen = Observation()
    # the sum of hashes doesn't depend on the order of the rows
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("mark"))
    table = materialize(marked, "edges")
    return table, (seen.get["n"], seen.get["mark"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of `edges` other than the smallest of its component, that smallest node.

    Edges with a null end and loops are ignored; repeated edges and either direction count once. An empty edge table
    gives an empty result. Raises RuntimeError if `max_rounds` rounds don't settle it (they halve the graph at least).
    """
    x, y = F.col(left), F.col(right)
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.greatest(x, y).alias("a"), F.least(x, y).alias("b")
    )
    most = SMALL if now.schema["a"].dataType.simpleString() in ("int", "bigint") else SMALL // 16
    now, mark = _written(now.distinct())
    for _ in range(max_rounds):
        small = mark[0] <= most
        seen = mark
        if mark[0]:
            now, mark = _written(_small_star(_large_star(now, small), small))
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
