"""Connected components of a graph given by its edges, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (u, v), u > v: every node's neighbours (large: of any size, small: lesser ones) move to the least of them.

    The least neighbour comes from a map-side combined aggregate and is joined back, so a node of any degree is spread over tasks.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node that it reaches; nodes without an edge are not given.

    Large-star and small-star operations alternate until the edges are stars,
    a number of rounds that grows with the logarithm of the graph's size.  Each
    round is a written table.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = written(now, label)
    for _ in range(rounds):
        # edges that are stars already: no root is a leaf, every leaf has one root
        test = now.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        bad = test.filter("n > 1").select(F.lit(1).alias("x")).limit(1).unionByName(now.join(now.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1).alias("x")).limit(1))
        if bad.isEmpty():
            break
        nxt = written(_star(_star(now, True), False), label)
        drop_written(now)
        now = nxt
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
