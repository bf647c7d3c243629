"""Connected components by alternating large-star and small-star, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.llm.frames import FILE_ROWS, stored


def _larger_first(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _larger_first(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node is tied, with its smaller neighbours, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _larger_first(tied.unionByName(least.select("u", F.col("m").alias("v")))).distinct()


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): the smallest node that each node of an edge list can reach.

    Nodes are numbers. Loops, repeated edges and edges with a null end count for nothing, nodes without another
    edge are left out, and an empty list gives an empty table. A hub is reduced by partial minima before the
    shuffle, no neighbourhood is collected. Each round is written to the shared folder, which cuts the lineage;
    its files and tasks follow the number of edges.
    """
    now = _larger_first(edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
                        .filter("u is not null and v is not null"))
    now = stored(now.distinct(), "edges")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        files = mark[0] // FILE_ROWS + 1
        now = stored(_small_star(_large_star(now).coalesce(files)), "edges", mark[0])
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components", 2 * (state or [0])[0])
