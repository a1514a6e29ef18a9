"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_table


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _least_neighbour(edges: DataFrame, name: str) -> DataFrame:
    return work_table(edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("least")), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches; root is the least
    node reachable. Edges stay in written tables: each round reduces to the
    least neighbour per node with map-side partial results and joins it back
    from a table of its own, so that a hub's partition can be split."""
    edges = work_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least_neighbour(both, "large-star")
        large = both.where("b > a").join(least, F.col("a") == F.col("of"))
        large = work_table(large.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct(), "large-edges")
        least = _least_neighbour(large, "small-star")
        small = large.join(least, F.col("a") == F.col("of")).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = work_table(small.union(least.select(F.col("of").alias("a"), F.col("least").alias("b"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
