"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.session import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b) -> one row (node, root) per node that has an edge, root the smallest node of its component.

    Each step replaces a node's edges by edges to its smallest neighbour (a pre-aggregated minimum and a join, never a
    list of neighbours), so the number of steps grows with the logarithm of the component and no component is gathered
    anywhere. Every step is a written table. Null ends and loops are ignored; an empty table gives an empty result.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .where("u > v and a is not null and b is not null").distinct(), name)
    mark = _mark(now)
    while True:
        now = materialize(_small_star(_large_star(now)), name)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    linked = both.join(least, F.col("u") == F.col("n")).where("v > u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    linked = edges.join(least, F.col("u") == F.col("n"))
    own = least.select(F.col("n").alias("u"), F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(own).distinct()
