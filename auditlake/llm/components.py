"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component), the smallest id reachable; only ids that have an edge. Null ids have none.

    Every round is a few joins over a written edge table, whose last form is one edge from each id to its
    component. Neighbourhoods are reduced to their minimum before they are joined, never gathered. Rounds go on until
    the edges no longer change; their number grows as the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(down, F.col("u") == F.col("c"))
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        )
        after = written(small.where("u <> v").distinct(), "edges")
        discard(spark, now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free sum of the edges: equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
