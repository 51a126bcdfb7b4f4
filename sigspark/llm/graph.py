"""Connected components by alternating large and small stars.

Only joins, counts and minima of edges: nothing is gathered in one task or on
the driver, and hubs combine before each shuffle or are split by Spark's
skewed joins. The edges of every round are stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _round(e: DataFrame) -> DataFrame:
    """Large star, then small star, over edges u < v."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = (both.join(low, "x").where("y > x")
             .select(F.col("m").alias("u"), F.col("y").alias("v")).distinct())
    least = large.groupBy("v").agg(F.min("u").alias("m"))
    linked = large.join(least, "v")
    return (linked.where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b"))
            .unionByName(linked.select(F.col("m").alias("a"), F.col("v").alias("b")))
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) of every id on an edge."""
    e = stored(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
               .where("u < v").distinct(), "edges")

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = None
    now = state(e)
    while now != before:
        e = stored(_round(e), "edges")
        before, now = now, state(e)
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(
        e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
