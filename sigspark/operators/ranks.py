"""Global order without one task: places and running sums over range partitions.

Rows are dealt into ranges of the order, stored with the number of their range,
and numbered inside it; what lies before a range is the sum over the ranges
before (one row a range). Used for pages of a sorted list (W6), dense node
indexes (U3), running totals (W1) and new ids (S11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored_once


def _dealt(df: DataFrame, order: list[Column], value: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with their range, range and the sum of ``value`` before it)."""
    rows = df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_value": value})
    rows = stored_once(rows, "ranges")
    sums = rows.groupBy("_range").agg(F.sum("_value").alias("_sum"))  # a row for each partition
    before = F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return rows, sums.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with this one.
    The order must be total for a repeatable result."""
    rows, before = _dealt(df, order, value)
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_own", F.sum("_value").over(own)).join(before, "_range")
            .withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_value", "_own", "_before"))


def place(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with its place (from 1) in the order."""
    return running(df, order, F.lit(1).cast("long"), name)


def pages(df: DataFrame, order: list[Column], size: int = 12, name: str = "page") -> DataFrame:
    """Every row with its page (from 1) and its place on that page."""
    rows = place(df, order, "_place")
    return rows.withColumns({name: F.floor((F.col("_place") - 1) / size) + 1,
                             "place": F.pmod(F.col("_place") - 1, F.lit(size)) + 1}).drop("_place")
