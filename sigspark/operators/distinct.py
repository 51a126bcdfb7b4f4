"""Distinct counts from stored states that merge (A5).

``count(DISTINCT ...)`` of several columns or periods expands every row once
per count and has to read all rows again for each period. Here a state is
kept per key and day: the set of ids as bitmaps of 32,768 ids each. States of
batches merge by ``or``, so a batch reads and writes only the buckets of its
own days, a repeated batch changes nothing, and any coarser count (weeks,
months, all days, fewer keys) is the ``or`` of the states below it, exact, with
no look at the rows.

Bitmaps are meant for ids that lie close together (a row of state costs up to
4 KB and covers 32,768 ids). For scattered ids and strings there are sketches
of fixed size (``sketch_states``), which merge in the same way and whose counts
are estimates: their relative standard error is about 1.04 / sqrt(2^lg_k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bucketed import BucketTable
from ..session import stored_once
from .relational import bucket

PERIODS = ("day", "week", "month", "all")


def bitmap_states(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, slot, bits: the different integers ``value`` of each key (nulls
    are not counted, as in ``count(DISTINCT)``; null keys are a key)."""
    v = F.col(value).cast("long")
    rows = df.filter(v.isNotNull()).select(*keys, F.bitmap_bucket_number(v).alias("slot"), F.bitmap_bit_position(v).alias("_at"))
    return rows.groupBy(*keys, "slot").agg(F.bitmap_construct_agg("_at").alias("bits"))


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and slot."""
    return states.groupBy(*keys, "slot").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_counts(states: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Exact distinct counts for ``keys``, any of the states' keys."""
    one = merged(states, keys).select(*keys, F.bitmap_count("bits").alias("_c"))
    return one.groupBy(*keys).agg(F.sum("_c").alias(name))


def sketch_states(df: DataFrame, keys: list[str], value: str, lg_k: int = 12) -> DataFrame:
    """keys, sketch: a sketch of the different values of each key."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value), lg_k).alias("sketch"))


def sketch_counts(states: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Estimated distinct counts for ``keys``, any of the states' keys."""
    return states.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def by_period(states: DataFrame, day: str, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """Every state once for each period: ``period``, ``start`` (the day, the
    week's Sunday, the month's last day; null for all days). States without a
    day count for all days only."""
    def start(p: str) -> Column:
        return F.lit(None).cast("date") if p == "all" else bucket(F.col(day), p)
    each = F.array(*[F.struct(F.lit(p).alias("period"), start(p).alias("start")) for p in periods])
    rows = states.withColumn("_p", F.explode(each)).select("*", "_p.period", "_p.start").drop("_p")
    return rows.filter(F.col("start").isNotNull() | (F.col("period") == "all"))


class DistinctStates:
    """Bitmap states per key and day in a bucketed table."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], day: str, buckets: int = 32):
        self.keys, self.day = keys, day
        self.table = BucketTable(spark, path, [day], buckets)

    def add(self, rows: DataFrame, value: str, version: int | None = None) -> None:
        """Merge a batch of rows; ``version`` names it (the epoch of a stream)."""
        keys = [*self.keys, self.day]
        states = stored_once(bitmap_states(rows, keys, value), "distinct-states")
        self.table.commit(states, lambda old, new: merged(old.unionByName(new), keys), version=version)
        self.table.vacuum(keep=3)

    def counts(self, keys: list[str] | None = None, periods: tuple[str, ...] = PERIODS, name: str = "n") -> DataFrame | None:
        """Distinct counts for every period and some of the keys; None before the first batch."""
        states = self.table.read()
        if states is None:
            return None
        keys = self.keys if keys is None else keys
        return bitmap_counts(by_period(states, self.day, periods), [*keys, "period", "start"], name)
