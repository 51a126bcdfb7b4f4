"""Most frequent values of each group, exact, without counting every value
(A22, A24, T4).

A plain count shuffles every different value of every task to keep a few.
Here values are hashed into bins first, and only the counts of bins are
shuffled: at most ``width`` rows a group and task, whatever the vocabulary.
The count of a bin is an upper bound for each value in it, so:

1. the values of the ``first * k`` fullest bins of a group are counted one by
   one; the k-th largest of these counts is a floor that the group's true k-th
   count cannot lie below (with fewer than k values the floor is 1);
2. a bin that holds less than the floor holds no value of the top k. Bins that
   reach it and were not among the first are counted one by one, too.

Nothing is estimated: the result equals the full count for every width and
data set. ``width`` and ``first`` only decide how many values are counted; if
frequencies are so flat that every bin reaches the floor, that is all of them.
The bins to be counted are stored and broadcast if they are ``MOST_BINS`` rows
at most, so that other elements are dropped where they are read; with more
(very many groups) all values are counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored_once

WIDTH, FIRST, MOST_BINS = 1 << 14, 8, 200_000


@dataclass
class Heavy:
    """``top``: group columns, value, n, place (1..k). ``counted``: group
    columns, value, n of every value that was counted one by one. ``again``:
    whether bins beyond the first had to be counted."""
    top: DataFrame
    counted: DataFrame
    again: bool


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side gives its other columns."""
    r = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    cond = reduce(lambda a, b: a & b, same) if same else F.lit(True)
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in keys])


def _placed(df: DataFrame, groups: list[str], *ties: str) -> DataFrame:
    # without groups: one group of ``width`` bins or of the values counted
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(F.desc("n"), *ties)
    return df.withColumn("place", F.row_number().over(w))


def heavy_hitters(df: DataFrame, groups: list[str], values: Column, k: int, width: int = WIDTH,
                  first: int = FIRST, most: int = MOST_BINS) -> Heavy:
    """The k most frequent elements of the array ``values`` in each group, ties
    by value. Null elements do not count; null group values are a group."""
    rows = df.select(*groups, F.explode(values).alias("value")).filter(F.col("value").isNotNull()) \
             .withColumn("bin", F.pmod(F.xxhash64("value"), F.lit(width)).cast("int"))
    one = F.count(F.lit(1)).alias("n")
    bins = _placed(stored_once(rows.groupBy(*groups, "bin").agg(one), "heavy-bins"), groups, "bin")

    def counts(some: DataFrame) -> DataFrame:
        mine = _joined(rows, F.broadcast(some), [*groups, "bin"])  # ``most`` rows at most
        return stored_once(mine.groupBy(*groups, "value").agg(one), "heavy-counts")

    def chosen(some: DataFrame) -> tuple[DataFrame, int]:
        some = stored_once(some.select(*groups, "bin"), "heavy-chosen")
        return some, some.count()

    def whole() -> Heavy:
        every = stored_once(rows.groupBy(*groups, "value").agg(one), "heavy-counts")
        return Heavy(_placed(every, groups, "value").filter(F.col("place") <= k), every, True)

    fullest, n = chosen(bins.filter(F.col("place") <= first * k))
    if n > most:
        return whole()
    counted = counts(fullest)
    floor = _placed(counted, groups, "value").filter(F.col("place") <= k).groupBy(*groups).agg(
        F.when(F.count(F.lit(1)) == k, F.min("n")).otherwise(1).alias("floor"))
    beyond = _joined(bins.filter(F.col("place") > first * k), floor, groups).filter(F.col("n") >= F.col("floor"))
    rest, n = chosen(beyond)
    if n > most:
        return whole()
    again = n > 0
    if again:
        counted = counted.unionByName(counts(rest))
    return Heavy(_placed(counted, groups, "value").filter(F.col("place") <= k), counted, again)


def heavy_grid(df: DataFrame, row: str, values: Column, k_rows: int, k_values: int) -> DataFrame:
    """The rows with most elements x the most frequent elements, zero-filled:
    row, value, n. Only the counts of the grid's own values are formed by row."""
    d = df.filter(F.col(row).isNotNull())
    top = heavy_hitters(d, [], values, k_values).top.select("value")
    sizes = d.groupBy(row).agg(F.sum(F.size(F.filter(values, lambda v: v.isNotNull()))).alias("s")).filter("s > 0")
    rows = sizes.orderBy(F.desc("s"), row).limit(k_rows).select(row)
    words = top.agg(F.collect_list("value").alias("_words"))  # one row of k_values
    mine = d.join(F.broadcast(rows), row).crossJoin(F.broadcast(words))  # k_rows rows; one row
    ex = mine.select(row, F.explode(F.filter(values, lambda v: F.array_contains("_words", v))).alias("value"))
    n = ex.groupBy(row, "value").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.crossJoin(F.broadcast(top))  # k_rows x k_values
    return grid.join(n, [row, "value"], "left").select(row, "value", F.coalesce("n", F.lit(0)).alias("n"))
