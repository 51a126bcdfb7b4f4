"""Heavy hitters against plain counts, with bins so few that they must collide."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sigspark.operators import heavy as H


def _rows(seed: int):
    r = random.Random(seed)
    out = [("flat", [f"f{i}"]) for i in range(60)]                        # all alike: every value counts once
    out += [("zipf", [f"z{int(r.paretovariate(0.9))}" for _ in range(20)]) for _ in range(120)]
    out += [(None, ["n1", "n1", "n2", None]), (None, ["n3"]), ("few", ["only"]), ("empty", []), ("null", None), ("hole", [None])]
    # two heavy values among many that share their bins
    out += [("mixed", ["a"] * 30 + ["b"] * 29 + [f"m{r.randrange(400)}" for _ in range(300)])]
    return out


def _brute(rows, k):
    by = defaultdict(Counter)
    for g, vs in rows:
        by[g].update(v for v in vs or [] if v is not None)
    return {(g, i + 1, v, n) for g, c in by.items()
            for i, (v, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k])}


@pytest.mark.parametrize("width, first, most", [(1, 1, 99), (7, 1, 99), (64, 2, 10 ** 6), (1 << 14, 8, 10 ** 6), (64, 2, 3), (64, 1, 20)])
def test_top_equals_full_counts(spark, width, first, most):
    rows = _rows(width)
    d = spark.createDataFrame(rows, "g string, vs array<string>").repartition(5)
    h = H.heavy_hitters(d, ["g"], F.col("vs"), 4, width, first, most)
    assert {(r.g, r.place, r.value, r.n) for r in h.top.collect()} == _brute(rows, 4)
    whole = H.heavy_hitters(d, [], F.col("vs"), 4, width, first, most)
    assert {(None, r.place, r.value, r.n) for r in whole.top.collect()} == _brute([(None, v) for _, v in rows], 4)


def test_values_of_bins_below_the_floor_are_not_counted(spark):
    r = random.Random(1)
    rows = [(["top1"] * 9 + ["top2"] * 7 + [f"w{r.randrange(10 ** 6)}" for _ in range(30)],) for _ in range(200)]
    d = spark.createDataFrame(rows, "vs array<string>")
    h = H.heavy_hitters(d, [], F.col("vs"), 2, width=1024, first=2)
    assert [(x.value, x.n) for x in h.top.orderBy("place").collect()] == [("top1", 1800), ("top2", 1400)]
    assert not h.again and h.counted.count() < 100  # of some 6000 values


def test_a_bin_beyond_the_first_is_counted_if_it_reaches_the_floor(spark):
    # one bin is full of rare values, so the one heavy value lies in the second bin
    width = 2
    names = spark.range(3000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("v")) \
                 .withColumn("bin", F.pmod(F.xxhash64("v"), F.lit(width))).collect()
    rare, other = [x.v for x in names if x.bin == 0], [x.v for x in names if x.bin == 1]
    d = spark.createDataFrame([(rare + [other[0]] * 50,)], "vs array<string>")
    h = H.heavy_hitters(d, [], F.col("vs"), 1, width, 1)
    assert [(x.value, x.n) for x in h.top.collect()] == [(other[0], 50)] and h.again


def test_grid(spark):
    rows = _rows(3)
    d = spark.createDataFrame(rows, "g string, vs array<string>")
    got = {(r.g, r.value): r.n for r in H.heavy_grid(d, "g", F.col("vs"), 3, 3).collect()}
    per = {}
    for g, vs in rows:
        if g is not None:
            per.setdefault(g, Counter()).update(v for v in vs or [] if v is not None)
    whole = sum(per.values(), Counter())
    gs = sorted((g for g in per if per[g]), key=lambda g: (-sum(per[g].values()), g))[:3]
    vs = sorted(whole, key=lambda v: (-whole[v], v))[:3]
    assert got == {(g, v): per[g][v] for g in gs for v in vs}


def test_empty_table(spark):
    d = spark.createDataFrame([], "g string, vs array<string>")
    h = H.heavy_hitters(d, ["g"], F.col("vs"), 3)
    assert h.top.collect() == [] and not h.again
    assert H.heavy_grid(d, "g", F.col("vs"), 3, 3).collect() == []
