"""Distinct counts from merged states against sets in Python."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from sigspark.operators import distinct as DS

D0 = dt.date(2024, 1, 27)


def _rows(n=3000, seed=5):
    r = random.Random(seed)
    out = [(r.choice(["a", "b", None]), D0 + dt.timedelta(r.randrange(20)), int(r.paretovariate(0.4)) % 10 ** 7 - 50) for _ in range(n)]
    return out + [("a", None, 7), ("c", D0, None), ("d", D0, 0), ("d", D0, -1), ("d", D0, 1), ("d", D0, 32768), ("d", D0, 32769), ("d", D0, -32768)]


def _start(period, day):
    if period == "all":
        return None
    if period == "day":
        return day
    if period == "week":
        return day + dt.timedelta(6 - day.weekday())
    nxt = (day.replace(day=28) + dt.timedelta(4)).replace(day=1)
    return nxt - dt.timedelta(1)


def _brute(rows, with_key=True):
    sets = {}
    for k, day, v in rows:
        for p in DS.PERIODS:
            if v is not None and (day is not None or p == "all"):
                sets.setdefault((k if with_key else "", p, _start(p, day)), set()).add(v)
    return {k: len(v) for k, v in sets.items()}


def _df(spark, rows):
    return spark.createDataFrame(rows, "k string, day date, v long").repartition(3)


def _got(df):
    return {(r.k if "k" in df.columns else "", r.period, r.start): r.n for r in df.collect()}


def test_batches_merge_to_the_whole(spark, tmpdir_path):
    rows = _rows()
    st = DS.DistinctStates(spark, tmpdir_path + "/s", ["k"], "day", buckets=4)
    assert st.counts() is None
    parts = [rows[:1000], rows[900:2000], rows[2000:]]  # the first two overlap
    for i, part in enumerate(parts):
        st.add(_df(spark, part), "v", version=i)
    assert _got(st.counts()) == _brute(rows)
    assert _got(st.counts([])) == _brute(rows, with_key=False)
    st.add(_df(spark, parts[2]), "v", version=2)  # a repeated epoch
    st.add(_df(spark, parts[0]), "v")             # rows that came before
    assert _got(st.counts()) == _brute(rows)


def test_a_batch_writes_the_buckets_of_its_days(spark, tmpdir_path):
    st = DS.DistinctStates(spark, tmpdir_path + "/s", ["k"], "day", buckets=16)
    st.add(_df(spark, _rows()), "v")
    before = st.table.manifest()["buckets"]
    late = _df(spark, [("a", D0, 10 ** 6 + 1)])
    hit = {str(b) for b in st.table.touched(late)}
    st.add(late, "v")
    after = st.table.manifest()["buckets"]
    assert len(hit) == 1 and {b for b in after if after[b] != before.get(b)} == hit
    assert _got(st.counts()) == _brute(_rows() + [("a", D0, 10 ** 6 + 1)])


def test_empty_batch(spark, tmpdir_path):
    st = DS.DistinctStates(spark, tmpdir_path + "/s", ["k"], "day")
    st.add(_df(spark, []), "v")
    assert st.counts().collect() == []
    st.add(_df(spark, [("a", D0, 3)]), "v")
    assert _got(st.counts(periods=("day",))) == {("a", "day", D0): 1}


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60000).select((F.col("id") % 3).alias("k"), (F.col("id") % 5).alias("day"),
                                   F.concat(F.lit("u"), (F.col("id") % 20000).cast("string")).alias("v"))
    states = DS.sketch_states(df, ["k", "day"], "v")
    for r in DS.sketch_counts(states, ["k"]).collect():
        assert abs(r.n - 20000) < 4 * 1.04 / 64 * 20000
    assert abs(DS.sketch_counts(states, []).first().n - 20000) < 4 * 1.04 / 64 * 20000
