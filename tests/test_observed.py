"""Run statistics that the writes themselves observe."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.sinks import write_observed
from sigspark.streaming import jobs

SCHEMA = "k string, id long, size int"


def _run(spark, tmp):
    return jobs.observed_batches(f"{tmp}/out", f"{tmp}/seen", F.col("size") >= 20, ["k"], ["id"], buckets=4)


def _stats(spark, tmp):
    rows = spark.read.schema(jobs.STATS_SCHEMA + ", epoch int").parquet(f"{tmp}/out/stats").collect()
    return {r.epoch: (r.fetched, r.parsed, r.errors, r.new) for r in rows}


def test_epochs_count_their_own_rows_once(spark, tmpdir_path):
    run = _run(spark, tmpdir_path)
    first = spark.createDataFrame([("a", 1, 30), ("a", 2, 40), ("b", 3, 19), ("c", 4, None), ("d", 5, 20), (None, 6, 50)], SCHEMA).repartition(3)
    second = spark.createDataFrame([("a", 7, 30), ("b", 8, 21), ("e", 9, 22), ("d", 10, 1), (None, 11, 60)], SCHEMA).repartition(2)
    run(first, 0)
    assert _stats(spark, tmpdir_path) == {0: (6, 4, 2, 3)}
    run(second, 1)
    want = {0: (6, 4, 2, 3), 1: (5, 4, 1, 2)}
    assert _stats(spark, tmpdir_path) == want
    run(second, 1)  # a retried batch
    assert _stats(spark, tmpdir_path) == want
    new = spark.read.parquet(f"{tmpdir_path}/out/new").collect()
    assert sorted((r.id, r.k) for r in new) == [(1, "a"), (5, "d"), (6, None), (8, "b"), (9, "e")]
    kept = spark.read.parquet(f"{tmpdir_path}/out/landed").filter(~F.col("parsed"))
    assert sorted(r.id for r in kept.collect()) == [3, 4, 10]


def test_empty_batch(spark, tmpdir_path):
    run = _run(spark, tmpdir_path)
    run(spark.createDataFrame([], SCHEMA), 0)
    run(spark.createDataFrame([("x", 1, 3)], SCHEMA), 1)  # nothing parses
    assert _stats(spark, tmpdir_path) == {0: (0, 0, 0, 0), 1: (1, 0, 1, 0)}


def test_metrics_of_a_write(spark, tmpdir_path):
    df = spark.range(100).repartition(7)
    got = write_observed(df, f"{tmpdir_path}/w", {"n": F.count(F.lit(1)), "top": F.max("id")})
    assert got == {"n": 100, "top": 99} and spark.read.parquet(f"{tmpdir_path}/w").count() == 100
