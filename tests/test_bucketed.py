"""Bucketed keyed tables, seen keys and the streams that keep state in them."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from sigspark import lexicon as L
from sigspark import sinks as K
from sigspark.bucketed import BucketTable, SeenKeys, combined, newest
from sigspark.streaming import jobs


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/data/*/*/*.parquet")}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_untouched_buckets_keep_their_files(spark, tmpdir_path):
    table = BucketTable(spark, tmpdir_path + "/t", ["k"], 16)
    assert table.read() is None and table.versions() == []
    first = spark.createDataFrame([(i, 0, f"v{i}") for i in range(200)], "k long, o int, v string")
    table.commit(first, newest(["k"], "o"))
    before = dict(table.manifest()["buckets"])
    update = spark.createDataFrame([(3, 1, "new"), (3, 2, "newer"), (500, 1, "added")], "k long, o int, v string")
    hit = {str(b) for b in table.touched(update)}
    table.commit(update, newest(["k"], "o"))
    after = table.manifest()["buckets"]
    assert len(hit) < 3 and all((before.get(b) == after.get(b)) == (b not in hit) for b in set(before) | set(after))
    assert rows(table.read(), "k", "v") == sorted([(i, f"v{i}" if i != 3 else "newer") for i in range(200)] + [(500, "added")])
    assert table.read(0).count() == 200 and table.read(0, [int(min(before))]).count() < 200


def test_a_killed_write_leaves_the_old_table(spark, tmpdir_path, monkeypatch):
    table = BucketTable(spark, tmpdir_path + "/t", ["k"], 4)
    table.commit(spark.createDataFrame([(1, 1)], "k int, o int"), newest(["k"], "o"))
    monkeypatch.setattr(BucketTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        table.commit(spark.createDataFrame([(1, 2)], "k int, o int"), newest(["k"], "o"))
    monkeypatch.undo()
    assert rows(table.read(), "k", "o") == [(1, 1)] and len(files(table.path)) == 2
    table.commit(spark.createDataFrame([(1, 3)], "k int, o int"), newest(["k"], "o"))
    table.vacuum(keep=1)  # removes what the killed write left, too
    assert rows(table.read(), "k", "o") == [(1, 3)] and len(files(table.path)) == 1


def test_repeated_versions_and_any_order(spark, tmpdir_path):
    rng = random.Random(1)
    data = [(rng.randrange(40), o, f"v{o}") for o in range(300)]
    want = {}
    for k, o, v in data:
        want[k] = (k, o, v)
    schema = "k int, o int, v string"
    for seed in (1, 2):
        random.Random(seed).shuffle(data)
        path = f"{tmpdir_path}/t{seed}"
        for epoch in range(3):
            part = spark.createDataFrame(data[100 * epoch:100 * epoch + 100], schema)
            for _ in range(2):
                jobs.upsert_batches(path, ["k"], "o", buckets=8)(part, epoch)
        assert rows(BucketTable(spark, path, ["k"], 8).read(), "k", "o", "v") == sorted(want.values())
    counts = BucketTable(spark, tmpdir_path + "/c", ["k"], 8)
    for epoch in (0, 1, 1, 1):  # a retried epoch adds its rows once
        counts.commit(spark.createDataFrame([(None, 2), (5, 1)], "k int, n long"), combined(["k"], n=F.sum), epoch)
    assert sorted(counts.read().collect(), key=str) == sorted([(5, 2), (None, 4)], key=str)
    empty = spark.createDataFrame([], "k int, n long")
    counts.commit(empty, combined(["k"], n=F.sum), 2)
    assert counts.read().count() == 2


def test_vacuum_and_compaction(spark, tmpdir_path):
    table = BucketTable(spark, tmpdir_path + "/t", ["k"], 2)
    for i in range(6):
        table.commit(spark.createDataFrame([(k, i) for k in range(10)], "k int, i int"))  # appended folders
    assert table.read().count() == 60 and max(map(len, table.manifest()["buckets"].values())) == 6
    table.compact(folders=3)
    assert table.read().count() == 60 and max(map(len, table.manifest()["buckets"].values())) == 1
    table.vacuum(keep=1)
    assert table.read().count() == 60 and len(files(table.path)) == 2 and len(table.versions()) == 1


def test_write_upsert(spark, tmpdir_path):
    """An update replaces the stored row whatever its order value; repeats are harmless."""
    path = tmpdir_path + "/t"
    assert K.read_latest(spark, path, ["k"]) is None
    K.write_upsert(path, spark.createDataFrame([("a", "p1", 9), ("b", "p1", 1)], "k string, p string, o int"), ["k"], "o")
    moved = spark.createDataFrame([("a", "p2", 2), ("a", "p3", 3), ("c", "p1", 1)], "k string, p string, o int")
    for _ in range(2):
        K.write_upsert(path, moved, ["k"], "o")
        assert rows(K.read_latest(spark, path, ["k"]), "k", "p") == [("a", "p3"), ("b", "p1"), ("c", "p1")]


@pytest.mark.parametrize("words", [1, 1 << 12])
def test_seen_keys(spark, tmpdir_path, words):
    """Exact with filters that are full (one word) and nearly empty."""
    seen = SeenKeys(spark, tmpdir_path + "/s", ["a", "b"], buckets=8, words=words)
    batch = lambda ids: spark.createDataFrame([(i, None if i % 5 == 0 else f"k{i}") for i in ids], "a long, b string")
    assert seen.unseen(batch(range(400))).count() == 400
    seen.add(batch(range(400)), 0)
    again = batch([*range(350, 450), *range(350, 360)])
    got = rows(seen.unseen(again).select("a"), "a")
    assert got == [(i,) for i in range(400, 450)]
    new = batch(range(1000, 1020))
    if words == 1:
        assert len(seen.suspects(new)) == len(seen.keys.touched(new))  # all filters say maybe
    else:
        assert seen.suspects(new) == []  # no stored key is read
        assert set(seen.suspects(batch([7]))) == set(seen.keys.touched(batch([7])))
    assert seen.unseen(new).count() == 20
    seen.add(batch(range(400, 450)), 1)
    assert seen.unseen(again).count() == 0 and seen.unseen(again, 0).count() == 50


def test_first_seen_batches_repeat(spark, tmpdir_path):
    run = jobs.first_seen_batches(tmpdir_path + "/s", tmpdir_path + "/o", ["h"], ["i"], buckets=4, words=8)
    batches = [[("x", 1), ("x", 2), ("y", 3)], [("y", 4), ("z", 5)], [("x", 6), ("z", 7), ("w", 8)]]
    for epoch, part in enumerate(batches):
        for _ in range(2):
            run(spark.createDataFrame(part, "h string, i int"), epoch)
    assert rows(spark.read.parquet(tmpdir_path + "/o"), "h", "i") == [("w", 8), ("x", 1), ("y", 3), ("z", 5)]


def test_score_batches_read_counts_only(spark, tmpdir_path):
    """Earlier signals can go: later batches read the counts of their keywords."""
    import shutil
    d = spark.createDataFrame([(i, 1 + i % 2, "license" if i % 3 else "keit", "text", None, None, "USA", "news", "u") for i in range(60)],
                              "document_id long, source_id int, title string, full_text string, publish_date date, "
                              "scraped_at timestamp, country string, document_type string, url string")
    k = spark.createDataFrame([(1, "license", 2, "c", True), (2, "keit", 3, "c", True)],
                              "keyword_id int, keyword string, level int, cluster string, active boolean")
    s = spark.createDataFrame([(1, "s", "news", 3), (2, "t", "news", 3)],
                              "source_id int, source_name string, source_type string, trust_level int")
    run = jobs.score_batches(tmpdir_path + "/state", tmpdir_path + "/o", k, s, L.AS_OF, buckets=8)
    for epoch in range(3):
        run(d.filter(F.floor(F.col("document_id") / 20) == epoch), epoch)
        shutil.rmtree(f"{tmpdir_path}/state/signals/epoch={epoch}")
    got = {r.document_id: (r.kw_signals, r.kw_src_signals) for r in spark.read.parquet(tmpdir_path + "/o").collect()}
    want = {}
    for i in range(60):
        upto = [j for j in range(20 * (i // 20) + 20) if (j % 3 == 0) == (i % 3 == 0)]
        want[i] = (len(upto), sum(j % 2 == i % 2 for j in upto))
    assert got == want
    counts = BucketTable(spark, tmpdir_path + "/state/counts", ["keyword_id"], 8)
    assert counts.read().count() == 4  # keyword x source, whatever the number of signals
