"""Anchored matching of large lexicons against the form that searches every term."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sigspark.operators import anchors as AN
from sigspark.operators import tagging as TG

KEYWORDS = "keyword_id int, keyword string, level int, cluster string, active boolean"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t[:30], t) for i, t in enumerate(texts)] + [(900, None, None), (901, "", "")],
                                 "document_id long, title string, full_text string").repartition(3)


def hits(df):
    return sorted((r.document_id, r.keyword_id, r.match_score, r.match_kind) for r in df.collect())


@pytest.mark.parametrize("part_terms", [200_000, 7])
def test_terms_of_every_length(spark, part_terms):
    texts = ["Deep brain  stimulation in the EU", "deep brain\nstimulation", "aß 😀 x", "supercalifragilistic " * 50 + "end",
             "a" * 400, "ab" * 120 + " tail term", "naïve Straße 日本語"]
    words = ["", "a", "ab", "eu", "the", "brain", "deep brain", "brain stim", "brain  stim", "califrag", "😀", "日本語", "ß",
             "straße", "tail term", "d t", " ", "zzz", "not there at all", "aaaaaaa", "end", "x", None, "EU", "the"]
    rows = [(i, w, 1, "c", None if i % 3 else True) for i, w in enumerate(words)] + [(99, "inactive brain", 1, "c", False), (98, "brain", 1, "c", False)]
    k = spark.createDataFrame(rows, KEYWORDS)
    d = _docs(spark, texts)
    want = hits(TG.tag_exact(d, k.filter("keyword is not null")).join(d.select("document_id"), "document_id")
                .withColumn("match_kind", F.lit("exact")))
    assert hits(AN.tag_indexed(d, k, part_terms=part_terms)) == want and len(want) > 30


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(8)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(2, 9)))
    vocabulary = [word() for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(12)]
    terms = {" ".join(rng.choices(vocabulary, k=rng.randrange(1, 4))) for _ in range(150_000)}
    terms |= {" ".join(t.split()[k:k + 3]) for t in texts for k in range(50)}
    k = spark.createDataFrame([(i, w, 1, "c", True) for i, w in enumerate(sorted(terms))], KEYWORDS).repartition(4)
    d = _docs(spark, texts)
    got = hits(AN.tag_indexed(d, k))
    assert k.count() > 100_000 and len(got) >= 600
    assert got == hits(TG.tag_exact(d, k))


def test_no_term_meets_every_text(spark):
    """Candidates come from an equi-join: no nested loop, no cross join, no shuffle of texts."""
    k = spark.createDataFrame([(i, f"term number {i}", 1, "c", True) for i in range(300)], KEYWORDS)
    found = AN.tag_indexed(_docs(spark, ["has term number 7 and term number 77"]), k)
    assert {r.keyword_id for r in found.collect()} == {7, 77}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan


def test_empty_sides(spark):
    none = spark.createDataFrame([], KEYWORDS)
    one = spark.createDataFrame([(1, "x", 1, "c", True)], KEYWORDS)
    assert AN.tag_indexed(_docs(spark, ["x"]), none).count() == 0
    assert AN.tag_indexed(_docs(spark, ["x"]).filter("false"), one).count() == 0


def test_words_and_pairs_are_verified_on_pieces(spark):
    """Terms of letters cost the length of a run and not that of the text; rows that repeat an id are rows."""
    texts = ["the " * 48 + "anchorage of naïve Straße", "x-ray of  the anchor\tof the", "ofthe of.the of the" * 3, "the of", ""] * 30
    words = ["the", "of", "anchor", "anchor of", "of the", "f t", "ray of", "naïve straße", "ve stra", "e o", "e", "age of naïve", "the the"]
    k = spark.createDataFrame([(i, w, 1, "c", True) for i, w in enumerate(words)], KEYWORDS)
    rows = [(i // 2 if i % 3 else None, t[:30], t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "document_id long, title string, full_text string").repartition(3).localCheckpoint()

    def told(df):
        return sorted((str(r.document_id), r.keyword_id, r.match_score) for r in df.collect())
    assert told(AN.tag_indexed(d, k)) == told(TG.tag_exact(d, k))
    plan = AN.tag_indexed(d, k.filter("keyword not like '% % %'"))._jdf.queryExecution().executedPlan().toString()
    assert "Contains(piece" in plan and "Contains(text" not in plan
