"""Indexed search against a scan of every text with every pattern."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sigspark.operators import search as SE

TEXTS = ["Deep brain  stimulation in the EU", "deep brain\nstimulation", "deepbrain stimulations", "", None, "a", "ab abc abcd",
         "price (net) 12.50 EUR", "x" * 3000 + " tail", "naïve Straße 日本語 😀 end", "C:\\temp\\file", "the the the", "brain", "BRAIN deep",
         "one|two", "a+b=c", "tab\there", " lead and trail "]
PHRASES = ["deep brain", "brain", "in the", " the ", "the", "a", "", "ab abc", "日本語 😀", "tail", "xxxx", "not there", "p\\f", " lead", "trail ",
           "one|two", "a+b", "EU", "zz", "(net)", None]
REGEX = ["deep brain", r"deep\s+brain", r"deep\s*brain", r"brain|tail", r"brain|t", "stimulations?", "stim(ul)+ation", r"(deep|tail)", "colou?r|12",
         r"\d+\.\d+", r"12\.50", "b{2}rain", "br{0,1}ain", "^deep", "trail $", "[Dd]eep", "[^a-z]brain", "(?i)DEEP BRAIN", "(?s)deep.brain", "bra+in",
         "bra*in", "bra??in", r"a\+b", r"one\|two", "", ".", "x{5}", r"\x62rain", "(?:deep) brain", "((de)ep) (br(ai)n)", r"C:\\temp", r"the\sthe\s+the",
         r"\bEU\b", "(?i)eu", "de.p b", "Q(?=x)", "abcd?$", "ab abc+ ab", None]


def _docs(spark, texts=TEXTS):
    rows = [(i * 37 - 100, t) for i, t in enumerate(texts)]
    rows += [(8, "brain twice"), (8, "twice no"), (None, "deep brain of none"), (None, "none"), (2 ** 40, "far brain")]
    return spark.createDataFrame(rows, "k long, body string").repartition(3), rows


def _queries(spark, patterns):
    return spark.createDataFrame(list(enumerate(patterns)), "query int, pattern string")


def _rows(df):
    return sorted(((r.query, r.k) for r in df.collect()), key=repr)


def _scan(d, q, regex, case):
    hit = SE._matches(F.col("body"), F.col("pattern"), regex, case)
    return _rows(d.crossJoin(q).filter(hit).select("query", "k"))


@pytest.mark.parametrize("keep", [1, 4])
@pytest.mark.parametrize("case", [True, False])
@pytest.mark.parametrize("regex", [True, False])
def test_equals_the_scan(spark, regex, case, keep):
    d, rows = _docs(spark)
    q = _queries(spark, REGEX if regex else PHRASES)
    got = _rows(SE.search_all(d, q, "k", "body", regex=regex, case=case, keep=keep))
    assert got == _scan(d, q, regex, case) and len(got) > 40
    if case and not regex:
        assert got == sorted(((i, k) for i, p in enumerate(PHRASES) if p is not None for k, t in rows if t is not None and p in t), key=repr)


def test_pieces_of_patterns(spark):
    def of(p, regex=True):
        return sorted((r.branch, r.piece, r.left, r.right) for r in SE.pieces(_queries(spark, [p]), regex).collect() if r.piece)

    assert of(r"Deep\s+in brains?") == [(0, "brain", True, False), (0, "deep", False, True), (0, "in", True, True)]
    assert of("alpha|be ta (gamma) delta") == [(0, "alpha", False, False), (1, "delta", True, False), (1, "ta", True, True)]
    assert of("in the EU", regex=False) == [(0, "the", True, True)]
    assert of(r"a\Qb*\Ecde") == [] and of("(?x) deep brain") == [] and of(r"abc\u0041def") == []
    assert of("abcd*ef ghi{2}j") == [(0, "abc", False, False)]


def test_random_patterns(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcd", k=rng.randrange(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 25))) for _ in range(150)]
    parts = ["?", "*", "+", "|", r"\s+", r"\s*", "[ab]", "(c|d)", ".", " ", " ", "{1,2}"]
    patterns = []
    while len(patterns) < 60:
        p = "".join(rng.choice(vocabulary) + rng.choice(parts + ["", ""]) for _ in range(rng.randrange(1, 5)))
        try:
            re.compile(p)
        except re.error:
            continue
        patterns.append(p)
    d = spark.createDataFrame(list(enumerate(texts)), "k long, body string").repartition(4)
    q = _queries(spark, patterns)
    want = sorted(((i, k) for i, p in enumerate(patterns) for k, t in enumerate(texts) if re.search(p, t)), key=repr)
    assert _rows(SE.search_all(d, q, "k", "body")) == want and len(want) > 200


def test_only_candidates_are_verified(spark):
    """A phrase of rare words names few ids; a stored index serves further searches."""
    texts = [f"common words and item{i} with part{i % 50} tail" for i in range(2000)]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, body string")
    index = SE.build_index(d, "k", "body", partitions=4)
    q = _queries(spark, ["words and item77 with", "part7 tail", "item19\\d+", "absent phrase"])
    some, scan = SE.candidates(q, index)
    per = {r.query: r.n for r in some.groupBy("query").agg(F.sum(F.bit_count("bits")).alias("n")).collect()}
    assert per == {0: 1, 1: 40, 2: 111} and scan.count() == 0
    got = SE.search_all(d, q, "k", "body", index)
    assert {r.query: r["count"] for r in got.groupBy("query").count().collect()} == {0: 1, 1: 40, 2: 110}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_empty_sides(spark):
    d, _ = _docs(spark)
    q = _queries(spark, ["brain", ""])
    assert SE.search_all(d.filter("false"), q, "k", "body").count() == 0
    assert SE.search_all(d, q.filter("false"), "k", "body").count() == 0


def test_an_index_is_built_without_ranges(spark, monkeypatch):
    """Dealing by range works its rows out twice, once for the bounds."""
    d = spark.createDataFrame([(i, f"Word{i % 7} É{i} a") for i in range(200)] + [(200, None)], "id long, text string")
    monkeypatch.setattr(type(d), "repartitionByRange", None)
    index = SE.build_index(d, "id", "text")
    assert {r.word: r.n for r in index.words.collect() if r.word in ("a", "word3")} == {"a": 200, "word3": 29}
    assert index.words.count() == 1 + 7 + 200


def test_fold_changes_letters_of_ascii_only(spark):
    rows = spark.createDataFrame([("ABC xyz",), ("É İ K ÀZ 😀",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(SE.fold(F.col("t"))).collect()]
    assert got == ["abc xyz", "É İ K Àz 😀", "", None]


def test_branches_are_tried_alone_where_a_bar_is_a_branch(spark):
    rows = [(r"a\s+b[a-z]*|c", [r"a\s+b[a-z]*", "c"]), ("a", ["a"]), ("a|", ["a", ""]), ("(a|b)c", None), (r"a\|b", None),
            ("[a|b]c", None), ("(?i)a|b", None), (r"\Qa|b\E", None), (r"[a\]|b]", None), ("[a&&[b]]|c", None), (r"\\|b", None)]
    d = spark.createDataFrame([(p,) for p, _ in rows], "p string")
    got = {r.p: r.a for r in d.select("p", SE._alternatives(F.col("p")).alias("a")).collect()}
    for p, want in rows:
        assert got[p] == want or got[p] is None and p == r"\\|b", p
    texts = ["a  bx", "c", "a b|c", "bc", "a|b", "A", r"\ b", "zz", "", "a]", "ac b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = SE.search_all(docs, spark.createDataFrame([(i, p) for i, (p, _) in enumerate(rows)], "query long, pattern string"), "id", "text")
    plain = docs.crossJoin(d.withColumnRenamed("p", "pattern")).filter(F.regexp_like("text", F.col("pattern")))
    assert sorted((rows[r.query][0], r.id) for r in found.collect()) == sorted((r.pattern, r.id) for r in plain.collect())
