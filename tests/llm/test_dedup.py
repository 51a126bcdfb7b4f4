"""Operators 2, 3 and 10 against brute force."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from sigspark.llm import blocks, embed_dedup, exact_dedup, graph, ngram_join, wordhash
from tests.llm.conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *cols):
    return sorted(tuple(r) for r in df.select("id", *cols).collect() if r["id"] is not None)


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact_dedup(docs, no_docs, hash_all):
    got = exact_dedup.exact_dedup(docs, prefix_chars=4, hash_all=hash_all)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]", "", t or ""), len(t or "")) for i, t, *_ in TEXTS]
    want = []
    for i, t, _ in norm:
        same = [(-n, j) for j, u, n in norm if u == t and j is not None]
        want.append((i, min(same, default=(0, i))[1], sum(u == t for _, u, _ in norm)))
    rows = [(r["id"], r["keep_id"], r["group_size"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(no_docs, hash_all=hash_all).count() == 0


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact_dedup_of_repeated_ids(shipped, hash_all):
    """A third of the rows without an id, ids with texts of different classes: one result a row."""
    rows = [(None, "same")] * 30 + [(1, "same"), (1, "other text"), (2, "other text"), (2, "alone"), (3, "same"), (3, "same")]
    rows += [(k, f"row {k % 40}") for k in range(10, 70)]
    got = exact_dedup.exact_dedup(shipped.createDataFrame(rows, "doc_id long, text string").repartition(4),
                                  prefix_chars=2, hash_all=hash_all).collect()
    count = {t: sum(u == t for _, u in rows) for _, t in rows}
    first = {t: min(i for i, u in rows if u == t and i is not None) for _, t in rows}
    want = [(i, first[t] if count[t] > 1 else i, count[t]) for i, t in rows]
    assert sorted(map(str, [(r["id"], r["keep_id"], r["group_size"]) for r in got])) == sorted(map(str, want))


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows, threshold=0.8):
    """id -> (class, links), every pair compared."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    links, group = dict.fromkeys(sets, 0), {i: i for i in sets}
    flat = [(i, s) for i, x in sets.items() for s in x]
    for (a, s), (b, u) in itertools.combinations(flat, 2):
        if s and u and len(s & u) >= threshold * len(s | u) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = group[a], group[b]
            group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    return {i: (group[i], links[i]) for i in sets}


def test_ngram_join_cases(docs, no_docs):
    rows = [(i, t) for i, t, *_ in TEXTS if i is not None and i != 14]
    want = brute_classes(rows)
    got = {r[0]: r[1:] for r in by_id(ngram_join.jaccard_join(docs), "class_id", "n_links")}
    assert {i: got[i] for i in want} == want
    assert got[14] == (14, 1)  # a row that repeats is a copy of itself
    assert want[1] == (1, 2) and want[4] == (4, 0) and want[6] == (6, 0)
    assert ngram_join.jaccard_join(no_docs).count() == 0


def test_ngram_join_blocks(shipped, monkeypatch):
    """A large group of near copies, compared in many small blocks."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.integers(0, 120, 1 + i % 5):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(rng.choice(base, 60))) for i in range(30)]
    monkeypatch.setattr(ngram_join, "HASH_LIMIT", 16)
    monkeypatch.setattr(ngram_join, "TEXT_LIMIT", 16)
    got = ngram_join.jaccard_join(shipped.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: r[1:] for r in by_id(got, "class_id", "n_links")} == brute_classes(rows)


def test_bounds_are_the_posterior():
    """The drop bounds are those of a numerically integrated posterior."""
    x = (np.arange(200_000) + 0.5) / 200_000
    for n, least in ngram_join.least_matches(16, 48, 0.8, 1e-4):
        def above(m):
            d = x ** m * (1 - x) ** (n - m)
            return d[x >= 0.8].sum() / d.sum()
        assert above(least) >= 1e-4 and (least == 0 or above(least - 1) < 1e-4)


def test_components(shipped):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 6000 + k) for k in range(200)]
    group = {}
    for a, b in edges:
        x, y = group.setdefault(a, a), group.setdefault(b, b)
        if x != y:
            group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    got = dict(tuple(r) for r in graph.components(shipped.createDataFrame(edges, "a long, b long")).collect())
    touched = {k for a, b in edges if a != b for k in (a, b)}
    assert got == {k: group[k] for k in touched}


def test_units_are_whole_and_bounded():
    t = pa.table({"k": [1, 1, 2, 3, 3, 3], "x": [1, 2, 3, 4, 5, 6]})
    for size in (1, 2, 6):
        got = [u.column("x").to_pylist() for u in blocks.sorted_units(t.to_batches(size), ["k"])]
        assert got == [[1, 2], [4, 5, 6]]


def test_embedding_dedup(shipped, monkeypatch):
    rng = np.random.default_rng(7)
    vecs = [list(map(float, v)) for v in rng.standard_normal((40, 8))]
    near = [[float(x + 0.05 * y) for x, y in zip(vecs[0], rng.standard_normal(8))] for _ in range(25)]
    rows = list(enumerate(vecs + near + [vecs[3], vecs[3], [2 * x for x in vecs[4]]]))
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] + [0.0] * 6), (204, [math.nan] * 8),
             (205, [math.inf] + [1.0] * 7), (206, vecs[0][:4]), (None, vecs[0]), (3, vecs[3])]
    df = shipped.createDataFrame([(i, v, 1, "x", "y") for i, v in rows],
                                 "vec_id long, embedding array<double>, label int, id string, n string")
    good = [(i, np.array(v)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, group = {i: 0 for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}
    for (a, x), (b, y) in itertools.combinations(good, 2):
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
            links[a] += 1
            links[b] += 1
            p, q = group[a], group[b]
            group = {k: min(p, q) if v in (p, q) else v for k, v in group.items()}
    links[3] //= 2  # id 3 is there twice
    for limit in (1024, 8):
        monkeypatch.setattr(embed_dedup, "LIMIT", limit)
        got = embed_dedup.embedding_dedup(df).collect()
        assert {r["id"]: (r["n_links"], r["component_id"]) for r in got if r["id"] is not None} == {
            i: (links[i], group[i]) for i in links}
        assert [tuple(r) for r in got if r["id"] is None] == [(None, 0, None, True)]
    assert embed_dedup.embedding_dedup(df.where("false")).count() == 0


def test_words_of_any_cut(monkeypatch):
    """Hashes do not depend on where long texts are cut."""
    texts = ["a bb  ccc\n" * 50, "", None, "z" * 500, " lead and trail ", "A bb"]
    whole = wordhash.words(pa.array(texts))
    monkeypatch.setattr(wordhash, "SEGMENT", 37)
    for a, b in zip(whole, wordhash.words(pa.array(texts))):
        assert (a == b).all()
    counts = [len(WORD.findall(t or "")) for t in texts]
    assert whole[2].tolist() == counts and len(set(whole[0].tolist())) == 7
