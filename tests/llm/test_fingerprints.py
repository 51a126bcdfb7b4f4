"""Operator 12: digests against brute force, algebra of the fingerprints, likeness."""

import base64
import hashlib
import random

import numpy as np
import pytest

from sigspark.llm import fingerprints as P
from tests.llm.conftest import TEXTS


def edited(text, after):
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def rows(df):
    return sorted((str((r["id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
                        r["near_edited"], r["near_next"])) for r in df.collect()))


def test_against_brute_force(shipped):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"] or "") for r in shipped.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in P.op12_fingerprints(shipped, sf).collect()}
    assert len(got) == len(docs)
    better = 0
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        other = edited(text, after)
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        own, new, nxt = P.vectors([text, other, after])
        assert base64.b64decode(r["fingerprint"]) == own.tobytes()
        assert base64.b64decode(r["edited_fingerprint"]) == new.tobytes()
        assert r["near_edited"] == P.likeness(own[None], new[None])[0]
        assert r["near_next"] == P.likeness(own[None], nxt[None])[0]
        better += r["near_edited"] > r["near_next"]
    assert better > 0.95 * len(docs)


@pytest.mark.parametrize("parts", ["1", "4", "37"])
def test_cases(docs, shipped, parts):
    """Null and repeated ids, empty and long texts, ties, whatever the blocks."""
    before = shipped.conf.get("spark.sql.shuffle.partitions")
    shipped.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [r.asDict() for r in P.compare_with_next(docs).collect()]
        again = rows(P.compare_with_next(docs.repartition(5)))
    finally:
        shipped.conf.set("spark.sql.shuffle.partitions", before)
    assert rows(P.compare_with_next(docs)) == again
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, (i, t, *_) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        want.append((i, len(text), hashlib.sha256(edited(text, after).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["id"], r["n_chars"], r["edited_sha256"])) for r in got)
    by = {r["id"]: r for r in got}
    zero = base64.b64encode(bytes(P.WIDTH)).decode()
    assert by[4]["fingerprint"] == by[5]["fingerprint"] == zero and by[4]["near_next"] == 1.0
    assert by[5]["near_next"] == 0.0  # an empty text and white space


def test_equal_rows_and_single_rows(shipped):
    one = shipped.createDataFrame([(3, "all alone here")], "doc_id long, text string")
    r = P.compare_with_next(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(edited("all alone here", "all alone here").encode()).hexdigest()
    same = shipped.createDataFrame([(None, "equal row")] * 500 + [(k, f"row {k}") for k in range(20)], "doc_id long, text string")
    got = P.compare_with_next(same.repartition(6)).collect()
    twin = hashlib.sha256(edited("equal row", "equal row").encode()).hexdigest()
    last = hashlib.sha256(edited("equal row", "row 0").encode()).hexdigest()
    seen = [r["edited_sha256"] for r in got if r["id"] is None]
    assert seen.count(twin) == 499 and seen.count(last) == 1 and len(got) == 520


def test_empty_table(no_docs):
    got = P.compare_with_next(no_docs)
    assert got.count() == 0 and "near_next" in got.columns
    assert P.fingerprints(no_docs).count() == 0


def test_order_does_not_matter_and_content_does():
    rng = random.Random(2)
    lines = ["".join(rng.choices("abcdef ghij", k=80)) for _ in range(40)]
    a, b = "\n".join(lines), "\n".join(sorted(lines))
    x, y, z, w = P.vectors([a, b, a + "\n", "\n".join(lines[:-1] + ["changed"])])
    assert (x == y).all() and (x != z).any() and (x != w).any()


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{k * 7919 % 1000}" for k in range(4000))
    whole = P.vectors([text, "\n".join([text] * 3), "x" * 50000])
    monkeypatch.setattr(P, "PIECE", 1000)
    cut = P.vectors([text, "\n".join([text] * 3), "x" * 50000])
    assert (whole[:, :32] == cut[:, :32]).all()
    assert (P.likeness(whole[:2], cut[:2]) > 0.85).all()


def test_likeness_estimates_the_shared_part():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=2000)
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        kept = int(2000 * share)
        other = base[:kept] + rng.choices(words, k=2000 - kept)
        a, b = P.vectors([" ".join(base), " ".join(other)])
        assert abs(P.likeness(a[None], b[None])[0] - share) < 0.2


def test_update_is_the_sum(shipped):
    texts = {1: "first line\nsecond line\nthird line", 2: "alone", 3: "", None: "no id\nno id"}
    docs = shipped.createDataFrame(list(texts.items()), "doc_id long, text string")
    edits = [(1, "second line", -1), (1, "new line", 2), (2, "alone", -1), (3, "from nothing", 1), (9, "unknown", 1),
             (None, "no id", -1), (1, None, 1), (3, "", 1)] + [(2, "often", 1)] * 700
    got = P.update(P.fingerprints(docs), shipped.createDataFrame(edits, "id long, paragraph string, n int").repartition(4))
    found = {r["id"]: bytes(r["fingerprint"]) for r in got.collect()}
    want = {1: "third line\nnew line\nfirst line\nnew line", 2: "\n".join(["often"] * 700), 3: "from nothing\n",
            9: "unknown", None: "no id"}
    assert found == dict(zip(want, (v.tobytes() for v in P.vectors(list(want.values())))))
    assert np.array_equal(P.vectors([""])[0], np.zeros(P.WIDTH, np.uint8))
