"""Operator 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sigspark.llm import resampling as R
from sigspark.llm import wordhash
from tests.llm.conftest import TEXTS

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in grams(t))
    t = Counter(bucket(f) for x in target for f in grams(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        fs = grams(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
                 for b in map(bucket, fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None])
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, out))


def rows(df):
    return sorted(str([r["id"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in df.collect())


def made(n):
    """Texts of 0 to 60 words; ids repeat or are missing, equal rows and clashing words included."""
    rng = random.Random(5)
    out = [(i, t) for i, t, *_ in TEXTS]
    for k in range(n):
        text = rng.choice(" ,\n").join(rng.choice(["a", "B", "née", "7x", "word" * 9, "日本", f"w{k % 17}"]) for _ in range(rng.randrange(60)))
        out.append((None if k % 3 == 0 else 100 + k // 2, text))
    return out + [(7777, "equal rows have ranks beside each other " * 9)] * (n // 3)


def test_against_brute_force(shipped):
    from pyspark.sql import functions as F
    data = made(240)
    target = [t for _, t, *_ in TEXTS[:3]] + [None, "", "word" * 9 + " née 7x"]
    docs = shipped.createDataFrame(data, "doc_id long, text string").repartition(5)
    docs = docs.select("*", *[F.lit(c).alias(c) for c in ("id", "n", "score", "tie", "row", "range", "weight", "enough")])
    to = shipped.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = R.resample(docs, to)
    # rows of one id that tie are told apart by their text's hash: compare all but the ranks, then the ranks as a set
    strip = lambda x: sorted(r.rsplit(",", 1)[0] for r in x)
    want, have = brute(data, target), rows(got)
    assert strip(have) == strip(want)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(not r.endswith("None]") for r in want)
    by_rank = [r["score"] for r in sorted(got.where("rank is not null").collect(), key=lambda r: r["rank"])]
    assert by_rank == sorted(by_rank, reverse=True)
    assert rows(R.resample(docs.repartition(3), to)) == have


def test_unique_ids_exactly(shipped):
    sf = "/root/testdata/sf0.001"
    docs, to = shipped.read.parquet(f"{sf}/documents.parquet"), shipped.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in to.collect()])
    assert rows(R.op13_resampling(shipped, sf).withColumnRenamed("doc_id", "id")) == want


def test_empty_tables(docs, no_docs, shipped):
    none = shipped.createDataFrame([], "item_id long, text string")
    assert R.resample(no_docs, none).count() == 0
    assert R.resample(docs, none).count() == len(TEXTS)


def test_hashes_of_spans():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in [*range(0, 70), 255, 256, 257, 1000]]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    n = np.array([len(p) for p in parts])
    spans = R.Spans(buf, np.cumsum(n) - n, n)
    assert spans.xxh64().tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    order, crc = spans.crc32(np.arange(len(parts)))
    assert dict(zip(order.tolist(), crc.tolist())) == {k: zlib.crc32(p) for k, p in enumerate(parts)}


def test_table_tells_equal_keys_apart_by_bytes(monkeypatch):
    parts = [b"one", b"two", b"one", b"a longer n-gram than eight bytes", b"a longer n-gram than eight bytez", b"x" * 300, b"x" * 299 + b"y"]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    n = np.array([len(p) for p in parts])
    monkeypatch.setattr(R.Spans, "xxh64", lambda self: np.full(len(self.start), 3, np.uint64))
    t = R.NgramTable(R.Spans(buf, np.cumsum(n) - n, n))
    assert t.slot[0] == t.slot[2] and len(set(t.slot.tolist())) == 6
    assert [int(t.bucket[s]) for s in t.slot] == [zlib.crc32(p) % 10000 for p in parts]
    assert [int(t.count[s]) for s in t.slot] == [2, 1, 2, 1, 1, 1, 1]


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 20])
def test_segments_of_long_texts(monkeypatch, segment):
    monkeypatch.setattr(wordhash, "SEGMENT", segment)
    texts = ["one two  three", None, "", " lead and trail ", "Née " * 40, "solid" * 30, "a", "b a", "--", "x y"]
    got = [Counter() for _ in texts]
    for spans, text in R.occurrences(pa.array(texts)):
        for s, n, t in zip(spans.start, spans.length, text):
            got[t][spans.raw[s:s + n].tobytes().decode()] += 1
    assert got == [Counter(grams(t)) for t in texts]
