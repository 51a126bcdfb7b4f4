"""Operator 11 against a brute-force alignment."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sigspark.llm import alignment as A
from tests.llm.conftest import TEXTS

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokens(text, libraries):
    """[(id, bytes)] of both tokenizers, or None where the bytes do not agree."""
    tok, sp = libraries
    if not text:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        name = sp.id_to_piece(i)
        b.append((i, bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else None


def spans(pairs):
    at, out = 0, []
    for i, raw in pairs:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, libraries):
    found, counts = [], Counter()
    for i, text in rows:
        got = tokens(text, libraries)
        if got is None:
            found.append((i, [], [], [], 0))
            continue
        a, b = map(spans, got)
        linked, k = [], 0
        for y in b:
            while k < len(a) and a[k][2] <= y[1]:
                k += 1
            j = k
            while j < len(a) and a[j][1] < y[2]:
                linked.append((a[j][0], y[0]))
                j += 1
        counts.update(linked)
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        text_of, lo = [], 0
        for e in ends:
            part = [",".join(str(x[0]) for x in side if lo < x[2] <= e) for side in (a, b)] if len(a) < 3000 else None
            text_of.append("|".join(part) if part else None)
            lo = e
        found.append((i, a, b, linked, text_of))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for i, a, b, linked, groups in found:
        sha = "" if not a else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(a), len(b), len(groups) if a else 0, len(linked), sum(counts[x] == highest[x[1]] for x in linked),
                    sum(counts[x] for x in linked), sha))
    return out, counts


NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def made():
    rng = random.Random(3)
    bits = ["the", "Straße", "naïve", "日本語", "😀", "un▁der", "a\tb", "\n", "  ", "   x", "<|endoftext|>", "<s>", "<0x41>",
            "\x1c", " ", "don't", "12345", "supercalifragilistic", "\r\n", " q", "É", "é", "ﬁ", "\x00", "."]
    return [(k % 50 if k % 4 else None, "".join(rng.choice(["", " "]) + rng.choice(bits) for _ in range(rng.randrange(1, 12))))
            for k in range(300)]


def check(got, rows, libraries):
    want, counts = brute(rows, libraries)
    have = sorted(([r[c] for c in NAMES] for r in got.collect()), key=str)
    blank = {tuple(w[:-1]) for w in want if w[-1] is None}  # digests too long for the brute force
    have = [tuple(h[:-1]) + (None if tuple(h[:-1]) in blank else h[-1],) for h in have]
    assert sorted(map(str, have)) == sorted(map(str, want))
    return counts


def test_against_brute_force(docs, shipped, libraries):
    from pyspark.sql import functions as F
    rows = [(i, t) for i, t, *_ in TEXTS] + made() + [(900, "a text with a third of all rows")] * 150
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.select("*", *[F.lit(c).alias(c) for c in ("id", "key", "times", "block", "kind", "pair", "total", "n", "a", "b")])
    got, totals = A.align(df, BPE, PIECES)
    counts = check(got, rows, libraries)
    assert {(r["pair"] & 0xFFFF, r["pair"] >> 16): r["total"] for r in totals.collect()} == dict(counts)
    small, _ = A.align(df, BPE, PIECES, block_bytes=500)  # many blocks in a task
    check(small, rows, libraries)


def test_documents(shipped, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in shipped.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(A.op11_alignment(shipped, sf).withColumnRenamed("doc_id", "id"), rows, libraries)


def test_empty_table(no_docs):
    got, totals = A.align(no_docs, BPE, PIECES)
    assert got.count() == 0 and totals.count() == 0 and got.columns == NAMES


def test_pair_counts_merge(monkeypatch):
    monkeypatch.setattr(A, "PAIR_ROWS", 4)
    rng = np.random.default_rng(0)
    counts, want = A.PairCounts(), Counter()
    for _ in range(30):
        p, n = rng.integers(0, 40, 9), rng.integers(1, 5, 9)
        counts.add(p, n)
        for x, y in zip(p.tolist(), n.tolist()):
            want[x] += y
    pairs, n = counts.total()
    assert dict(zip(pairs.tolist(), n.tolist())) == dict(want)
