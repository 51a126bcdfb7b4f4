"""Operators 1, 5, 8 and 9: held-out accuracy, round trips, brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.llm import elias_fano, langid, lm_scoring, piece_lattice, quality
from sigspark.llm.common import split_of
from tests.llm.conftest import TEXTS
from tests.llm.test_dedup import WORD

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_quality_held_out(shipped):
    got = quality.op1_quality(shipped, SF).join(read(shipped, "labels"), "doc_id").where("held_out").collect()
    low = [r["score"] for r in got if r["quality"] == 0]
    high = [r["score"] for r in got if r["quality"] == 1]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low])
    assert auc > 0.97, auc


def test_quality_cases(docs, no_docs, shipped):
    none = shipped.createDataFrame([], "doc_id long, quality int")
    some = shipped.createDataFrame([(k % 14, k % 2) for k in range(28)] + [(None, 1), (3, None), (999, 0)],
                                   "doc_id long, quality int")
    vectors, net = quality.train(docs, none)
    assert {r["score"] for r in quality.score(docs, vectors, net).collect()} == {0.5}
    vectors, net = quality.train(docs, some)
    got = quality.score(docs, vectors, net).collect()
    assert len(got) == len(TEXTS) and all(0.0 <= r["score"] <= 1.0 for r in got)
    assert quality.score(no_docs, vectors, net).count() == 0
    vectors, net = quality.train(no_docs, some)
    assert quality.score(docs, vectors, net).count() == len(TEXTS)


def test_context_sums_brute(shipped):
    """The streamed block sums are those of one pass over all texts."""
    texts = [(f"a b{k % 3} c A!! a a",) for k in range(50)] + [(None,), ("",)]
    got = quality.context_sums(shipped.createDataFrame(texts, "text string").repartition(5))
    want = np.zeros(quality.ROWS * quality.DIM, np.int64)
    for (t,) in texts:
        w, f, _, _ = quality.tokens(pa.array([t], pa.string()))
        for target in (w, f):
            for context in (w, f):
                quality._add_neighbours(want, target[1:], context[:-1])
                quality._add_neighbours(want, target[:-1], context[1:])
    assert (got == want.reshape(got.shape)).all()


def test_language_held_out(shipped):
    got = langid.op5_language_id(shipped, SF).join(read(shipped, "documents"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98


def test_language_cases(docs, no_docs):
    model = langid.train(docs.where("lang is not null"))
    got = {r["id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in (4, 5, 6, 8)] == ["und"] * 4 and got[4]["score"] == 0.0
    assert got[12]["lang_pred"] == "de" and got[1]["lang_pred"] == "en" and got[14]["lang_pred"] == "en"
    empty = langid.train(no_docs)
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0
    kept = {r["doc_id"] for r in langid.filter_accepted(docs, model).collect()}
    assert {1, 7, 9, 12, None} <= kept and not kept & {4, 5, 6, 8}


def test_language_filter_keeps_multilingual_and_short(shipped):
    """Texts of three to seven languages in equal parts, short texts and a share below 2% count."""
    rng = np.random.default_rng(3)
    words = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(40)] for k in range(7)}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    schema = "doc_id long, text string, lang string"
    model = langid.train(shipped.createDataFrame([(k, say(x, 400), x) for k, x in enumerate(words)], schema))
    rows = [(n, " ".join(say(x, 60) for x in list(words)[:n]), None) for n in (3, 4, 5, 6, 7)]
    rows += [(20 + k, w, None) for k, x in enumerate(words) for w in [words[x][0], say(x, 2)]]
    rows += [(50, "日", None), (51, "12 34", None), (52, None, None)]
    docs = shipped.createDataFrame(rows, schema)
    assert ({r["doc_id"] for r in langid.filter_accepted(docs, model).collect()}
            == {r[0] for r in rows} - {50, 51, 52})
    got = {r["id"]: r["n_langs"] for r in langid.identify(docs, model).collect()}
    assert [got[n] for n in (3, 4, 5, 6, 7)] == [3, 4, 5, 6, 7]
    (_, counts), = langid.per_text(pa.array([say("l0", 990) + " " + say("l1", 10)]))
    share = dict(zip(model.langs, model.mixture(counts)[0]))
    assert 0.0 < share["l1"] < 0.02 and sum(x > 0 for x in share.values()) == 2


def test_language_mixture(shipped):
    rows = [r for r in read(shipped, "documents").where("n_chars > 2000").collect()]
    model = langid.train(read(shipped, "documents"))
    en = next(r["text"] for r in rows if r["lang"] == "en")[:1500]
    de = next(r["text"] for r in rows if r["lang"] == "de")[:1500]
    (_, counts), = langid.per_text(pa.array([en + " " + de]))
    share, _, _ = model.mixture(counts)
    got = dict(zip(model.langs, share))
    assert 0.3 < got["en"] < 0.7 and 0.3 < got["de"] < 0.7 and got["es"] == got["fr"] == 0
    (_, counts), = langid.per_text(pa.array([en]))
    assert dict(zip(model.langs, model.mixture(counts)[0]))["en"] == 1.0


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every_segmentation(p, s):
    if not s:
        return [((), 1.0)]
    out = []
    for k in range(1, len(s) + 1):
        if s[:k] in p.ids:
            out += [((p.ids[s[:k]],) + rest, p.weight[s[:k]] * w) for rest, w in every_segmentation(p, s[k:])]
    if s[0] not in p.ids:
        raw = tuple(p.byte_id[b] for b in s[0].encode())
        out += [(raw + rest, w) for rest, w in every_segmentation(p, s[1:])]
    return out


@pytest.mark.parametrize("word", [" mats", " 😀on", "  the"])
def test_sampling_follows_the_lattice(word):
    """Frequencies of sampled segmentations against all weighted ways."""
    p = piece_lattice.Pieces(MODEL, 0.3)
    lat = piece_lattice.Lattices(p, 4_000_000)
    ways = every_segmentation(p, word)
    total = sum(w for _, w in ways)
    n = 20_000
    ids, counts = lat.sample(pa.array([word[1:]] * n), np.arange(n, dtype=np.uint64), 1)
    off = np.concatenate([[0], np.cumsum(counts)])
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(off[:-1], off[1:]))
    assert set(seen) <= {w for w, _ in ways}
    for way, weight in ways:
        share = weight / total
        assert abs(seen[way] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3


def test_pieces_round_trip(docs, no_docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    enc = piece_lattice.encode(docs, MODEL, seed=3)
    got = enc.collect()
    text = {i: t or "" for i, t, *_ in TEXTS}
    for r in got:
        assert sp.decode(list(r["ids"])) == text[r["id"]]
    back = {r["id"]: r["text"] for r in piece_lattice.decode(enc, MODEL).collect()}
    assert back == text
    again = piece_lattice.encode(docs.repartition(1), MODEL, seed=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # whatever the partitions
    other = piece_lattice.encode(docs, MODEL, seed=4).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))
    assert all(r["lossless"] for r in piece_lattice.encode(docs, MODEL, digest=True).collect())
    assert piece_lattice.encode(no_docs, MODEL).count() == 0
    wide = piece_lattice.with_pieces(docs, MODEL)
    assert wide.columns == docs.columns + ["pieces"] and wide.count() == len(TEXTS)


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(0)
    for universe, n in ((1 << 64, 0), (1 << 64, 1), (1 << 64, 5000), (1000, 3000), (1 << 26, 100), (2, 7)):
        x = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
        e = elias_fano.EliasFano(elias_fano.EliasFano.pack(x, universe))
        assert (e.all() == x).all() and (e[np.arange(n)] == x).all()
        q = np.concatenate([rng.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True), x])
        k, same = e.successor(q)
        assert (k == np.searchsorted(x, q)).all() and (same == np.isin(q, x)).all()
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 20_000, dtype=np.uint64),
                                     rng.integers(0, 1 << 63, 300, dtype=np.uint64) >> np.uint64(38) << np.uint64(38),
                                     (np.uint64(77) << np.uint64(38)) + np.arange(900, dtype=np.uint64)]))
    codes = rng.integers(1, 255, len(keys))
    words = np.unique(rng.integers(0, 1 << 62, 700, dtype=np.uint64))
    (tmp_path / "shard").write_bytes(elias_fano.Trie.build(words, np.arange(len(words)), keys, codes))
    trie = elias_fano.Trie(np.memmap(tmp_path / "shard", np.uint8, "r"))  # a memory-mapped file
    want = dict(zip(keys.tolist(), codes.tolist()))
    q = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)])
    assert trie.code(q).tolist() == [want.get(k, 0) for k in q.tolist()]
    assert trie.count(words).tolist() == list(range(len(words)))


def brute_lm(rows):
    """id -> (tokens, known, base, score) from plain counters; held-out rule of op9."""
    low = {c: c + 32 for c in range(65, 91)}
    texts = [(i, WORD.findall((t or "").translate(low)) + ["\0end"]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(t)
            two.update(zip(["\0start"] + t[:-1], t))
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in texts:
        base = score = 0.0
        for a, b in zip(["\0start"] + t[:-1], t):
            p = (one[b] + 1) / (n + v + 1)
            c = one["\0end"] if a == "\0start" else one[a]
            m = lm_scoring.A * max(c, 1) ** lm_scoring.B
            base += math.log10(p)
            score += math.log10((two[a, b] + m * p) / (c + m))
        out[i] = (len(t), sum(one[w] > 0 for w in t), base, score)
    return out, n


@pytest.mark.parametrize("limits", [(6 << 20, 12 << 20), (20_000, 15_000)])
def test_lm_brute(shipped, docs, no_docs, monkeypatch, limits):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", limits[0])
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", limits[1])
    held = F.coalesce(split_of("doc_id", 7) == 2, F.lit(False))
    small = read(shipped, "documents").where("doc_id < 60")
    for df in (docs, small):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want, n = brute_lm(rows)
        got = lm_scoring.train_and_score(df, ~held).collect()
        assert len(got) == len(rows)
        for r in got:
            tokens, known, base, score = want[r["id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, tokens)
            assert abs(r["score"] - score) < 0.03 * tokens  # one byte a probability
    assert lm_scoring.train_and_score(no_docs, ~held).count() == 0


def test_lm_sums_to_one():
    """Given a context, the probabilities of all known words and one unknown add to one."""
    one, n = Counter({"a": 5, "b": 3, "c": 2}), 10
    two = {"a": 2, "b": 1, "c": 1}
    m = lm_scoring.A * 4 ** lm_scoring.B
    total = sum((two[w] + m * (one[w] + 1) / (n + 3 + 1)) / (4 + m) for w in one) + m * (1 / (n + 4)) / (4 + m)
    assert abs(total - 1) < 1e-12
    levels = lm_scoring.quantiser(10 ** 6)
    assert (lm_scoring.codes_of(np.arange(128), levels) == np.arange(128)).all()
    big = np.array([200.0, 5000.0, 10.0 ** 6])
    assert (np.abs(np.log(levels[lm_scoring.codes_of(big, levels)] / big)) < 0.05).all()
