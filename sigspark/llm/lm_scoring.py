"""Operator 9, language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram trie over all training texts: no count is cut or
sampled, so it grows with the corpus. It is never whole in one place: keys
are dealt to as many shards as the corpus needs, and each shard is a
compact trie (``elias_fano``).

Documents are dealt to batches by a hash. Each batch sends every shard the
sorted different keys that it has there, with their training counts, so a
word or pair with a third of all tokens costs one key per batch. A shard adds
the counts of all batches, builds its trie and answers each batch's keys by
search. A second deal brings batches and answers together, and each whole
text is scored.

p(w | v) = (N J + m p(w)) / (c(v) + m), where J is the trie's quantised
probability of the pair (exact for counts up to 127), p(w) = (c(w) + 1) /
(N + V + 1) the base model, c(v) the context's count, and m = A c(v)**B, as
contexts seen often also have more successors. For exact J it sums to one.

Keys are 64-bit hashes; a bigram's key is bits of its context's hash followed
by a hash of both words.

Cases: null and empty texts have the end token only; rows with a null id
train (held_out false); repeated rows count each time; without training rows
every probability is 1; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ceil_div, split_of, stored, table
from .elias_fano import _REST, EliasFano, Trie
from .wordhash import U, mix, words

#: Bytes of text for each batch and for each shard.
BATCH_BYTES, SHARD_BYTES = 6 << 20, 12 << 20
A, B = 8.0, 0.8  # the best of a grid for held-out texts
END, START = U(0x1F0E5F0E5), U(0x2A1B2A1B2)
_MUL = U(0x9E3779B97F4A7C15)


def quantiser(total: int) -> np.ndarray:
    """256 counts: 0 to 127 exactly, then evenly spaced logarithms."""
    top = max(int(total), 256)
    return np.concatenate([np.arange(128.0), np.exp(np.linspace(np.log(128.0), np.log(top), 128))])


def codes_of(counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    middle = np.concatenate([levels[:127] + 0.5, np.sqrt(levels[127:-1] * levels[128:])])
    return np.searchsorted(middle, counts, "right").astype(np.uint8)


def token_stream(text: pa.Array):
    """(token hash, bigram key, text index, tokens per text)."""
    h, _, counts = words(text, lower=True)
    ends = np.cumsum(counts)
    tok = np.insert(h, ends, END) if len(counts) else h
    n = counts + 1
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[np.cumsum(n) - n] = START
    slot = mix(prev + _MUL) >> _REST << _REST
    key = slot | (mix(mix(prev) * _MUL ^ tok) >> (U(64) - _REST))
    return tok, prev, key, np.repeat(np.arange(len(n)), n), n


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (mix(key ^ _MUL) % U(shards)).astype(np.int64)


def _dealt(key: np.ndarray, shards: int):
    """Indices of the keys of each shard, in key order."""
    s = shard_of(key, shards)
    order = np.argsort(s, kind="stable")
    cuts = np.searchsorted(s[order], np.arange(shards + 1))
    return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _text(t) -> pa.Array:
    col = t.column("text")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col


def ask(t: pa.Table, shards: int) -> pa.Table:
    """A batch's messages: its different words and pairs for each shard."""
    tok, _, key, index, _ = token_stream(_text(t))
    train = t.column("train").to_numpy()[index].astype(float)
    parts = []
    for k in (tok, key):
        names, inverse = np.unique(k, return_inverse=True)
        counts = np.bincount(inverse, train, len(names)).astype("<u4")
        parts.append((names, counts, _dealt(names, shards)))
    rows = []
    for s in range(shards):
        cols = []
        for names, counts, at in parts:
            cols += [EliasFano.pack(names[at[s]], 1 << 64), counts[at[s]].tobytes()]
        if len(parts[0][2][s]) or len(parts[1][2][s]):
            rows.append((s, t.column("batch")[0].as_py(), *cols))
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    names = ["shard", "batch", "words", "word_n", "pairs", "pair_n"]
    return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)


def _gathered(t: pa.Table, keys: str, counts: str):
    """(sorted different keys of all messages, their counts, the place of each
    message's keys among them)."""
    parts = [EliasFano(x.as_buffer()).all() for x in t.column(keys)]
    k = np.concatenate(parts)
    c = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in t.column(counts)])
    order = np.argsort(k, kind="stable")
    k = k[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    total = np.add.reduceat(c[order].astype(np.int64), first) if len(k) else c.astype(np.int64)
    where = np.empty(len(k), np.int64)
    where[order] = np.cumsum(new) - 1
    return k[first], total, np.split(where, np.cumsum([len(x) for x in parts])[:-1])


def answer(t: pa.Table, levels: np.ndarray) -> pa.Table:
    """Builds one shard's trie from all messages to it and searches it for
    each different key: word counts and pair codes in each message's order."""
    w, wn, w_at = _gathered(t, "words", "word_n")
    p, pn, p_at = _gathered(t, "pairs", "pair_n")
    trie = Trie(Trie.build(w[wn > 0], wn[wn > 0], p[pn > 0], codes_of(pn[pn > 0], levels)))
    found_w, found_p = trie.count(w), trie.code(p)
    rest = [0] * (t.num_rows - 1)
    return pa.table([t.column("batch").cast(pa.int32()), t.column("shard").cast(pa.int32()),
                     pa.array([found_w[x].astype("<u8").tobytes() for x in w_at], pa.binary()),
                     pa.array([found_p[x].tobytes() for x in p_at], pa.binary()),
                     pa.array([trie.words.n] + rest, pa.int64()), pa.array([int(wn.sum())] + rest, pa.int64())],
                    names=["batch", "shard", "word_n", "codes", "known", "total"])


def scores(t: pa.Table, answers: pa.Table, shards: int, total: int, known: int, levels: np.ndarray) -> pa.Table:
    """id, train, n_tokens, n_known, base_score, score of a batch's texts."""
    tok, prev, key, index, n = token_stream(_text(t))
    got = {s: k for k, s in enumerate(answers.column("shard").to_pylist())}
    values = []
    for k, col, kind in ((tok, "word_n", "<u8"), (key, "codes", np.uint8)):
        names, inverse = np.unique(k, return_inverse=True)
        out = np.zeros(len(names))
        for s, at in enumerate(_dealt(names, shards)):
            if len(at):
                out[at] = np.frombuffer(answers.column(col)[got[s]].as_buffer(), kind)
        values.append(out[inverse])
    c, pair = values[0], levels[values[1].astype(np.int64)]
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[prev == START] = c[tok == END][0] if len(c) else 0.0  # as many texts as ends
    base = (c + 1.0) / (total + known + 1.0)
    m = A * np.maximum(before, 1.0) ** B
    p = (pair + m * base) / (before + m)
    docs = len(n)
    return pa.table([
        t.column("id"), t.column("train"), pa.array(n),
        pa.array(np.bincount(index, c > 0, docs).astype(np.int64)),
        pa.array(np.bincount(index, np.log10(base), docs)), pa.array(np.bincount(index, np.log10(p), docs))],
        names=["id", "train", "n_tokens", "n_known", "base_score", "score"])


def train_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, train, n_tokens, n_known, train_tokens,
    base_score, score. ``train``: which rows the model learns from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = int(size or 0)
    batches, shards = ceil_div(size, BATCH_BYTES), ceil_div(size, SHARD_BYTES)
    levels = quantiser(size // 2 + n)  # no count is larger
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int"))
    asked = rows.groupBy("batch").applyInArrow(
        lambda t: ask(t, shards), "shard int, batch int, words binary, word_n binary, pairs binary, pair_n binary")
    answers = stored(asked.groupBy("shard").applyInArrow(
        lambda t: answer(t, levels), "batch int, shard int, word_n binary, codes binary, known long, total long"),
        "lm-answers")
    known, total = (int(x or 0) for x in answers.agg(F.sum("known"), F.sum("total")).first())
    out = (rows.groupBy("batch").cogroup(answers.drop("known", "total").groupBy("batch"))
           .applyInArrow(lambda t, a: scores(t, a, shards, total, known, levels),
                         "id long, train boolean, n_tokens long, n_known long, base_score double, score double"))
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(split_of("doc_id", 7) == 2, F.lit(False))
    found = train_and_score(table(spark, sf_dir, "documents"), ~held)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")
