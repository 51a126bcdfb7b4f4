"""Operator 5, language identification by multilingual mixture inference.

Training counts byte trigrams (letters lower-cased, everything else a blank)
per language over all training texts. A document is a mixture: each trigram
comes from one of its languages, and expectation-maximisation estimates the
proportions. Starting from all languages, those are taken out one by one
whose loss of log-likelihood is below a penalty of ``PENALTY * log(n)``; what
is left is the document's language set, however small a share is. Languages
whose loss is below one penalty all together, even before the proportions are
fitted anew, go at once; of single languages the likeliest one is left.

``filter_accepted`` adds a component without a language, for which all trigrams
are alike, to the mixture. Languages are taken out one by one, and a text is
accepted as soon as the languages left are likelier than that component alone
by their penalties; if none is, it is rejected. What is foreign to all
languages (codes, names, other scripts) is the component's share, so a text
stays if any part of it speaks for a language by more than a penalty, whether
it is short or has many languages.

The model has languages x 2**16 counts, whatever the corpus; it is gathered
by a Spark aggregation and broadcast. Each text is scored whole by itself.

Cases: null texts and texts without a letter are ``und`` with score 0; so is
every text if nothing was learned; rows with a null id train and are scored
(held_out false); repeated rows are scored alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_id, release, split_of, table
from .wordhash import slices, string_buffers

BUCKETS, SMOOTH, PENALTY, ROUNDS = 1 << 16, 0.05, 3.0, 12
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BLANK = 32 * 0x10101


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Bucket of every trigram that starts at a byte; BUCKETS for blank ones."""
    t = _FOLD[buf]
    if len(t) < 3:
        return np.zeros(0, np.int64)
    key = (t[:-2] << np.uint32(16)) | (t[1:-1] << np.uint32(8)) | t[2:]
    out = ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    out[key == _BLANK] = BUCKETS
    return out


def per_text(col: pa.Array):
    """(index, counts per bucket) of each text; a blank on both its ends."""
    buf, off = string_buffers(col)
    for k in range(len(col)):
        seg = np.empty(off[k + 1] - off[k] + 2, np.uint8)
        seg[0] = seg[-1] = 32
        seg[1:-1] = buf[off[k]:off[k + 1]]
        yield k, np.bincount(trigrams(seg), minlength=BUCKETS + 1)[:BUCKETS]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of (lang, text)."""
    def count(batches):
        release()
        seen: dict[str, np.ndarray] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                langs = b.column("lang").to_pylist()
                for k, c in per_text(b.column("text")):
                    if langs[k] not in seen:
                        seen[langs[k]] = np.zeros(BUCKETS, np.int64)
                    seen[langs[k]] += c
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])],
                                             names=["lang", "bucket", "n"])

    got = docs.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    return got.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Trigram probabilities per language: bounded by languages x BUCKETS."""

    def __init__(self, counts: pa.Table):
        self.langs = sorted(set(counts.column("lang").to_pylist()))
        where = {lang: k for k, lang in enumerate(self.langs)}
        n = np.zeros((BUCKETS, len(self.langs)))
        rows = counts.column("bucket").to_numpy()
        cols = np.array([where[x] for x in counts.column("lang").to_pylist()], np.int64)
        if len(rows):
            n[rows, cols] = counts.column("n").to_numpy()
        self.p = (n + SMOOTH) / (n.sum(0) + SMOOTH * BUCKETS)
        #: For ``accepts``: half by counts, half alike for all learned trigrams,
        #: so that a text repeated without end does not make others foreign.
        self.either = 0.5 * self.p + 0.5 * (n > 0) / np.maximum((n > 0).sum(0), 1)

    def mixture(self, counts: np.ndarray):
        """(proportions of all languages, confidence in the first, mean
        log-likelihood of a trigram) of one text's trigram counts."""
        at = np.flatnonzero(counts)
        c = counts[at].astype(float)
        n, k = c.sum(), len(self.langs)
        if not n:
            return np.full(k, 1.0 / k), 0.0, -np.inf
        p = self.p[at]
        single = c @ np.log(p)
        use = np.arange(k)
        pi, like = self._em(p, c, n, np.full(k, 1.0 / k))
        penalty = PENALTY * np.log(n + 1.0)
        order = np.argsort(pi)
        rest = np.cumsum((p * pi)[:, order[::-1]], 1)[:, ::-1]  # column s: without the s smallest ones
        with np.errstate(divide="ignore"):
            likes = c @ np.log(rest) - n * np.log(np.cumsum(pi[order[::-1]])[::-1])
        gone = int(np.flatnonzero(like - likes <= penalty).max(initial=0))
        if gone:
            use = np.sort(order[gone:])
            pi, like = self._em(p[:, use], c, n, pi[use] / pi[use].sum())
        while len(use) > 1:
            out = int(np.argmin(pi))
            rest = np.delete(np.arange(len(use)), out)
            if len(rest) == 1:
                pi2, like2 = np.ones(1), single[use[rest[0]]]
            else:
                pi2, like2 = self._em(p[:, use[rest]], c, n, pi[rest] / pi[rest].sum())
            if like - like2 > penalty:
                break
            use, pi, like = use[rest], pi2, like2
        if len(use) == 1:
            use = np.array([int(np.argmax(single))])
            like = single[use[0]]
        full = np.zeros(k)
        full[use] = pi
        best = int(np.argmax(full))
        others = np.delete(single, best)
        lead = (single[best] - others.max()) / 3.0 if k > 1 else 30.0  # trigrams overlap threefold
        if len(use) > 1:
            lead = max(lead, 0.0)
        sure = 1.0 / (1.0 + np.exp(-np.clip(lead, -30, 30)))
        return full, sure, like / n

    def accepts(self, counts: np.ndarray) -> bool:
        """Whether some language set beside the component without a language
        has a better penalised likelihood than that component alone."""
        at = np.flatnonzero(counts)
        if not len(at) or not self.langs:
            return False
        c = counts[at].astype(float)
        n = c.sum()
        p = np.column_stack([np.full(len(at), 1.0 / BUCKETS), self.either[at]])
        nothing, penalty = -n * np.log(BUCKETS), PENALTY * np.log(n + 1.0)
        use = np.arange(p.shape[1])  # 0: no language
        pi, like = self._em(p, c, n, np.full(len(use), 1.0 / len(use)))
        while len(use) > 1:
            if like - nothing > penalty * (len(use) - 1):
                return True
            rest = np.delete(np.arange(len(use)), 1 + int(np.argmin(pi[1:])))
            use = use[rest]
            pi, like = self._em(p[:, use], c, n, (pi[rest] + 1e-9) / (pi[rest] + 1e-9).sum())
        return False

    @staticmethod
    def _em(p: np.ndarray, c: np.ndarray, n: float, pi: np.ndarray):
        for _ in range(ROUNDS):
            r = p * pi
            new = (c / r.sum(1)) @ r / n
            done = np.abs(new - pi).max() < 1e-4
            pi = new
            if done:
                break
        return pi, float(c @ np.log(p @ pi))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return Model(count_trigrams(rows.where("lang is not null and text is not null")).toArrow())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             *keep) -> DataFrame:
    """id, (kept columns,) lang_pred, score, n_langs, fit for every row.

    ``score``: the language's proportion times the confidence that it, rather
    than any other, is the one. ``fit``: mean log-likelihood of a trigram
    above that of blind guessing (null without trigrams).
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # languages x 2**16 doubles at most
    rows = as_id(docs, id_col, F.col(text_col).alias("text"), *keep)
    names = [x for x in rows.columns if x != "text"]

    def run(batches):
        release()
        m = shared.value
        blind = np.log(BUCKETS)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                pred, score, n_langs, fit = [], [], [], []
                for k, c in per_text(b.column("text")):
                    if not m.langs or texts[k] is None or not _LETTER.search(texts[k]):
                        pred.append("und"), score.append(0.0), n_langs.append(0), fit.append(None)
                        continue
                    pi, sure, like = m.mixture(c)
                    best = int(np.argmax(pi))
                    pred.append(m.langs[best])
                    score.append(float(min(1.0, max(0.0, pi[best] * sure))))
                    n_langs.append(int((pi > 0).sum()))
                    fit.append(float(like + blind) if np.isfinite(like) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(x) for x in names]
                    + [pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                       pa.array(n_langs, pa.int32()), pa.array(fit, pa.float64())],
                    names=names + ["lang_pred", "score", "n_langs", "fit"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, n_langs int, fit double")


def filter_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mixture accepts, with all their columns:
    a letter, and a language that the penalised likelihood keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**16 doubles at most

    def run(batches):
        release()
        m = shared.value
        for whole in batches:
            for b in slices(whole, text_col):
                texts = b.column(text_col).to_pylist()
                keep = []
                for k, c in per_text(b.column(text_col)):
                    fine = texts[k] is not None and bool(_LETTER.search(texts[k])) and m.accepts(c)
                    keep.append(fine)
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(split_of("doc_id", 5) == 0, F.lit(False))
    model = train(docs.where(~held))
    found = identify(docs, model, "doc_id", "text", held.alias("held_out"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "n_langs")
