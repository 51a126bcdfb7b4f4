"""Operator 1, quality classifier.

Random indexing: each token has a fixed sparse ternary index vector; a
token's word vector is the sum of the index vectors of its neighbours over
the whole corpus, scaled to length one. A word counts as two tokens: its
hash bucket and its form (which kinds of characters it has, whether it
repeats the word before), so words never seen still have a form vector.
A document pools its word vectors (means and spread); a two-layer network in
numpy turns them into a score, and a temperature fitted on rows kept back
from training calibrates it.

The vectors cover every text: each task sums its texts into a table of fixed
size, and the tables are added in two shuffles that stream block by block.
The network learns from at most ``SAMPLE`` labelled rows (the first by a hash
of the id, a documented bound); scoring reads every whole text once.

Cases: null and empty texts pool to zero and are scored like that; without
labels of both kinds the score is their share (1/2 without labels); a null
label or id does not train; a document with several labels trains with each;
repeated rows are scored alike; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_id, split_of, table
from .wordhash import U, mix, slices, words

WORDS, FORMS, DIM, NONZERO = 1 << 14, 1 << 12, 48, 4
ROWS, BLOCK = WORDS + FORMS, 64
SAMPLE, HIDDEN, EPOCHS = 20_000, 32, 40
FEATURES = 3 * DIM + 3

_SLOT = np.random.default_rng(11).integers(0, DIM, (ROWS, NONZERO))
_SIGN = np.random.default_rng(12).choice([-1.0, 1.0], (ROWS, NONZERO))
_KIND = np.full(256, 1 << 3, np.uint32)  # other punctuation
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 1 << 1
_KIND[48:58] = 1 << 2
for _i, _c in enumerate(".,!?|#$%&*-'\"()<>=/_:;@+"):
    _KIND[ord(_c)] = 1 << (4 + _i)
_FIRST_UPPER = np.uint32(1 << 28)
_SAME = np.uint32(1 << 29)


def tokens(col: pa.Array):
    """(word bucket, form row, text index, words per text)."""
    h, index, counts, s, _, buf = words(col, lower=True, keep_bytes=True)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), index, counts
    kind = _KIND[buf]
    head = kind[s]
    kind[s] = np.where(head == 2, _FIRST_UPPER, head)
    mask = np.bitwise_or.reduceat(kind, s)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (index[1:] == index[:-1])
    mask = mask | np.where(same, _SAME, np.uint32(0))
    form = (mix(mask.astype(np.uint64) + U(77)) & U(FORMS - 1)).astype(np.int64) + WORDS
    return (h & U(WORDS - 1)).astype(np.int64), form, index, counts


def _add_neighbours(total: np.ndarray, target: np.ndarray, context: np.ndarray) -> None:
    base = target * DIM
    for k in range(NONZERO):
        total += np.bincount(base + _SLOT[context, k], _SIGN[context, k], ROWS * DIM).astype(np.int64)


def context_sums(docs: DataFrame) -> np.ndarray:
    """ROWS x DIM sums over all rows of (text); exact, so order is no matter."""
    def partial(batches):
        total, part = np.zeros(ROWS * DIM, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                w, f, index, _ = tokens(b.column("text"))
                near = index[1:] == index[:-1]
                for target in (w, f):
                    for context in (w, f):
                        _add_neighbours(total, target[1:][near], context[:-1][near])
                        _add_neighbours(total, target[:-1][near], context[1:][near])
        yield from blocks({k: x for k, x in enumerate(total.reshape(-1, BLOCK * DIM)) if x.any()}, part)

    def blocks(sums, salt):
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([salt] * len(sums), pa.int32()),
                 pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())],
                names=["block", "salt", "sums"])

    def add(batches):  # streams: a task holds the sums of its own blocks only
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("sums")):
                x = np.frombuffer(x.as_buffer(), "<i8")
                sums[k] = sums[k] + x if k in sums else x.copy()
        yield from blocks(sums, TaskContext.get().partitionId())

    schema = "block int, salt int, sums binary"
    parts = docs.select("text").mapInArrow(partial, schema)
    level1 = parts.repartition("block", F.expr("salt % 16")).mapInArrow(add, schema)
    level2 = level1.repartition("block").mapInArrow(add, schema)
    out = np.zeros((ROWS // BLOCK, BLOCK * DIM), np.int64)
    for row in level2.select("block", "sums").toLocalIterator():  # ROWS x DIM numbers in all
        out[row["block"]] += np.frombuffer(row["sums"], "<i8")
    return out.reshape(ROWS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt((sums.astype(float) ** 2).sum(1, keepdims=True))
    return (sums / np.maximum(norm, 1.0)).astype(np.float32)


def pooled(vectors: np.ndarray, col: pa.Array) -> np.ndarray:
    """Texts x FEATURES."""
    w, f, _, counts = tokens(col)
    out = np.zeros((len(counts), FEATURES), np.float32)
    has = np.flatnonzero(counts)
    if len(has):
        starts = (np.cumsum(counts) - counts)[has]
        n = counts[has][:, None].astype(np.float32)
        vf = vectors[f]
        out[has, :DIM] = np.add.reduceat(vectors[w], starts, axis=0) / n
        out[has, DIM:2 * DIM] = mean = np.add.reduceat(vf, starts, axis=0) / n
        np.multiply(vf, vf, out=vf)
        out[has, 2 * DIM:3 * DIM] = np.sqrt(np.maximum(np.add.reduceat(vf, starts, axis=0) / n - mean * mean, 0))
        out[has, 3 * DIM] = np.sqrt((out[has, :DIM] ** 2).sum(1))
        out[has, 3 * DIM + 1] = np.sqrt((mean ** 2).sum(1))
        out[has, 3 * DIM + 2] = np.log1p(n[:, 0])
    return out


class Network:
    """FEATURES -> HIDDEN (tanh) -> 1 (logistic), trained by Adam."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        self.share = float(y.mean()) if len(y) else 0.5
        self.temperature = 1.0
        self.constant = not (len(y) >= 10 and 0 < y.sum() < len(y))
        if self.constant:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        cal, fit = order[:max(2, len(y) // 5)], order[max(2, len(y) // 5):]
        if not 0 < y[fit].sum() < len(fit):
            cal, fit = order, order
        self.mean, self.std = x[fit].mean(0), x[fit].std(0) + 1e-4
        z, t = self._scaled(x[fit]), y[fit].astype(np.float32)
        self.w = [(rng.standard_normal((FEATURES, HIDDEN)) / np.sqrt(FEATURES)).astype(np.float32),
                  np.zeros(HIDDEN, np.float32),
                  (rng.standard_normal((HIDDEN, 1)) / np.sqrt(HIDDEN)).astype(np.float32), np.zeros(1, np.float32)]
        self._train(z, t, rng)
        logits, target = self.logits(x[cal]), y[cal]
        tries = np.exp(np.linspace(np.log(0.25), np.log(8.0), 80))
        self.temperature = float(min(tries, key=lambda k: np.logaddexp(0, np.where(target == 1, -logits, logits) / k).sum()))

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.std, -8, 8).astype(np.float32)

    def _train(self, z, t, rng):
        m = [np.zeros_like(p) for p in self.w]
        v = [np.zeros_like(p) for p in self.w]
        step, size = 0, min(256, len(t))
        for epoch in range(EPOCHS):
            rate = 0.003 * (1.0 - epoch / EPOCHS) + 1e-4
            order = rng.permutation(len(t))
            for lo in range(0, len(t) - size + 1, size):
                k = order[lo:lo + size]
                a = np.tanh(z[k] @ self.w[0] + self.w[1])
                g = (1 / (1 + np.exp(-np.clip(a @ self.w[2] + self.w[3], -30, 30))) - t[k][:, None]) / size
                back = (g @ self.w[2].T) * (1 - a * a)
                grads = [z[k].T @ back, back.sum(0), a.T @ g, g.sum(0)]
                step += 1
                for i, grad in enumerate(grads):
                    grad = grad + 1e-4 * self.w[i] if i in (0, 2) else grad
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)

    def logits(self, x):
        a = np.tanh(self._scaled(x) @ self.w[0] + self.w[1])
        return (a @ self.w[2] + self.w[3])[:, 0].astype(float)

    def score(self, x):
        if self.constant:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE):
    """(word vectors, network). ``labels`` holds the rows to learn from."""
    spark = docs.sparkSession
    vectors = word_vectors(context_sums(docs.select(F.col(text_col).alias("text"))))
    shared = spark.sparkContext.broadcast(vectors)  # ROWS x DIM floats
    chosen = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
              .where("id is not null and label in (0, 1)").distinct()
              .orderBy(F.xxhash64("id"), "id", "label").limit(sample))
    texts = as_id(docs, id_col, F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")  # at most ``sample`` ids

    def pool(batches):
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                x = pooled(shared.value, b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["id", "label", "x"])

    got = rows.mapInArrow(pool, "id long, label int, x binary").toArrow()
    got = got.sort_by([("id", "ascending"), ("label", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    return vectors, Network(x, got.column("label").to_numpy())


def score(docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str = "doc_id",
          text_col: str = "text", *keep) -> DataFrame:
    """id, (kept columns,) score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))  # of fixed size
    rows = as_id(docs, id_col, F.col(text_col).alias("text"), *keep)
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        v, n = shared.value
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in names] + [pa.array(n.score(pooled(v, b.column("text"))), pa.float64())],
                    names=names + ["score"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(split_of("doc_id", 3) != 1)
    vectors, net = train(docs, labels)
    found = score(docs, vectors, net, "doc_id", "text",
                  F.coalesce(split_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
