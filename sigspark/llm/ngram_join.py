"""Operator 2, n-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its runs of five words (ASCII letters lower-cased).
Two documents link if the Jaccard similarity of their sets is 0.8 or more.

1. One pass over the texts makes a narrow row each: a 128-bit fingerprint of
   the set, MinHash values and LSH band keys. Documents with equal sets are
   one class with a weight; only its smallest id goes on.
2. Classes that share a band key are compared in bounded blocks: MinHash
   values are compared ``STEP`` at a time, and a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold (a
   uniform prior over the similarity, a binomial likelihood of the matches)
   falls below ``TOLERANCE``. Survivors go on as spanning forests.
3. Candidate components bring the texts of their members together (the only
   time texts move, and only for members), again in bounded blocks, and
   similarities are computed exactly from whole sets.
4. Components of the verified links are the result's classes.

A pair at the threshold itself misses all bands with probability
(1 - 0.8**ROWS)**BANDS, below 3e-5.

Cases: texts of one to four words have one run, of all their words; texts
without words (null, empty, white space) link with nothing; a null id has no
links; rows that repeat an id count as copies if their texts are equal, else
as one document with the links of all; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import dealt, forest, matrix, sorted_units, units
from .common import as_id, release, stored, table
from .graph import components
from .wordhash import U, mix, runs, slices, words

WIDTH, THRESHOLD = 5, 0.8
ROWS, BANDS, STEP, TOLERANCE = 4, 20, 16, 1e-6
VALUES = ROWS * BANDS
#: Rows of a block of MinHash rows and of a block of texts.
HASH_LIMIT, TEXT_LIMIT = 1024, 256

_MUL = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | U(1)
_ADD = mix(np.arange(1001, VALUES + 1001, dtype=np.uint64))


def shingle_sets(col: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted set of run hashes of each text."""
    h, index, counts = words(col, lower=True)
    sh, at = runs(index, counts, h, width)
    n = np.bincount(at, minlength=len(counts))
    ends = np.cumsum(n)
    return [np.unique(sh[e - k:e]) for e, k in zip(ends.tolist(), n.tolist())]


def signatures(docs: DataFrame) -> DataFrame:
    """id, n_set, f0, f1 (fingerprint), sig (VALUES MinHashes), bands."""
    def run(batches):
        release()
        for whole in batches:
            for b in slices(whole, "text"):
                sets = shingle_sets(b.column("text"))
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                has = np.flatnonzero(n)
                f = np.zeros((2, len(sets)), np.uint64)
                sig = np.zeros((len(sets), VALUES), np.uint32)
                if len(has):
                    every = np.concatenate(sets)
                    starts = (np.cumsum(n) - n)[has]
                    for k in range(2):
                        f[k, has] = np.add.reduceat(mix(every ^ _ADD[k]), starts)
                    for k in range(VALUES):
                        sig[has, k] = np.minimum.reduceat((every * _MUL[k] + _ADD[k]) >> U(32), starts)
                wide = sig.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(_ADD[:BANDS], (len(sets), BANDS)).copy()
                for k in range(ROWS):
                    key = mix(key ^ wide[:, :, k]) * _MUL[k]
                off = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)),
                     pa.array([r.tobytes() for r in sig], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(key.ravel().view(np.int64)))],
                    names=["id", "n_set", "f0", "f1", "sig", "bands"])

    return docs.mapInArrow(run, "id long, n_set long, f0 long, f1 long, sig binary, bands array<long>")


def least_matches(step: int, values: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped).

    With a uniform prior and m of n values equal the similarity's posterior is
    Beta(m + 1, n - m + 1); it reaches t with the probability that a binomial
    variable of n + 1 draws at t is at most m.
    """
    out = []
    for n in range(step, values + 1, step):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, bounds) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows that no comparison drops."""
    same, done = np.zeros(len(a), np.int32), 0
    for n, least in bounds:
        if not len(a):
            break
        same += (sig[a, done:n] == sig[b, done:n]).sum(1, dtype=np.int32)
        done = n
        on = same >= least
        a, b, same = a[on], b[on], same[on]
    return a, b


def candidate_links(t: pa.Table, bounds) -> list[tuple[int, int]]:
    """A spanning forest of one unit's surviving pairs."""
    ids, blk = t.column("id").to_numpy(), t.column("blk").to_numpy()
    sig = matrix(t.column("sig"), "<u4")
    n = len(ids)
    cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    group = np.arange(n)
    out = []

    def join(a, b):
        for x, y in zip(a.tolist(), b.tolist()):
            if group[x] != group[y]:
                out.append((int(ids[x]), int(ids[y])))
                group[group == group[y]] = group[x]

    for pivot in range(min(n, 8)):  # most of a group of near copies joins one of the first rows
        other = np.flatnonzero((group != group[pivot]) & ((blk != blk[pivot]) | (not cross)))
        join(*survivors(sig, np.full(len(other), pivot), other, bounds))
    for x in range(n - 1):  # pairs that are not yet connected
        other = np.arange(x + 1, n)
        other = other[(group[x + 1:] != group[x]) & ((blk[x + 1:] != blk[x]) | (not cross))]
        if len(other):
            join(*survivors(sig, np.full(len(other), x), other, bounds))
    return out


def verified(t: pa.Table, threshold: float, width: int):
    """(id, linked weight) and forest links of one unit, exactly."""
    ids, size, blk = (t.column(c).to_numpy() for c in ("id", "size", "blk"))
    sets = shingle_sets(t.column("text").combine_chunks(), width)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), n)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    dense = np.cumsum(times > 1) - 1
    width_bits = int((times > 1).sum())
    bits = np.zeros((len(sets), max(1, -(-width_bits // 64)) * 8), np.uint8)
    col = dense[code[shared]]
    np.bitwise_or.at(bits, (owner[shared], col >> 3), (1 << (col & 7)).astype(np.uint8))
    bits = bits.view(np.uint64)
    cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    linked = np.zeros((len(sets), len(sets)), bool)
    for x in range(len(sets) - 1):
        y = np.arange(x + 1, len(sets))
        low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        y = y[(low >= threshold * high) & (ids[y] != ids[x]) & ((blk[y] != blk[x]) | (not cross))]
        for lo in range(0, len(y), 64):
            z = y[lo:lo + 64]
            both = np.bitwise_count(bits[z] & bits[x]).sum(1, dtype=np.int64)
            linked[x, z] = both >= threshold * (n[x] + n[z] - both) - 1e-9
    linked |= linked.T
    counts = (linked * size[None, :]).sum(1)
    who = np.flatnonzero(counts)
    return ids[who].tolist(), counts[who].tolist(), [(int(ids[a]), int(ids[b])) for a, b in forest(linked)]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), n_links."""
    texts = as_id(docs, id_col, F.col(text_col).alias("text"))
    bounds = least_matches(STEP, VALUES, threshold, TOLERANCE)
    rows = stored(signatures(texts), "join-sig")
    keys = ["f0", "f1", "n_set"]
    classes = stored(rows.where("n_set > 0 and id is not null").groupBy(*keys)
                     .agg(F.min("id").alias("rep"), F.count("*").alias("size")), "join-classes")
    reps = stored(rows.join(classes, keys).where("id = rep").dropDuplicates(keys)
                  .select("id", "size", "sig", "bands"), "join-reps")

    at = reps.select("id", F.explode("bands").alias("band"))
    sizes = at.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    near = units(at, sizes, ["band"], "id", HASH_LIMIT).join(reps.select("id", "sig"), "id")

    def prune(batches):
        release()
        for t in sorted_units(batches, ["band", "i", "j"]):
            links = candidate_links(t, bounds)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()),
                                                  pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    maybe = components(dealt(near, ["band", "i", "j"]).mapInArrow(prune, "a long, b long"))
    maybe = stored(maybe, "join-candidates")
    parts = maybe.groupBy("component").agg(F.count("*").alias("n"))
    members = units(maybe, parts, ["component"], "id", TEXT_LIMIT).join(reps.select("id", "size"), "id")
    whole = texts.join(members, "id").select("component", "i", "j", "id", "size", "blk", "text")
    unit = ["component", "i", "j"]

    def verify(batches):
        release()
        for t in sorted_units(batches, unit):
            ids, counts, links = verified(t, threshold, WIDTH)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids + [x[0] for x in links], pa.int64()),
                     pa.array([None] * len(ids) + [x[1] for x in links], pa.int64()),
                     pa.array(counts + [0] * len(links), pa.int64())], names=["a", "b", "n"])

    found = stored(dealt(whole, unit).mapInArrow(verify, "a long, b long, n long"), "join-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    comps = components(found.where("b is not null"))
    result = (classes.join(links, classes["rep"] == links["a"], "left")
              .join(comps, classes["rep"] == comps["id"], "left")
              .select(*keys, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("class_id")))
    return (rows.select("id", *keys).alias("r")
            .join(result.alias("c"), F.expr("r.f0 = c.f0 and r.f1 = c.f1 and r.n_set = c.n_set and r.id is not null"), "left")
            .select("r.id", F.coalesce("c.class_id", "r.id").alias("class_id"),
                    F.coalesce("c.n_links", F.lit(0)).cast("long").alias("n_links")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links",
                        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE hits >= 0.8 * (x.n + y.n - hits) - 1e-9),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents
      UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node),
r AS (SELECT node AS doc_id, min(root) AS class_id FROM c GROUP BY node)
SELECT r.doc_id, r.class_id, count(l.b) AS n_links, r.class_id = r.doc_id AS kept
FROM r LEFT JOIN l ON l.a = r.doc_id GROUP BY ALL
"""
