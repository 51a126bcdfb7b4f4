"""Operator 10, embedding near-dedup.

Equal vectors are one vector with a weight. Random hyperplanes give every
vector a sign hash per table; vectors that share a table's hash are compared
by exact cosine in double precision, in bounded blocks. A pair counts in the
first table that it shares, so ``n_links`` counts each link once. Components
come from the blocks' spanning forests.

The number of bits grows with log2 of the number of vectors (buckets hold
some ``2**SLACK`` unrelated vectors at any size), and the number of tables
follows from them and ``RECALL``, the chance that a pair at the threshold
itself shares a table; closer pairs are likelier.

Cases: vectors that are null, empty, zero or hold null or non-finite values
link with nothing and are their own component; vectors of different length
link with nothing; a null id has no component and no links; rows that repeat
an id with another vector count as one vector with the links of all; an empty
table gives an empty result; labels and further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import dealt, forest, matrix, sorted_units, units
from .common import stored, table
from .graph import components

RECALL, SLACK, LIMIT = 0.9999, 4, 1024


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(31, max(6, math.ceil(math.log2(max(n, 2))) - SLACK))
    agree = 1.0 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(1.0 - RECALL) / math.log(1.0 - agree ** bits)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = (F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
    return rows.withColumn("ok", F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def sign_hashes(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """id, n, dim, vec (doubles of length one), sig (a hash per table)."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        place = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            ids, n = b.column("id"), b.column("n")
            lists = b.column("v").to_pylist()
            sig, vec, dim = [], [], []
            for x in lists:
                x = np.array(x)
                x = x / np.abs(x).max()
                x = x / np.sqrt(x @ x)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((len(x), bits * tables))
                on = (x @ planes[len(x)] > 0).reshape(tables, bits)
                sig.append((on * place).sum(1).astype("<i4").tobytes())
                vec.append(x.astype("<f8").tobytes())
                dim.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [ids, n, pa.array(dim, pa.int32()), pa.array(vec, pa.binary()), pa.array(sig, pa.binary())],
                names=["id", "n", "dim", "vec", "sig"])

    return reps.mapInArrow(run, "id long, n long, dim int, vec binary, sig binary")


def compare(t: pa.Table, threshold: float):
    """(id, links) and (a, b) of one unit."""
    ids = t.column("id").to_numpy()
    n, blk = t.column("n").to_numpy(), t.column("blk").to_numpy()
    x, sig = matrix(t.column("vec"), "<f8"), matrix(t.column("sig"), "<i4")
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    linked &= ids[:, None] != ids[None, :]
    if t.column("i")[0].as_py() != t.column("j")[0].as_py():
        linked &= blk[:, None] != blk[None, :]
    at, other = np.nonzero(linked)
    if not len(at):
        return [], [], []
    tab = t.column("tab")[0].as_py()
    first = np.ones(len(at), bool)
    for lo in range(0, len(at), 1 << 18):
        a, o = at[lo:lo + (1 << 18)], other[lo:lo + (1 << 18)]
        first[lo:lo + (1 << 18)] = ~(sig[a, :tab] == sig[o, :tab]).any(1)
    counts = np.bincount(at[first], n[other[first]], len(ids)).astype(np.int64)
    who = np.flatnonzero(counts)
    return ids[who].tolist(), counts[who].tolist(), [(int(ids[a]), int(ids[b])) for a, b in forest(linked)]


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = 0.95, seed: int = 3) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    keyed = usable(vectors, id_col, vec_col).select(
        "id", "ok", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(17), F.col("v")).alias("k2"))
    rows = stored(keyed.select("id", "ok", "k1", "k2"), "embed-keys")
    groups = stored(rows.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n")),
                    "embed-groups")
    reps = (keyed.where("ok").join(groups.select(F.col("rep").alias("id"), "k1", "k2", "n"), ["id", "k1", "k2"])
            .dropDuplicates(["k1", "k2"]).select("id", "n", "v"))
    bits, tables = plan(groups.count(), threshold)
    hashed = stored(sign_hashes(reps, bits, tables, seed), "embed-hashes")
    tab = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("tab")
    # bytes of table t's hash, as a number: only equality matters
    key = F.conv(F.hex(F.substring("sig", F.col("tab") * 4 + 1, F.lit(4))), 16, 10).cast("long")
    keys = ["dim", "tab", "bucket"]
    at = hashed.select("id", "n", "dim", "vec", "sig", tab).withColumn("bucket", key)
    sizes = at.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    unit = [*keys, "i", "j"]

    def run(batches):
        for t in sorted_units(batches, unit):
            ids, counts, links = compare(t, threshold)
            if ids or links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids + [a for a, _ in links], pa.int64()),
                     pa.array([None] * len(ids) + [b for _, b in links], pa.int64()),
                     pa.array(counts + [0] * len(links), pa.int64())], names=["a", "b", "n"])

    found = stored(dealt(units(at, sizes, keys, "id", LIMIT), unit).mapInArrow(run, "a long, b long, n long"),
                   "embed-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    comps = components(found.where("b is not null"))
    reps_out = (groups.join(links, groups["rep"] == links["a"], "left").join(comps, groups["rep"] == comps["id"], "left")
                .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    out = (rows.alias("r").join(reps_out.alias("g"), F.expr("r.ok and r.k1 = g.k1 and r.k2 = g.k2"), "left")
           .select("r.id", F.coalesce("g.n_links", F.lit(0)).cast("long").alias("n_links"),
                   F.coalesce("g.component_id", "r.id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS node, vec_id AS root FROM embeddings
      UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
       min(c.root) AS component_id, min(c.root) = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id GROUP BY e.vec_id
"""
