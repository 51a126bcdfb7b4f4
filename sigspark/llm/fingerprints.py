"""Operator 12, document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (the parts between line feeds; the
empty text has none). A paragraph hashes to a wide vector and a text's
fingerprint is the sum of its paragraphs' vectors, ``EXACT`` lanes modulo
2**64 and ``NEAR`` lanes modulo 2**16:

* exact lanes are the paragraph's 256-bit digest. Texts of equal paragraphs in
  any order have equal sums; unequal multisets meet by chance only (about
  2**-256 a pair; no defence against texts made to collide).
* near lanes add a random sign for every passage of the paragraph, a run of
  words that ends where a word's hash says so (``PASSAGE`` words on average),
  so an edit changes the passages around it and no others. The dot product of
  two texts' lanes estimates how many passages they share; ``likeness`` is
  twice that over both squared lengths, within 1 / sqrt(NEAR) or so.

Sums need no order: ``update`` adds inserted paragraphs to stored fingerprints
and subtracts deleted ones without their texts.

The op12 query compares each text with its edited form and its successor. Rows
are dealt into blocks of consecutive keys; the first row of a block goes to
the block before, too, so that every row meets its successor in one streaming
pass. Texts are shuffled once; keys, 24 bytes each, find the block borders, of
which there is one for ``BLOCK_BYTES`` of text. Rows of one id, even equal ones,
spread over blocks as their place in the input is part of the key.

Cases: null texts count as empty, and the empty text's fingerprint is zero; two
texts with equal fingerprints have likeness 1, an empty one and another 0; null
ids come first; rows that repeat an id follow by a hash of the text, and of
equal rows each is the next one's predecessor; the successor of the last row is
the first, of an only row itself; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_id, ceil_div, release, row_keyed, stored, table
from .wordhash import U, _powers, mix, slices, words

EXACT, NEAR, PASSAGE = 4, 256, 4
WIDTH = 8 * EXACT + 2 * NEAR
BLOCK_BYTES = 32 << 20
#: Longer texts are cut into pieces for the near lanes, at a space if possible.
PIECE = 1 << 20
_LOWEST = -(1 << 63)  # the sort key of a null id
_SIGNS = U(0x9E3779B97F4A7C15) * np.arange(1, NEAR // 64 + 1, dtype=np.uint64)


def _pieces(text: str):
    lo = 0
    while len(text) - lo > PIECE:
        hi = text.rfind(" ", lo + 1, lo + PIECE)
        hi = hi if hi > 0 else lo + PIECE
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _sums(values: np.ndarray, owner: np.ndarray, n: int, dtype) -> np.ndarray:
    """Row sums of ``values`` by ascending ``owner``."""
    out = np.zeros((n, values.shape[1]), dtype)
    if len(owner):
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[heads]] = np.add.reduceat(values, heads, axis=0, dtype=dtype)
    return out


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every passage of the texts."""
    h, index, _, s, _, buf = words(col, lower=False, keep_bytes=True)
    m = len(h)
    if not m:
        return h, index
    line = np.searchsorted(np.flatnonzero(buf == 10), s)
    end = (h % U(PASSAGE)) == 0
    end[:-1] |= (index[1:] != index[:-1]) | (line[1:] != line[:-1])
    end[-1] = True
    last = np.flatnonzero(end)
    first = np.concatenate([[0], last[:-1] + 1])
    p, q = _powers(m)
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:m])])
    return mix((cum[last + 1] - cum[first]) * q[first] + (last - first).astype(np.uint64)), index[first]


def vectors(texts: list[str]) -> np.ndarray:
    """Fingerprints (rows of ``WIDTH`` bytes) of texts."""
    n = len(texts)
    parts = [t.split("\n") if t else [] for t in texts]
    digests = b"".join(hashlib.blake2b(x.encode(), digest_size=8 * EXACT).digest() for t in parts for x in t)
    owner = np.repeat(np.arange(n), [len(t) for t in parts])
    exact = _sums(np.frombuffer(digests, "<u8").reshape(-1, EXACT), owner, n, np.uint64)
    near = np.zeros((n, NEAR), np.int64)
    pieces = [(k, x) for k, t in enumerate(texts) for x in _pieces(t)]
    at = 0
    while at < len(pieces):
        size, lo = 0, at
        while at < len(pieces) and (at == lo or size + len(pieces[at][1]) <= PIECE):
            size += len(pieces[at][1])
            at += 1
        h, index = passages(pa.array([x for _, x in pieces[lo:at]], pa.large_string()))
        bits = np.unpackbits(mix(h[:, None] ^ _SIGNS).astype("<u8").view(np.uint8), axis=1)
        text = np.array([k for k, _ in pieces[lo:at]], np.int64)[index]
        near += 2 * _sums(bits, text, n, np.int64) - np.bincount(text, minlength=n)[:, None]
    out = np.empty((n, WIDTH), np.uint8)
    out[:, :8 * EXACT] = exact.astype("<u8").view(np.uint8).reshape(n, -1)
    out[:, 8 * EXACT:] = (near & 0xFFFF).astype("<u2").view(np.uint8).reshape(n, -1)
    return out


def add(prints: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """The sum of rows of fingerprints, each taken ``times`` (also negative)."""
    t = np.ones(len(prints), np.int64) if times is None else times
    exact = np.ascontiguousarray(prints[:, :8 * EXACT]).view("<u8") * t.astype(np.uint64)[:, None]
    near = np.ascontiguousarray(prints[:, 8 * EXACT:]).view("<u2").astype(np.int64) * t[:, None]
    return np.concatenate([exact.sum(0, dtype=np.uint64).astype("<u8").view(np.uint8),
                           (near.sum(0) & 0xFFFF).astype("<u2").view(np.uint8)])


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows; 1 for equal fingerprints only."""
    a, b = (np.ascontiguousarray(v[:, 8 * EXACT:]).view("<i2").astype(np.float64) for v in (x, y))
    dot, both = (a * b).sum(1), (a * a).sum(1) + (b * b).sum(1)
    got = np.clip(2 * dot / np.maximum(both, 1), 0.0, 1.0 - 1e-6)
    got[(x == y).all(1)] = 1.0
    return got


def _text_of(row: np.ndarray) -> str:
    return base64.b64encode(row.tobytes()).decode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint (binary) of every whole text, in one pass."""
    rows = as_id(docs, id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        release()
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(list(map(len, texts)), pa.int64()),
                     pa.array([r.tobytes() for r in vectors(texts)], pa.binary())], names=["id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, "id long, n_chars long, fingerprint binary")


def update(prints: DataFrame, edits: DataFrame) -> DataFrame:
    """Fingerprints (id, fingerprint) after paragraph edits (id, paragraph, n):
    n copies inserted, or deleted where n is negative. An id without a stored
    fingerprint starts from the empty text; ids in ``prints`` are unique.

    The edits of one id are added up per batch first, so an id that holds a
    third of them is one row a batch in the shuffle.
    """
    def change(batches):
        release()
        for b in batches:
            ids = b.column("id").to_pylist()
            vec = vectors([t or "" for t in b.column("paragraph").to_pylist()])
            empty = hashlib.blake2b(b"", digest_size=8 * EXACT).digest()  # an empty paragraph is one, too
            blank = np.array([not t for t in b.column("paragraph").to_pylist()], bool)
            vec[blank, :8 * EXACT] = np.frombuffer(empty, np.uint8)
            times = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            rows: dict = {}
            for k, i in enumerate(ids):
                rows.setdefault(i, []).append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.int64()),
                 pa.array([add(vec[k], times[k]).tobytes() for k in rows.values()], pa.binary())], names=["id", "fingerprint"])

    def total(t: pa.Table) -> pa.Table:
        vec = np.frombuffer(b"".join(t.column("fingerprint").to_pylist()), np.uint8).reshape(-1, WIDTH)
        return pa.table({"id": t.column("id")[:1], "fingerprint": pa.array([add(vec).tobytes()], pa.binary())})

    changes = (edits.select(F.col("id").cast("long").alias("id"), "paragraph", F.col("n").cast("long").alias("n"))
               .where("paragraph is not null and n is not null").mapInArrow(change, "id long, fingerprint binary"))
    return (prints.select(F.col("id").cast("long").alias("id"), "fingerprint").unionByName(changes)
            .groupBy("id").applyInArrow(total, "id long, fingerprint binary"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the row's key k1, k2, k3: id, hash of the text, place in the input."""
    cols = [F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    rows = row_keyed(docs, *cols, name="k3")
    return rows.select("id", "text", F.coalesce("id", F.lit(_LOWEST)).alias("k1"), F.xxhash64("text").alias("k2"), "k3")


def _sortable(*cols: np.ndarray) -> np.ndarray:
    """Keys as byte strings that compare like the tuples of the columns."""
    flip = np.stack([np.asarray(c, np.int64).view(np.uint64) ^ U(1 << 63) for c in cols], 1)
    return np.ascontiguousarray(flip.astype(">u8")).view(f"S{8 * len(cols)}").reshape(-1)


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Rows block by block in key order, each block followed by the first row
    of the next one (``extra``); None for an empty table."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    keys = stored(rows.select("k1", "k2", "k3", F.octet_length("text").alias("size")), "fingerprint-keys")
    total = keys.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not total["n"]:
        return None
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil_div(total["size"], BLOCK_BYTES))
    ranges = keys.repartitionByRange(parts, "k1", "k2", "k3").groupBy(F.spark_partition_id().alias("range"))
    firsts = [tuple(r["first"]) for r in ranges.agg(F.min(F.struct("k1", "k2", "k3")).alias("first")).collect()]
    firsts.sort()  # one key for each block: total size / BLOCK_BYTES, or the shuffle partitions
    border = _sortable(*np.array(firsts, np.int64).T)
    shared = spark.sparkContext.broadcast(border)

    @F.pandas_udf("int")
    def place(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        """The row's block; for the first row of block b: -1 - b."""
        key = _sortable(k1.to_numpy(), k2.to_numpy(), k3.to_numpy())
        at = np.searchsorted(shared.value, key, "right") - 1
        return pd.Series(np.where(shared.value[at] == key, -1 - at, at).astype(np.int32))

    at = F.col("place")
    own = F.struct(F.when(at < 0, -1 - at).otherwise(at).alias("block"), F.lit(False).alias("extra"))
    before = F.struct(F.when(at == -1, len(firsts) - 1).otherwise(-2 - at).alias("block"), F.lit(True).alias("extra"))
    rows = rows.withColumn("place", place("k1", "k2", "k3"))
    rows = rows.withColumn("in", F.explode(F.when(at < 0, F.array(own, before)).otherwise(F.array(own))))
    return (rows.select("in.block", "in.extra", "id", "text", "k1", "k2", "k3").repartitionById(len(firsts), "block")
            .sortWithinPartitions("block", "extra", "k1", "k2", "k3").select("block", "extra", "id", "text"))


_SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of the text whose last half is replaced by
    the successor's beginning, and the likeness to both."""
    def run(batches):
        release()
        held = None  # the last row and its fingerprint: its successor has not come yet
        for whole in batches:
            for b in slices(whole, "text"):
                new = list(zip(b.column("block").to_pylist(), b.column("extra").to_pylist(),
                               b.column("id").to_pylist(), b.column("text").to_pylist()))
                prints = vectors([r[3] for r in new])
                if held:
                    new.insert(0, held[0])
                    prints = np.concatenate([held[1], prints])
                held = new[-1], prints[-1:]
                at = np.array([k for k, r in enumerate(new[:-1]) if not r[1]], np.int64)
                if not len(at):
                    continue
                edited = []
                for k in at.tolist():
                    text = new[k][3]
                    half = len(text) // 2
                    edited.append(text[:len(text) - half] + new[k + 1][3][:half])
                after = vectors(edited)
                yield pa.RecordBatch.from_arrays([
                    pa.array([new[k][2] for k in at], pa.int64()), pa.array([len(new[k][3]) for k in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([_text_of(r) for r in prints[at]], pa.string()),
                    pa.array([_text_of(r) for r in after], pa.string()),
                    pa.array(likeness(prints[at], after)), pa.array(likeness(prints[at], prints[at + 1]))],
                    names=[c.split()[0] for c in _SCHEMA.split(", ")])

    rows = in_blocks(docs, id_col, text_col)
    if rows is None:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    return rows.mapInArrow(run, _SCHEMA)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
