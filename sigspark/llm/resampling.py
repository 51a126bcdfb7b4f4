"""Operator 13, importance resampling towards a target distribution.

Features of a text are its words and its pairs of adjacent words, hashed to
``BUCKETS`` buckets. Two narrow counts, one over all documents and one over
all target texts, give each bucket a gain (the logarithm of its ratio of
probabilities); a document weighs the mean gain of its features, and Gumbel
noise seeded by its id turns the largest scores into a weighted draw.

Inside a task n-grams are interned per segment of text: an open-addressed
NumPy table is probed with the xxhash64 of all occurrences at once, a slot is
shared only after the bytes have been compared, and each slot holds its
n-gram's bucket and count. The count pass adds slot counts by bucket; the
scoring pass gathers gains by the slot ids of the occurrences. Segments are
1 MB, however long a text is (a word pair across a cut is counted once), so
memory does not grow with texts. Gains are ``BUCKETS`` numbers at any size.

Ranks over all documents come from range partitions: rows before a partition
plus the place inside it, so no task sees more than a range of narrow rows.

Cases: null and empty texts have no features, weight 0 and no rank; a null id
is drawn with the noise of the empty id and loses ties; rows that repeat an
id have the same noise, their ties are ordered by a hash of the text, and equal
rows take ranks beside each other; empty tables give an empty result or, as
targets, gains from smoothing alone; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_id, ceil_div, release, stored, table
from .wordhash import _segments, slices, string_buffers

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Rows of a rank range, from which the number of ranges follows.
RANGE_ROWS = 1_000_000

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.ones(256, bool)  # bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F], letters of either case inside
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False

# The primes of XXH64 and the polynomial of CRC-32.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                     0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
CRC_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(CRC_POLYNOMIAL), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U(bits)) | (x >> U(64 - bits))


class Spans:
    """Byte spans of one buffer, hashed and compared many at a time."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.start, self.length = start, length
        self.raw = np.concatenate([buf, np.zeros(8, np.uint8)])
        #: The eight bytes from each place on, as one number.
        self.eight = np.ndarray(len(buf) + 1, "<u8", self.raw, strides=(1,)).copy()

    def xxh64(self) -> np.ndarray:
        s, n = self.start, self.length
        h = P5 + n.astype(np.uint64)
        for k in range(3):
            r = np.flatnonzero(n >= 8 * (k + 1))
            lane = _left(self.eight[s[r] + 8 * k] * P2, 31) * P1
            h[r] = _left(h[r] ^ lane, 27) * P1 + P4
        r = np.flatnonzero((n & 7) >= 4)
        h[r] = _left(h[r] ^ ((self.eight[s[r] + (n[r] & ~7)] & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
        for k in range(3):
            r = np.flatnonzero((n & 3) > k)
            h[r] = _left(h[r] ^ (self.raw[s[r] + (n[r] & ~3) + k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        h ^= h >> U(32)
        long = np.flatnonzero(n >= 32)  # these have further lanes: the library's hash
        if len(long):
            view = memoryview(self.raw)
            h[long] = [xxhash.xxh64_intdigest(view[a:a + b]) for a, b in zip(s[long].tolist(), n[long].tolist())]
        return h

    def same(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether spans x and y hold the same bytes."""
        out = self.length[x] == self.length[y]
        view = memoryview(self.raw)
        for k in np.flatnonzero(out & (self.length[x] > 256)).tolist():
            a, b, n = int(self.start[x[k]]), int(self.start[y[k]]), int(self.length[x[k]])
            out[k] = view[a:a + n] == view[b:b + n]
        r = np.flatnonzero(out & (self.length[x] <= 256))
        at = 0
        while len(r):
            a, b = self.start[x[r]] + at, self.start[y[r]] + at
            left = np.minimum(self.length[x[r]] - at, 8)
            differ = (self.eight[a] ^ self.eight[b]) << (U(64) - U(8) * left.astype(np.uint64))
            out[r[differ != 0]] = False
            at += 8
            r = r[(differ == 0) & (self.length[x[r]] > at)]
        return out

    def crc32(self, which: np.ndarray) -> np.ndarray:
        which = which[np.argsort(-self.length[which], kind="stable")]
        s, n = self.start[which], self.length[which]
        crc = np.full(len(which), 0xFFFFFFFF, np.uint32)
        for k in range(min(64, int(n[0]) if len(n) else 0)):
            m = int(np.searchsorted(-n, -k, "left"))  # spans of more than k bytes
            crc[:m] = _CRC[(crc[:m] ^ self.raw[s[:m] + k]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
        crc ^= np.uint32(0xFFFFFFFF)
        view = memoryview(self.raw)
        for k in range(int(np.searchsorted(-n, -64, "left"))):
            crc[k] = zlib.crc32(view[s[k]:s[k] + n[k]])
        return which, crc


class NgramTable:
    """Open addressing with linear probing; a slot holds one n-gram's first
    occurrence (``owner``), its bucket and how often it occurs."""

    def __init__(self, spans: Spans):
        n = len(spans.start)
        mask = (1 << max(4, (2 * n - 1).bit_length() if n else 0)) - 1
        self.owner = np.full(mask + 1, -1, np.int64)
        self.slot = np.zeros(n, np.int64)
        keys = spans.xxh64()
        at = (keys & U(mask)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            p = at[todo]
            free = self.owner[p] < 0
            self.owner[p[free]] = todo[free]  # of several that meet here one stays
            own = self.owner[p]
            found = own == todo
            alike = np.flatnonzero(~found & (keys[own] == keys[todo]))
            found[alike] = spans.same(own[alike], todo[alike])
            self.slot[todo[found]] = p[found]
            todo = todo[~found]
            at[todo] = (at[todo] + 1) & mask
        self.used = np.flatnonzero(self.owner >= 0)
        order, crc = spans.crc32(self.owner[self.used])
        self.bucket = np.zeros(mask + 1, np.int64)
        self.bucket[self.slot[order]] = crc % np.uint32(BUCKETS)
        self.count = np.bincount(self.slot, minlength=mask + 1)


def occurrences(col: pa.Array):
    """(spans, text index) of all words and word pairs, segment by segment."""
    buf, off = string_buffers(col)
    breaks = np.unique(off[:-1])
    carried, carried_text = b"", -1
    for lo, hi in _segments(buf, breaks, _GAP):
        seg = buf[lo:hi]
        on = ~_GAP[seg]
        first, last = on.copy(), on.copy()
        first[1:] &= ~on[:-1]
        last[:-1] &= ~on[1:]
        a, b = np.searchsorted(breaks, (lo + 1, hi))
        cut = breaks[a:b] - lo
        first[cut] = on[cut]
        last[cut - 1] = on[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        text = np.searchsorted(off, s + lo, "right") - 1
        head = carried if carried_text == text[0] else b""
        n = e - s
        if head:
            n, text = np.concatenate([[len(head)], n]), np.concatenate([[carried_text], text])
        at = np.cumsum(n + 1) - (n + 1)
        flat = np.full(int((n + 1).sum()), 32, np.uint8)
        filled = np.ones(len(flat), bool)
        filled[at + n] = False
        flat[filled] = np.concatenate([np.frombuffer(head, np.uint8), _LOWER[seg[on]]])
        pair = np.flatnonzero(text[:-1] == text[1:])
        own = slice(1 if head else 0, None)
        yield (Spans(flat, np.concatenate([at[own], at[pair]]), np.concatenate([n[own], n[pair] + 1 + n[pair + 1]])),
               np.concatenate([text[own], text[pair]]))
        carried, carried_text = flat[at[-1]:at[-1] + n[-1]].tobytes(), int(text[-1])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Occurrences per bucket over all texts: ``BUCKETS`` rows for each task,
    added up by a shuffle; only the totals reach the driver."""
    def count(batches):
        release()
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                for spans, _ in occurrences(b.column("text")):
                    t = NgramTable(spans)
                    np.add.at(total, t.bucket[t.used], t.count[t.used])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    got = (texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target probability / source probability)), add-one smoothed."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *keep) -> DataFrame:
    """id, (kept columns,) n_features, weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers
    rows = as_id(docs, id_col, F.col(text_col).alias("text"), *keep)
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        release()
        gain = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                for spans, text in occurrences(b.column("text")):
                    t = NgramTable(spans)
                    n += np.bincount(text, minlength=b.num_rows)
                    total += np.bincount(text, gain[t.bucket][t.slot], b.num_rows).astype(np.int64)
                weight = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(n), pa.array(weight)],
                                                 names=names + ["n_features", "weight"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, n_features long, weight long")


def noise(id_col: str = "id", seed: int = SEED):
    """floor(-1000 ln(-ln u)) with u from the id's hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place (from 1) in the given total order: rows are
    dealt into ranges, places inside a range follow the rows before it."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil_div(rows.count(), RANGE_ROWS))
    dealt = stored(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return (dealt.withColumn("place", place).join(sizes, "range")
            .withColumn(name, (F.col("before") + F.col("place")).cast("long")).drop("range", "before", "place"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null: not drawn).

    Of the documents with ``min_words`` words the ``percent`` per cent (rounded
    down) with the highest scores are drawn.
    """
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = weigh(docs, gains, id_col, text_col, F.xxhash64(F.col(text_col)).alias("tie"))
    rows = rows.withColumns({"score": F.col("weight") + noise("id", seed), "row": F.monotonically_increasing_id(),
                             "enough": F.col("n_features") >= 2 * min_words - 1})  # w words have 2w - 1 features
    rows = stored(rows, "weights")
    n = rows.where("enough").count()
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie").asc(),
             F.col("row").asc()]
    drawn = F.col("enough") & (F.col("place_of_all") <= n * percent // 100)
    return ranked(rows, order, "place_of_all").select(
        "id", "n_features", "weight", "score", F.when(drawn, F.col("place_of_all")).alias("rank"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


#: crc32 byte by byte over each different feature, with a table made by rule.
ORACLE = r"""
WITH RECURSIVE crc_bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8),
texts AS (
  SELECT 'd' AS side, CAST(doc_id AS BIGINT) AS id, text FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS BIGINT), text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
grams AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f
  FROM words),
per_text AS (SELECT side, id, f, count(*) AS n FROM grams GROUP BY ALL),
names AS (
  SELECT f, xor(list_reduce(
           list_transform(range(0, strlen(f)), lambda k: CAST('0x' || substr(hex(encode(f)), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT)),
           lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM per_text), crc_table),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t
  FROM per_text JOIN names USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000)
                                      / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM counts, totals),
weights AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features,
         CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM per_text JOIN names USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5)
                                                        / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scores WHERE n_features >= 39)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 25 // 100 THEN place END AS rank
FROM scores LEFT JOIN places USING (doc_id)
"""
