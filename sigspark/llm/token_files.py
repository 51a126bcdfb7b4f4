"""Operator 4, token ids as Parquet files.

``write_tokens`` deals documents out by ranges of their id, encodes them in
order and writes one list column per document with its id and length: lists
are dictionary-encoded, ids and lengths delta-encoded, row groups and pages
have set sizes, and the writer adds column and offset indexes. A reader that
asks for lengths never touches the lists, and one that asks for some ids
skips the row groups and pages of all others (``read_tokens``).

``with_starts`` adds how many ids lie before each document: totals per file
part are summed over parts, and a window inside one part adds the rest.

Cases: null text counts as empty and gives the end id only; documents with a
null id come first; rows that repeat an id are ordered by a hash of the text;
an empty table gives an empty set of files; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Store, numbered, spread
from .common import keep_in_worker, new_path, release, table
from .wordhash import slices

#: Parquet settings: row group and page bytes, dictionaries for the token
#: lists, format 2 pages (delta encoding where a dictionary does not pay).
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.writer.version": "v2",
}


#: White space or a separator of any definition after a chunk's first space.
_INNER_SPACE = re.compile(r"\s")


class Encoder(Store):
    """Chunk -> ids with the tokenizers library."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.clear()

    def clear(self):
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, strings):
        """Chunks of one space and a word are encoded many at a time, with line
        ends between them: these are tokens of their own in front of a space,
        and no such chunk has a token with a line end."""
        plain = [k for k, s in enumerate(strings) if s[:1] == " " and len(s.split(None, 1)) == 1 and s[-1:] > " "
                 and not _INNER_SPACE.search(s, 1)]
        rest = sorted(set(range(len(strings))) - set(plain))
        lines = ["\n".join([strings[k] for k in plain[lo:lo + 256]]) + "\n " for lo in range(0, len(plain), 256)]
        n = np.zeros(len(strings), np.int64)
        parts, order = [], []
        if lines:
            ids = np.concatenate([np.array(e.ids[:-1], np.int32) for e in
                                  self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cut = np.flatnonzero(ids == self.line_end)
            n[plain] = np.diff(np.concatenate([[-1], cut])) - 1
            parts.append(np.delete(ids, cut))
            order += plain
        if rest:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([strings[k] for k in rest], add_special_tokens=False)]
            n[rest] = np.fromiter(map(len, got), np.int64, len(got))
            parts.append(np.fromiter(chain.from_iterable(got), np.int32))
            order += rest
        new = np.concatenate(parts)
        at = np.zeros(len(strings), np.int64)
        at[order] = self.used + np.cumsum(n[order]) - n[order]
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(new)] = new
        self.start = np.concatenate([self.start, at])
        self.length = np.concatenate([self.length, n])
        self.used += len(new)

    def encode(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each ended by ``end_id``; ids per text)."""
        chunk, counts = numbered(col, self, first_space=False, only_spaces=False)
        ids = self.flat[spread(self.start[chunk], self.length[chunk])]
        cum = np.concatenate([[0], np.cumsum(self.length[chunk])])
        ends = cum[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        ids = np.insert(ids, ends, end_id).astype(np.int32)
        return ids, np.diff(np.concatenate([[0], ends])) + 1


_ENCODERS = keep_in_worker()


def encoder(path: str) -> Encoder:
    """The Python worker's encoder; it serves the worker's later tasks, too."""
    release(but=_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 0) -> None:
    """Files with part, doc_id, n_tokens, ids in ascending id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def encode(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                ids, n = enc.encode(b.column("text"), end_id)
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), b.column("doc_id"), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(ids))],
                    names=["part", "doc_id", "n_tokens", "ids"])

    out = rows.mapInArrow(encode, "part int, doc_id long, n_tokens long, ids array<int>")
    out.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, *cols: str, first_id: int | None = None,
                last_id: int | None = None) -> DataFrame:
    """The given columns of the documents in an id range (pushed to the files)."""
    df = spark.read.schema("part int, doc_id long, n_tokens long, ids array<int>").parquet(path)
    if first_id is not None:
        df = df.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.where(F.col("doc_id") <= last_id)
    return df.select(*cols) if cols else df


def with_starts(rows: DataFrame, lengths: DataFrame, *order: str) -> DataFrame:
    """Adds ``start``: n_tokens of all rows before, by part and then order.

    ``lengths``: part and n_tokens of the same rows, read by themselves.
    """
    totals = lengths.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
            .join(totals, "part").withColumn("start", F.col("before") + F.col("own"))
            .drop("own", "before"))


def digests(rows: DataFrame) -> DataFrame:
    """ids_crc32 in place of ids: crc32 of the little-endian 32-bit ids."""
    def crc(batches):
        for b in batches:
            ids = b.column("ids")
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            off = ids.offsets.to_numpy()
            off = off - off[0]
            view = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
            got = [zlib.crc32(view[4 * s:4 * e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("doc_id"), b.column("n_tokens"), pa.array(got, pa.int64())],
                names=["part", "doc_id", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "part int, doc_id long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = digests(read_tokens(spark, path, "part", "doc_id", "n_tokens", "ids"))
    lengths = read_tokens(spark, path, "part", "n_tokens")
    return with_starts(rows, lengths, "doc_id").select("doc_id", "start", "n_tokens", "ids_crc32")
