"""Comparing the rows of a group with each other, in blocks.

A group (an LSH bucket, a candidate component) of any size is compared in
tasks of bounded size: its rows are dealt to blocks of about ``limit`` rows,
and each pair of blocks is one unit. Inside a task units come one after the
other from sorted rows; what leaves a unit is at most a count and a link of a
spanning forest per row, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def units(rows: DataFrame, sizes: DataFrame, keys: list[str], id_col: str, limit: int) -> DataFrame:
    """``rows`` with blk, i, j: one copy for every unit the row belongs to.

    ``sizes``: keys and n, the groups to compare (others are left out).
    """
    parts = sizes.select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("nb"))
    out = rows.join(parts, keys).withColumn("blk", F.pmod(F.xxhash64(id_col), F.col("nb")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return (out.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))
            .drop("nb", "other"))


def dealt(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Rows dealt out and sorted by unit."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def sorted_units(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The units of two rows or more among sorted batches."""
    held: list[pa.RecordBatch] = []
    held_key = None

    def done():
        if sum(b.num_rows for b in held) > 1:
            yield pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.append(np.flatnonzero(new), b.num_rows)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            edge = lo == 0 or hi == b.num_rows
            if not edge:
                if held:
                    yield from done()
                    held, held_key = [], None
                if hi - lo > 1:
                    yield pa.Table.from_batches([b.slice(lo, hi - lo)])
                continue
            key = tuple(c[lo] for c in cols)
            if held and key != held_key:
                yield from done()
                held = []
            held_key = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from done()


def matrix(col, dtype) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]]
    return data.view(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric boolean matrix."""
    n = len(linked)
    left = linked.any(1)
    out = []
    for k in range(n):
        if not left[k]:
            continue
        left[k] = False
        front = np.array([k])
        while len(front):
            found = linked[front].any(0) & left
            left &= ~found
            front = np.flatnonzero(found)
            out += [(k, int(x)) for x in front]
    return out
