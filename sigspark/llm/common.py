"""What the training-data operators share: tables, stored stages, keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The white space of the contracts: space and \t..\r.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``: a lost executor costs only the
    tasks that ran on it. Unlike a checkpoint the copy is columnar (later
    readers take only the columns they need) and carries no partitioning,
    so a following aggregation combines before it shuffles.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def ceil_div(total: int | float | None, unit: int) -> int:
    return max(1, -(-int(total or 0) // unit))


def as_id(df: DataFrame, id_col: str, *cols: Column) -> DataFrame:
    """Only the id (as ``id`` long) and the given columns: other columns of
    the input, whatever their names, cannot clash with working columns."""
    return df.select(F.col(id_col).cast("long").alias("id"), *cols)


def row_keyed(docs: DataFrame, *cols, name: str = "row") -> DataFrame:
    """The given columns and a key for every row: a hash of its file and its
    place in it. Rows that come from no file are stored with a number."""
    try:
        return docs.select(*cols, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
    except AnalysisException:
        return stored(docs.select(*cols, F.monotonically_increasing_id().alias(name)), "rows")


#: What operators keep in a Python worker between its tasks.
_KEPT: list[dict] = []


def keep_in_worker() -> dict:
    """A dictionary that outlives a task but not another operator's tasks."""
    _KEPT.append({})
    return _KEPT[-1]


def release(but: dict | None = None) -> None:
    """Drop what other operators' tasks have left in this Python worker."""
    for kept in _KEPT:
        if kept is not but:
            kept.clear()
    pa.default_memory_pool().release_unused()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors.

    Rows hold whole texts, so that Arrow batches are kept to 2,000 rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    sc = spark.sparkContext
    if getattr(sc, "_sigspark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="sigspark-code-")  # Spark's file server deals it out
    name = os.path.join(folder, "sigspark_code.zip")
    with zipfile.ZipFile(name, "w") as z:
        for at, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("sigspark", os.path.relpath(full, root)))
    sc.addPyFile(name)
    sc._sigspark_shipped = True
