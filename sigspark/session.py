"""Session helpers: one place for the settings every job relies on.

Nothing here overrides what a cluster already configured, except the
session time zone: every timestamp in the model is naive UTC, so jobs pin
``spark.sql.session.timeZone`` to UTC (a runtime SQL conf, safe to set), and,
while texts are matched, the size of scan tasks, which ``short_scans`` may
lower and puts back.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "sigspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session builder. On a cluster use the provided session."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings each query needs; cheap and idempotent."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and we only read it. Where it is
    unset, a local session (tests, benches) gets a scratch folder of its own;
    on a cluster that is an error, as one machine's folder is no shared one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sigspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


@contextmanager
def short_scans(spark: SparkSession, size: str = "16m"):
    """Scans that run in the block make tasks of ``size`` at most (a smaller
    setting stays): matching takes much longer than reading, and a few large
    tasks leave cores idle while the last ones end. Files are cut between
    row groups only."""
    key = "spark.sql.files.maxPartitionBytes"
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = spark.conf.get(key)
    if as_bytes(size) < as_bytes(before):
        spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later uses read the
    stored columns they need instead of computing ``df`` again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str | None = None, partitions: int | None = None) -> DataFrame:
    """Deal rows out before CPU-heavy text work, where a caller asks for it.

    ``partitions`` defaults to the session setting ``spark.sigspark.spread``;
    unset or 0 leaves the scan's own tasks (right for inputs of many files).
    """
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sigspark.spread", "0"))
    if not partitions:
        return df
    return df.repartition(partitions, key) if key else df.repartition(partitions)
