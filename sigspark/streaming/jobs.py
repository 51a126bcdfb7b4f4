"""Structured Streaming jobs over landed files.

The studied system polls sources every 12 h and keeps incremental state in
its database (high-water marks, seen hashes, untagged / unscored rows). Here
that state lives in Structured Streaming: the file-source checkpoint is the
high-water mark, watermarked dedup replaces the seen-hash lookups, and
per-micro-batch scoring runs in ``foreachBatch`` against the stored tables.
Checkpoints go under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import lexicon as L
from ..bucketed import BucketTable, SeenKeys, combined, newest
from ..operators import scoring, tagging
from ..operators.relational import first_per, new_only
from ..session import ensure_checkpoint_dir
from ..sinks import write_observed


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def ingest_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """New landed files per trigger, explicit schema (no inference)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def event_time(df: DataFrame, ts_col: str, delay: str) -> DataFrame:
    """Event time with a watermark; times without a zone are the session's (UTC)."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)


def dedup_stream(docs: DataFrame, key: str = "content_hash", ts_col: str = "scraped_at",
                 delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key seen within the watermark delay (state is
    bounded by the delay). Dedup over the whole history is
    ``first_seen_batches``."""
    return event_time(docs, ts_col, delay).dropDuplicatesWithinWatermark([key])


def new_against_table(batch: DataFrame, stored_path: str, key: str, order: list[str]) -> DataFrame:
    """X2 (full history): the batch's first row per key whose key is not in
    the stored table; a table that is not there yet holds nothing."""
    spark = batch.sparkSession
    if not path_exists(spark, stored_path):
        return first_per(batch, [key], order)
    return new_only(batch, spark.read.parquet(stored_path), [key], order)


def tag_stream(docs: DataFrame, K_: DataFrame, S: DataFrame) -> DataFrame:
    """Stateless tagging of a document stream: exact and fuzzy signals
    with their document's flags (no shuffle, no state)."""
    m = tagging.with_source_type(tagging.with_hits(docs, K_), S)
    m = m.select("document_id", "hits", *tagging.merged_flags(tagging.match_flags(), tagging.type_flags()))
    return tagging.signals(m, "document_id", *L.FLAG_NAMES)


def weekly_counts(events: DataFrame, ts_col: str, label: str, delay: str = "2 days") -> DataFrame:
    """Event-time counts per (week, label); weeks start on Monday
    (1970-01-01 was a Thursday, hence the 4-day start offset)."""
    w = F.window(ts_col, "7 days", startTime="4 days")
    return event_time(events, ts_col, delay).groupBy(w.alias("w"), label) \
                 .agg(F.count(F.lit(1)).alias("n")) \
                 .select(F.to_date(F.col("w.start")).alias("week_start"), label, "n")


def alert_feed(scored: DataFrame, min_score: float = 6.0, ts_col: str = "scraped_at",
               delay: str = "12 hours") -> DataFrame:
    """X6 with bounded state: each signal once within the watermark (once ever:
    ``first_seen_batches``)."""
    return event_time(scored.filter(F.col("strategic_score") >= min_score), ts_col, delay) \
                 .dropDuplicatesWithinWatermark(["document_id", "keyword_id"])


def score_batches(state_path: str, out_path: str, K_: DataFrame, S: DataFrame, as_of: str, buckets: int = 32):
    """foreachBatch scorer of new documents against all signals so far.

    Signal counts per keyword, source and day are kept in a bucketed table. A
    batch is tagged once, adds its own counts to the buckets of its keywords
    and reads these buckets back; earlier signals are never read again. Every
    output has the epoch for its version, and a retried batch replaces it.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        here = f"{state_path}/signals/epoch={epoch}"
        scoring.signal_rows(batch, S, K_).write.mode("overwrite").parquet(here)
        new = spark.read.parquet(here)
        counts = BucketTable(spark, f"{state_path}/counts", ["keyword_id"], buckets)
        key = ["keyword_id", "source_id", "publish_date"]
        counts.commit(scoring.signal_counts(new), combined(key, n=F.sum), version=epoch)
        known = counts.read(epoch, counts.touched(new))
        scoring.finish(new, as_of, over=known).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        counts.vacuum(keep=3)
    return run


def upsert_batches(target_path: str, keys: list[str], order_col: str, buckets: int = 32):
    """foreachBatch upsert (K3): the newest row of a key by ``order_col``,
    in whatever order batches come; only buckets with keys of the batch are
    written. A repeated epoch gives the same table."""
    def run(batch: DataFrame, epoch: int) -> None:
        table = BucketTable(batch.sparkSession, target_path, keys, buckets)
        table.commit(batch, newest(keys, order_col), version=epoch)
        table.vacuum(keep=3)
    return run


def first_seen_batches(seen_path: str, out_path: str, key: list[str], order: list[str], buckets: int = 32,
                       words: int = 1 << 14):
    """X2 / X6 over the whole history: the first row of every key that ever
    came, appended once. Keys are probed against Bloom filters, and only
    buckets that may hold one of them are read."""
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = SeenKeys(spark, seen_path, key, buckets, words)
        here = f"{out_path}/epoch={epoch}"
        seen.unseen(first_per(batch, key, order), epoch - 1).write.mode("overwrite").parquet(here)
        seen.add(spark.read.parquet(here), epoch)
    return run


STATS_SCHEMA = "fetched long, parsed long, errors long, new long"


def observed_batches(out_path: str, seen_path: str, parsed: Column, key: list[str], order: list[str], buckets: int = 32):
    """foreachBatch ingest whose run statistics come from its writes.

    Rows land once, those that do not parse in a partition of their own
    (``parsed=false``, kept for another try); the first parsed row of every key
    that never came before goes to the new rows. Fetched, parsed and errors are
    observed while rows land, new while new rows are written, and the batch's
    statistics are a row of its epoch, which a repeated batch replaces.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        landed, fresh = f"{out_path}/landed/epoch={epoch}", f"{out_path}/new/epoch={epoch}"
        rows = batch.withColumn("parsed", F.coalesce(parsed, F.lit(False)))
        took = write_observed(rows, landed, {"fetched": F.count(F.lit(1)), "parsed": F.count_if("parsed"),
                                             "errors": F.count_if(~F.col("parsed"))}, partition_by=("parsed",))
        seen = SeenKeys(spark, seen_path, key, buckets)
        good = spark.read.schema(rows.schema).parquet(landed).filter("parsed").drop("parsed")
        took |= write_observed(seen.unseen(first_per(good, key, order), epoch - 1), fresh, {"new": F.count(F.lit(1))})
        seen.add(spark.read.schema(batch.schema).parquet(fresh), epoch)
        stats = spark.createDataFrame([(took["fetched"], took["parsed"], took["errors"], took["new"])], STATS_SCHEMA)
        stats.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/stats/epoch={epoch}")
    return run


def run_available(df: DataFrame, name: str, sink_path: str | None = None, mode: str = "append",
                  foreach_batch=None) -> StreamingQuery:
    """Drain everything available now, then stop (batch-like trigger)."""
    spark = df.sparkSession
    w = df.writeStream.option("checkpointLocation", checkpoint_path(spark, name)).outputMode(mode) \
          .trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format("parquet").option("path", sink_path).start()
    q.awaitTermination()
    return q


def weekly_counts_table(spark: SparkSession, events_dir: str, schema, ts_col: str, label: str,
                        out_path: str, name: str, delay: str = "2 days") -> DataFrame:
    """X5 end to end: stream the landed files and append each week once the
    watermark has passed it; weeks that are still open at the end are state,
    which the next run goes on with. Returns the stored table."""
    counts = weekly_counts(ingest_stream(spark, events_dir, schema), ts_col, label, delay)
    run_available(counts, name, sink_path=out_path)
    return spark.read.schema(counts.schema).parquet(out_path)
