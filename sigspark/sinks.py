"""Sinks (K1-K8): appends, child rows, upsert without a table format,
day-partition replace, key deletes, CSV export, run stats.

Writes go to Parquet partitioned by a date/month column. Replacing days
rewrites those partitions only; an upsert rewrites the hash buckets it hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicon as L
from .bucketed import BucketTable
from .operators.relational import latest_per


def default_flags(docs: DataFrame) -> DataFrame:
    """K1 companion: one all-false flags row per new document."""
    return docs.select("document_id", *[F.lit(False).alias(f) for f in L.FLAG_NAMES])


def write_documents(new: DataFrame, path: str, flags_path: str | None = None,
                    partition_col: str = "publish_month") -> None:
    """K1: append new documents (partitioned by month) and their default flags."""
    out = new.withColumn(partition_col, F.date_format(F.coalesce("publish_date", F.to_date("scraped_at")), "yyyy-MM"))
    out.write.mode("append").partitionBy(partition_col).parquet(path)
    if flags_path:
        default_flags(new).write.mode("append").parquet(flags_path)


def write_child(docs: DataFrame, path: str, extra_col: str = "extra", key: str = "document_id") -> None:
    """K2: child-table rows of a document subtype (struct column flattened),
    keyed by the stored document."""
    docs.select(key, f"{extra_col}.*").write.mode("append").parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """K3: merged table = target rows whose key is not updated + the newest
    update per key."""
    latest = latest_per(updates, keys, order_col)
    kept = target.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*target.columns))


def read_latest(spark: SparkSession, path: str, keys: list[str], buckets: int = 32) -> DataFrame | None:
    """The newest committed state of an upserted table; None before the first."""
    return BucketTable(spark, path, keys, buckets).read()


def write_upsert(target_path: str, updates: DataFrame, keys: list[str], order_col: str, buckets: int = 32,
                 keep: int = 2) -> None:
    """K3 on disk: buckets that hold updated keys are written anew, others stay.

    The newest update of a key replaces its stored row. The commit counts once
    its manifest is in place; folders that the last ``keep`` manifests do not
    name are removed. Repeating an upsert gives the same table.
    """
    table = BucketTable(updates.sparkSession, target_path, keys, buckets)
    table.commit(updates, lambda old, new: upsert(old, new, keys, order_col))
    table.vacuum(keep)


def overwrite_day(df: DataFrame, path: str, date_col: str = "date") -> None:
    """K4: replace exactly the days present in ``df`` (idempotent re-run)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """K5: rows whose key is not deleted; apply to annotations for the cascade."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    """K6: CSV export with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_observed(rows: DataFrame, path: str, metrics: dict[str, Column], mode: str = "overwrite",
                   partition_by: tuple[str, ...] = ()) -> dict[str, int]:
    """K8 without a pass of its own: write rows and return the metrics
    (aggregates) of what was written.

    They are taken in the stage that writes. Its tasks count once for each
    partition, also when a task or a stage runs again, which does not hold for
    metrics taken before a shuffle.
    """
    seen = Observation()
    out = rows.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    out.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return seen.get


def run_stats(rows: DataFrame, key: str, parsed: Column, hash_col: str, order: str,
              mark: str | None = None) -> DataFrame:
    """K8: per-source fetched / parsed / new / errors (+ high-water mark).

    New is the first row (by ``order``) of each content hash. One pass: rows
    are combined per hash and source, and only these counts meet by hash.
    """
    aggs = [F.count(F.lit(1)).alias("fetched"), F.count_if(parsed).alias("parsed"), F.min(order).alias("_first")]
    if mark:
        aggs.append(F.max(mark).alias("high_water_mark"))
    g = rows.groupBy(hash_col, key).agg(*aggs)
    first = F.min("_first").over(Window.partitionBy(hash_col))  # a row per source at most
    g = g.withColumn("new", (F.col("_first") == first).cast("int"))
    return g.groupBy(key).agg(
        F.sum("fetched").alias("fetched"), F.sum("parsed").alias("parsed"), F.sum("new").alias("new"),
        (F.sum("fetched") - F.sum("parsed")).alias("errors"),
        *([F.max("high_water_mark").alias("high_water_mark")] if mark else []))
