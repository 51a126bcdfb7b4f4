"""Bind the driver's generic tables to the document-signal model.

Every view here is a lazy, deterministic projection of the given parquet
tables (see FIXTURES.md §3), so its work grows with the data. The matching
DuckDB definitions live in ``sigspark.plans.sqlviews``; keep both in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from .session import prepare

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list, idx: Column) -> Column:
    """values[idx] for a small fixed list, as a CASE chain (no array alloc)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def as_of_ts(as_of: str = L.AS_OF) -> Column:
    return F.to_timestamp(F.lit(as_of))


def documents_view(spark: SparkSession, sf_dir: str, as_of: str = L.AS_OF) -> DataFrame:
    """D: the document table of the model, derived from ``documents``."""
    return documents_of(read(spark, sf_dir, "documents"), as_of)


def documents_of(d: DataFrame, as_of: str = L.AS_OF) -> DataFrame:
    """D from rows of ``documents`` (a table or a stream)."""
    i = F.col("doc_id")
    return d.select(
        i.alias("document_id"),
        F.substring("source", 4, 12).cast("int").alias("source_id"),
        F.concat(F.col("source"), F.lit("-"), i.cast("string")).alias("external_id"),
        F.substring_index(F.substring_index("text", "\n", 1), ".", 1).alias("title"),
        F.concat(F.lit("doc/"), i.cast("string")).alias("url"),
        F.when(i % 17 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (i % 366).cast("int")))
         .alias("publish_date"),
        (as_of_ts(as_of) - F.make_dt_interval(F.lit(0), (i % 72).cast("int"))).alias("scraped_at"),
        F.col("lang").alias("language"),
        F.col("text").alias("full_text"),
        _pick(L.TEST_COUNTRIES, i % 10).alias("country"),
        _pick(L.TEST_DOC_TYPES, i % 8).alias("document_type"),
        "source", "n_chars",
    )


def sources_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: one row per distinct ``documents.source`` (a small dimension)."""
    d = read(spark, sf_dir, "documents").select("source").distinct()
    sid = F.substring("source", 4, 12).cast("int")
    return d.select(
        sid.alias("source_id"),
        F.col("source").alias("source_name"),
        _pick(L.TEST_SOURCE_TYPES, sid % 7).alias("source_type"),
        F.lit(None).cast("string").alias("country"),
        _pick(L.TEST_REGIONS, sid % 5).alias("region"),
        (sid % 5 + 1).alias("trust_level"),
        F.lit(True).alias("active"),
    )


def lexicon_view(spark: SparkSession, rows=None) -> DataFrame:
    """K: keyword dimension (config, bounded by the lexicon size)."""
    rows = L.TEST_LEXICON if rows is None else rows
    return spark.createDataFrame(
        [(int(k), str(w), int(lv), str(c), None, None, True) for k, w, lv, c in rows],
        "keyword_id int, keyword string, level int, cluster string, "
        "disease_area string, geography_tag string, active boolean")


def trends_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: keyword interest series derived from ``events``."""
    e = read(spark, sf_dir, "events")
    rising = (F.col("event_id") % 11) == 0
    return e.select(
        F.col("event_type").alias("keyword"),
        F.concat(F.lit("G"), (F.col("user_id") % 31).cast("string")).alias("geography"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("interest_score"),
        F.when(rising, F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("related_topic"),
        rising.alias("is_rising"),
        F.col("event_id"),
    )


def flows_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F: blacklist-like rows (ip, country code, confidence) from ``events``."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ip_id"),
        F.concat(F.lit("C"), (F.col("user_id") % 60).cast("string")).alias("country_code"),
        F.least(F.col("value"), F.lit(100.0)).alias("confidence"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("category"),
    )


def notes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: one note per (conv_id, turn); updated_at grows with the turn."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("document_id"),
        F.col("text").alias("note_text"),
        F.col("role").alias("author"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00"))
         + F.make_dt_interval(F.lit(0), F.col("turn").cast("int"))).alias("updated_at"),
        F.col("turn"),
    )
