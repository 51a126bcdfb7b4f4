"""Registered streaming queries, drained from the landed tables and compared
with batch SQL (X1-X6). Tables and checkpoints lie under the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import lexicon as L
from ..bindings import documents_of, read
from ..bucketed import BucketTable
from ..functions.numeric import rnd, rnd_sql
from ..functions.text import content_hash
from ..session import ensure_checkpoint_dir, short_scans
from ..streaming import jobs
from . import sqlviews as V
from .model import model
from .registry import register
from .signals import SCORE_COLS, R, _round_scores, _sql_scores


def _stream(spark, sf_dir, table):
    """A landed table as a stream (the file source wants a pattern or dir)."""
    schema = read(spark, sf_dir, table).schema
    return jobs.ingest_stream(spark, os.path.join(sf_dir.rstrip("/"), f"{table[:-1]}[{table[-1]}].parquet"), schema)


def _run(spark, name):
    run = f"{name}-{uuid.uuid4().hex}"
    return run, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{run}"


@register("stream_weekly_event_counts", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, count(*) AS n
FROM events GROUP BY 1, 2
HAVING date_trunc('week', any_value(ts)) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_weekly_event_counts(spark, sf_dir):
    """X1 + X5: weekly windows aligned to Monday, appended once the watermark
    has passed them."""
    run, out = _run(spark, "weekly")
    schema = read(spark, sf_dir, "events").schema
    src = os.path.join(sf_dir.rstrip("/"), "event[s].parquet")
    return jobs.weekly_counts_table(spark, src, schema, "ts", "event_type", out, run)


@register("stream_users_once", "SELECT DISTINCT user_id FROM events")
def stream_users_once(spark, sf_dir):
    """Repeats of a key within the watermark are dropped."""
    run, out = _run(spark, "users")
    once = jobs.dedup_stream(_stream(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "60 days")
    jobs.run_available(once.select("user_id"), run, out)
    return spark.read.parquet(out)


@register("stream_tags", V.with_(*V.SIGNAL_CHAIN, V.FLAGS) + f"""
SELECT g.document_id, g.keyword_id, {rnd_sql('g.match_score', R)} AS match_score, f.is_regulatory, f.is_diga
FROM g_sig g JOIN f_flags f USING (document_id)""")
def stream_tags(spark, sf_dir):
    """A document stream tagged (exact and fuzzy) with flags."""
    m = model(spark, sf_dir)
    run, out = _run(spark, "tags")
    jobs.run_available(jobs.tag_stream(documents_of(_stream(spark, sf_dir, "documents")), m.K, m.S), run, out)
    return spark.read.parquet(out).select("document_id", "keyword_id", rnd("match_score", R).alias("match_score"),
                                          "is_regulatory", "is_diga")


def _landed(rows, name, source, key, batches=3, foreach_batch=None):
    """Land ``rows`` in ``batches`` ranges of ``key``, one after the other, and
    drain the stream after each: every range is one micro-batch."""
    spark = rows.sparkSession
    top = rows.agg(F.max(key)).first()[0]  # one number
    edge = [-(-k * ((-1 if top is None else top) + 1) // batches) for k in range(batches + 1)]
    for k in range(batches):
        # plain bounds, which the scan takes: a batch does not read the others' texts
        rows.filter((F.col(key) >= edge[k]) & (F.col(key) < edge[k + 1])).write.mode("append").parquet(source)
        stream = jobs.ingest_stream(spark, source, rows.schema)
        jobs.run_available(stream, name, foreach_batch=foreach_batch)


def _scored_stream(spark, sf_dir, batches=None):
    m = model(spark, sf_dir)
    run, out = _run(spark, "scored")
    score = jobs.score_batches(f"{out}/state", f"{out}/scores", m.K, m.S, m.as_of)
    if batches is None:
        with short_scans(spark):
            jobs.run_available(documents_of(_stream(spark, sf_dir, "documents")), run, foreach_batch=score)
    else:
        _landed(read(spark, sf_dir, "documents"), run, f"{out}/landed", "doc_id", batches,
                lambda batch, epoch: score(documents_of(batch), epoch))
    return f"{out}/scores"


@register("stream_signals_scored", V.with_(*V.SCORED_CHAIN) + f"""
SELECT document_id, keyword_id, urgency, {_sql_scores()} FROM scored""")
def stream_signals_scored(spark, sf_dir):
    """Micro-batches scored against all signals so far."""
    sc = spark.read.parquet(_scored_stream(spark, sf_dir))
    return _round_scores(sc.select("document_id", "keyword_id", "urgency", *SCORE_COLS))


@register("stream_novelty", V.with_(*V.SIGNAL_CHAIN) + f"""
, b AS (SELECT g.document_id, g.keyword_id, d.source_id, d.publish_date,
               CAST(floor(g.document_id * 3 / (SELECT max(doc_id) + 1 FROM documents)) AS INTEGER) AS batch
        FROM g_sig g JOIN d_docs d USING (document_id) JOIN s_src USING (source_id)),
c AS (SELECT *, coalesce(publish_date >= {V.CUTOFF}, FALSE) AS recent FROM b),
n AS (SELECT *, count(*) OVER kw AS kw_signals, count(*) FILTER (WHERE recent) OVER kw AS kw_recent,
             count(*) OVER ks AS kw_src_signals FROM c
      WINDOW kw AS (PARTITION BY keyword_id ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             ks AS (PARTITION BY keyword_id, source_id ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT document_id, keyword_id, kw_signals, kw_recent, kw_src_signals,
       {rnd_sql(f"least({V._rarity('kw_signals')} + CASE WHEN kw_recent - CAST(recent AS INTEGER) = 0 THEN {L.NOVELTY_FIRST_POINTS} ELSE 0.0 END + CASE WHEN kw_src_signals - 1 = 0 THEN {L.NOVELTY_NEW_SOURCE_POINTS} ELSE 0.0 END, 10.0)", R)} AS novelty_score
FROM n""")
def stream_novelty(spark, sf_dir):
    """X4 + N1-N3 in three micro-batches: each signal's novelty against the
    signals of its own and earlier batches, from maintained counts."""
    sc = spark.read.parquet(_scored_stream(spark, sf_dir, 3))
    return sc.select("document_id", "keyword_id", "kw_signals", "kw_recent", "kw_src_signals",
                     rnd("novelty_score", R).alias("novelty_score"))


@register("stream_alert_feed", V.with_(*V.SCORED_CHAIN)
          + "SELECT document_id, keyword_id FROM scored WHERE strategic_score >= 6.0")
def stream_alert_feed(spark, sf_dir):
    """Each alert once ever, from the stream of scored signals."""
    path = _scored_stream(spark, sf_dir)
    scored = spark.read.parquet(path)
    run, out = _run(spark, "alerts")
    feed = jobs.ingest_stream(spark, path, scored.schema).filter("strategic_score >= 6.0")
    once = jobs.first_seen_batches(f"{out}/seen", f"{out}/alerts", ["document_id", "keyword_id"], ["scraped_at"])
    jobs.run_available(feed.select("document_id", "keyword_id", "scraped_at"), run, foreach_batch=once)
    return spark.read.parquet(f"{out}/alerts").select("document_id", "keyword_id")


@register("stream_new_documents", """
SELECT sha256(coalesce(text, 'None')) AS content_hash, min(doc_id) AS document_id FROM documents GROUP BY 1""")
def stream_new_documents(spark, sf_dir):
    """X2 / J8 over the whole history: the first document of each content, in
    three micro-batches by id."""
    run, out = _run(spark, "new-docs")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), content_hash("text").alias("content_hash"))
    once = jobs.first_seen_batches(f"{out}/seen", f"{out}/new", ["content_hash"], ["document_id"])
    _landed(d, run, f"{out}/landed", "document_id", 3, once)
    return spark.read.parquet(f"{out}/new").select("content_hash", "document_id")


@register("stream_latest_events", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events GROUP BY user_id""")
def stream_latest_events(spark, sf_dir):
    """X7 + K3: the newest event of each user, upserted in three micro-batches."""
    run, out = _run(spark, "latest")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    _landed(e, run, f"{out}/landed", "event_id", 3, jobs.upsert_batches(f"{out}/latest", ["user_id"], "event_id"))
    return BucketTable(spark, f"{out}/latest", ["user_id"]).read().select("user_id", "event_id", "event_type", "value")


@register("stream_run_stats", """
SELECT count(*) AS fetched, count(*) FILTER (WHERE n_chars >= 20) AS parsed,
       count(*) FILTER (WHERE NOT coalesce(n_chars >= 20, FALSE)) AS errors,
       count(DISTINCT CASE WHEN n_chars >= 20 THEN sha256(coalesce(text, 'None')) END) AS new
FROM documents""")
def stream_run_stats(spark, sf_dir):
    """Fetched, parsed, errors and new rows over three micro-batches,
    observed by the writes that land them."""
    run, out = _run(spark, "observed")
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", content_hash("text").alias("content_hash"))
    batches = jobs.observed_batches(f"{out}/runs", f"{out}/seen", F.col("n_chars") >= 20, ["content_hash"], ["doc_id"])
    _landed(d, run, f"{out}/landed", "doc_id", 3, batches)
    stats = spark.read.schema(jobs.STATS_SCHEMA).parquet(f"{out}/runs/stats")
    return stats.agg(*[F.sum(c).alias(c) for c in ("fetched", "parsed", "errors", "new")])
