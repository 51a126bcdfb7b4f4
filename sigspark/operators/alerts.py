"""Alert selection (M14) and alert/digest rows (K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..bindings import as_of_ts
from ..functions.text import clip


def select_alerts(scored: DataFrame, as_of: str = L.AS_OF, min_score: float = L.ALERT_MIN_SCORE,
                  lookback_hours: int = L.ALERT_LOOKBACK_HOURS, n: int = L.ALERT_MAX,
                  immediate: float = L.ALERT_IMMEDIATE) -> DataFrame:
    """Scored signals >= min_score whose document was scraped within the
    lookback, top ``n`` by score (unique tie-break), with their channel.

    The limit is the feature (a top-n report): TakeOrderedAndProject keeps
    only n rows per partition before the single final merge.
    """
    since = as_of_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))
    sel = scored.filter((F.col("strategic_score") >= min_score) & (F.col("scraped_at") >= since)) \
                .orderBy(F.desc("strategic_score"), "document_id", "keyword_id").limit(n)
    return sel.withColumn("subject", clip("title", 80)) \
              .withColumn("channel", F.when(F.col("strategic_score") >= immediate, F.lit("immediate"))
                                      .otherwise(F.lit("digest")))


def digest(alerts: DataFrame, immediate: float = L.ALERT_IMMEDIATE) -> DataFrame:
    """One digest row: count and ordered item list of the non-immediate alerts.

    The input is already bounded by the alert limit, so the single group is small.
    """
    d = alerts.filter(F.col("strategic_score") < immediate)
    items = F.sort_array(F.collect_list(F.struct(
        (-F.col("strategic_score")).alias("s"), F.col("document_id"), F.col("keyword_id"))))
    labels = F.transform(items, lambda x: F.concat(x["document_id"].cast("string"), F.lit(":"),
                                                   x["keyword_id"].cast("string")))
    n = F.count(F.lit(1))
    return d.agg(n.alias("n_signals"),
                 F.when(n > 0, F.array_join(labels, "|")).alias("items"))


def alert_rows(alerts: DataFrame, digest_title: str = "Signals of this run: ") -> DataFrame:
    """K7: one row per immediate alert plus one digest row per run."""
    imm = alerts.filter(F.col("channel") == "immediate").select(
        F.lit("immediate").alias("kind"), F.col("subject"), F.lit(1).cast("long").alias("n_signals"))
    dg = digest(alerts).filter(F.col("n_signals") > 0).select(
        F.lit("digest").alias("kind"),
        F.concat(F.lit(digest_title), F.col("n_signals").cast("string")).alias("subject"),
        F.col("n_signals"))
    return imm.unionByName(dg)
