"""Registered page results that no single operator gives (Q-regulatory,
Q-threat, Q-neuro, Q-projects, P13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..operators import classify as C
from ..operators import relational as RL
from ..operators import tagging
from ..operators import textstats as TS
from . import sqlviews as V
from .model import model
from .registry import register
from .text import CLS, first_rule_sql

TYPE_LABELS = [("news", "News"), ("clinical_trial", "Trial"), ("journal_article", "Article")]


def _flagged(m, flag):
    d = tagging.with_source_type(tagging.with_hits(m.Dn, m.K), m.S)
    return d.select("document_id", "title", "country", "source", "publish_date",
                    *tagging.merged_flags(tagging.match_flags(), tagging.type_flags())).filter(flag)


@register("regulatory_timeline", V.with_(*V.SIGNAL_CHAIN, V.FLAGS, V.DN_DOCS) + """
SELECT d.publish_date, d.title, d.source, coalesce(d.country, 'Unknown') AS country
FROM dn_docs d JOIN f_flags f USING (document_id) WHERE f.is_regulatory AND d.publish_date IS NOT NULL
ORDER BY d.publish_date DESC, d.document_id LIMIT 50""")
def regulatory_timeline(spark, sf_dir):
    """Q-regulatory: the 50 newest dated regulatory documents."""
    d = _flagged(model(spark, sf_dir), "is_regulatory and publish_date is not null")
    return d.orderBy(F.desc("publish_date"), "document_id").limit(50).select(
        "publish_date", "title", "source", F.coalesce("country", F.lit("Unknown")).alias("country"))


THREAT_SQL = CLS + f""", th AS (SELECT *, {first_rule_sql('t', L.TEST_THREATS, L.TEST_THREAT_DEFAULT)} AS threat FROM cls)"""


def _threats(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("full_text", F.lit(""))))
    return model(spark, sf_dir).Dn.withColumn("threat", C.first_rule(text, L.TEST_THREATS, L.TEST_THREAT_DEFAULT))


@register("threat_weeks", THREAT_SQL + """
, w AS (SELECT CAST(date_trunc('week', publish_date) AS DATE) AS week, threat FROM th WHERE publish_date IS NOT NULL)
SELECT a.week, b.threat, count(w.week) AS n
FROM (SELECT DISTINCT week FROM w) a CROSS JOIN (SELECT DISTINCT threat FROM w) b
LEFT JOIN w ON w.week = a.week AND w.threat = b.threat GROUP BY 1, 2""")
def threat_weeks(spark, sf_dir):
    """Q-threat: week x threat type, zero-filled."""
    d = _threats(spark, sf_dir).filter("publish_date is not null")
    return TS.crosstab(d.select(F.to_date(F.date_trunc("week", "publish_date")).alias("week"), "threat"), "week", "threat")


@register("threat_kpis", THREAT_SQL + f"""
SELECT threat, count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(DISTINCT country) AS n_countries,
       count(*) FILTER (WHERE publish_date >= DATE '2024-12-01') AS n_recent FROM th GROUP BY threat""")
def threat_kpis(spark, sf_dir):
    """Q-threat: counts by threat type."""
    return _threats(spark, sf_dir).groupBy("threat").agg(
        F.count(F.lit(1)).alias("n_docs"), F.countDistinct("source").alias("n_sources"),
        F.countDistinct("country").alias("n_countries"),
        F.count_if(F.col("publish_date") >= F.lit("2024-12-01").cast("date")).alias("n_recent"))


@register("threat_critical", THREAT_SQL + """
SELECT document_id, publish_date, title, threat FROM th WHERE threat IN ('Licence', 'Identity')
ORDER BY publish_date DESC NULLS LAST, document_id LIMIT 20""")
def threat_critical(spark, sf_dir):
    """Q-threat: the newest 20 documents of the critical types."""
    d = _threats(spark, sf_dir).filter(F.col("threat").isin("Licence", "Identity"))
    return d.orderBy(F.col("publish_date").desc_nulls_last(), "document_id").limit(20) \
            .select("document_id", "publish_date", "title", "threat")


@register("neuro_by_disease", V.with_(*V.SCORED_CHAIN) + """
SELECT k.cluster AS disease, count(*) AS n_signals, count(DISTINCT s.document_id) AS n_docs
FROM scored s JOIN k_lex k USING (keyword_id) WHERE s.is_neuro GROUP BY 1""")
def neuro_by_disease(spark, sf_dir):
    """Q-neuro: signals and documents by disease area of neuro documents."""
    m = model(spark, sf_dir)
    return m.scored.filter("is_neuro").join(m.K.select("keyword_id", F.col("cluster").alias("disease")), "keyword_id") \
            .groupBy("disease").agg(F.count(F.lit(1)).alias("n_signals"), F.countDistinct("document_id").alias("n_docs"))


@register("region_by_month", V.with_(V.D_DOCS, V.S_SRC) + """
, x AS (SELECT s.region, strftime(d.publish_date, '%Y-%m') AS month FROM d_docs d JOIN s_src s USING (source_id)
        WHERE d.publish_date IS NOT NULL)
SELECT a.region, b.month, count(x.month) AS n
FROM (SELECT DISTINCT region FROM x) a CROSS JOIN (SELECT DISTINCT month FROM x) b
LEFT JOIN x ON x.region = a.region AND x.month = b.month GROUP BY 1, 2""")
def region_by_month(spark, sf_dir):
    """Q-projects: region x month, zero-filled."""
    m = model(spark, sf_dir)
    d = RL.with_source(m.D.filter("publish_date is not null"), m.S, ("region",))
    return TS.crosstab(d.select("region", F.date_format("publish_date", "yyyy-MM").alias("month")), "region", "month")


@register("type_labels", V.with_(V.D_DOCS) + f"""
SELECT coalesce({V.case_map('document_type', dict(TYPE_LABELS), None)}, 'Other') AS label, count(*) AS n
FROM d_docs GROUP BY 1""")
def type_labels(spark, sf_dir):
    """Type names shown by a label table, 'Other' where it has none."""
    names = spark.createDataFrame(TYPE_LABELS, "document_type string, label string")
    d = RL.left_lookup(model(spark, sf_dir).D.select("document_type"), names, "document_type", {"label": "Other"})
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
