"""Registered queries: keyword interest series (T view) and weighted flow
edges (F view): S7, S8, A9-A11, A18-A21, P20, P21, W2, F12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import flows_view, trends_view
from ..functions.numeric import rnd, rnd_sql
from ..operators import relational as RL
from ..operators import series as SR
from .registry import register

KEYWORDS = ["click", "error", "purchase", "signup", "view"]   # the event-type enum

T_SQL = """WITH t_trends AS (
  SELECT event_type AS keyword, 'G' || CAST(user_id % 31 AS VARCHAR) AS geography, CAST(ts AS DATE) AS date,
         value AS interest_score,
         CASE WHEN event_id % 11 = 0 THEN 'k' || json_extract_string(props, '$.k') END AS related_topic,
         (event_id % 11 = 0) AS is_rising, event_id
  FROM events),
ts_data AS (SELECT * FROM t_trends WHERE NOT is_rising AND interest_score IS NOT NULL)
"""


def _ts(spark, sf_dir):
    return SR.series_points(trends_view(spark, sf_dir))


@register("trends_kpis", T_SQL + f"""
SELECT (SELECT count(DISTINCT geography) FROM ts_data) AS n_countries,
       (SELECT count(DISTINCT keyword) FROM ts_data) AS n_keywords,
       (SELECT {rnd_sql('avg(interest_score)')} FROM ts_data WHERE date = (SELECT max(date) FROM ts_data)) AS avg_latest,
       (SELECT count(*) FROM t_trends WHERE is_rising) AS n_rising""")
def trends_kpis(spark, sf_dir):
    """A5 + A10 + A6: distinct counts, latest date's mean, rising count."""
    t = trends_view(spark, sf_dir)
    ts = SR.series_points(t)
    a = ts.agg(F.countDistinct("geography").alias("n_countries"),
               F.countDistinct("keyword").alias("n_keywords"))
    b = SR.at_latest(ts).agg(rnd(F.avg("interest_score")).alias("avg_latest"))
    c = t.agg(F.count_if("is_rising").alias("n_rising"))
    return a.crossJoin(b).crossJoin(c)        # three one-row aggregates


@register("trends_mean_by_geo", T_SQL + f"""
SELECT date, geography, {rnd_sql('avg(interest_score)')} AS mean_interest FROM ts_data GROUP BY 1, 2""")
def trends_mean_by_geo(spark, sf_dir):
    """Mean interest by (date, country)."""
    m = SR.mean_by(_ts(spark, sf_dir), ["date", "geography"])
    return m.select("date", "geography", rnd("mean_interest").alias("mean_interest"))


@register("trends_mean_by_keyword", T_SQL + f"""
SELECT date, keyword, {rnd_sql('avg(interest_score)')} AS mean_interest FROM ts_data GROUP BY 1, 2""")
def trends_mean_by_keyword(spark, sf_dir):
    """Mean interest by (date, keyword)."""
    m = SR.mean_by(_ts(spark, sf_dir), ["date", "keyword"])
    return m.select("date", "keyword", rnd("mean_interest").alias("mean_interest"))


@register("trends_latest_pivot", T_SQL + ", lt AS (SELECT * FROM ts_data WHERE date = (SELECT max(date) FROM ts_data))\n"
          + "SELECT geography, " + ", ".join(
              f"{rnd_sql(f'avg(interest_score) FILTER (WHERE keyword = {chr(39)}{k}{chr(39)})')} AS {k}" for k in KEYWORDS)
          + " FROM lt GROUP BY geography")
def trends_latest_pivot(spark, sf_dir):
    """Country x keyword mean at the latest date (explicit pivot values)."""
    p = SR.latest_pivot(_ts(spark, sf_dir), "geography", "keyword", KEYWORDS)
    return p.select("geography", *[rnd(k).alias(k) for k in KEYWORDS])


@register("rising_latest_top50", T_SQL + """
, r AS (SELECT geography, keyword, related_topic, arg_max(date, (date, -event_id)) AS date
        FROM t_trends WHERE is_rising GROUP BY 1, 2, 3)
SELECT * FROM r ORDER BY date DESC, geography, keyword, related_topic LIMIT 50""")
def rising_latest_top50(spark, sf_dir):
    """W2 + T4: rising rows, newest per (country, keyword, topic), top 50."""
    t = trends_view(spark, sf_dir).filter("is_rising") \
        .select("geography", "keyword", "related_topic", "date", "event_id")
    t = t.withColumn("_o", F.struct("date", (-F.col("event_id")).alias("e")))
    latest = RL.latest_per(t.drop("event_id"), ["geography", "keyword", "related_topic"], "_o").drop("_o")
    return RL.top_k(latest, [F.desc("date"), F.col("geography"), F.col("keyword"), F.col("related_topic")], 50)


@register("trends_unpivot", T_SQL + """
, lastd AS (SELECT max(date) AS mx FROM ts_data)
SELECT date, geography, keyword, interest_score FROM (
  SELECT date, geography, keyword, max(interest_score) AS interest_score
  FROM ts_data GROUP BY 1, 2, 3)
WHERE date < (SELECT mx FROM lastd)""")
def trends_unpivot(spark, sf_dir):
    """S8 + F12: a wide interest matrix (one column per keyword, last date
    marked partial) unpivoted back to long rows with partial points dropped."""
    ts = _ts(spark, sf_dir)
    wide = ts.groupBy("date", "geography").pivot("keyword", KEYWORDS).agg(F.max("interest_score"))
    mx = ts.agg(F.max("date").alias("_mx"))
    wide = wide.join(F.broadcast(mx), how="cross").withColumn("isPartial", F.col("date") == F.col("_mx")).drop("_mx")
    return SR.unpivot_trends(wide, ["date", "geography"], KEYWORDS)


# --------------------------------------------------------------- flows --
F_SQL = """WITH f_ips AS (
  SELECT 'ip' || CAST(event_id AS VARCHAR) AS ip, 'C' || CAST(user_id % 60 AS VARCHAR) AS country_code,
         least(value, 100.0) AS confidence FROM events),
agg AS (SELECT country_code, count(*) AS count, floor(avg(confidence) * 10.0 + 0.5) / 10.0 AS avg_confidence
        FROM f_ips GROUP BY country_code),
flows AS (SELECT country_code, t.target_country,
                 CASE WHEN count // 7 = 0 AND count > 0 THEN 1 ELSE count // 7 END AS attack_count, avg_confidence
          FROM agg CROSS JOIN (VALUES ('USA'), ('Germany'), ('United Kingdom'), ('France'), ('Italy'),
                                      ('Israel'), ('Healthcare Global')) t(target_country))
"""


def _flows(spark, sf_dir):
    return SR.split_flows(SR.by_country(flows_view(spark, sf_dir)))


@register("blacklist_by_country", F_SQL + "SELECT country_code, count, avg_confidence FROM agg ORDER BY count DESC, country_code LIMIT 50")
def blacklist_by_country(spark, sf_dir):
    """A18 + P21: count and mean confidence, a listing of 50 origins."""
    return SR.by_country(flows_view(spark, sf_dir), 50)


@register("flow_split", F_SQL + "SELECT country_code, target_country, attack_count, avg_confidence FROM flows")
def flow_split(spark, sf_dir):
    """A19 + J10: origin x fixed targets with the even share."""
    return _flows(spark, sf_dir)


@register("flow_totals_pairs", F_SQL + """
SELECT country_code, target_country, sum(attack_count) AS attacks FROM flows GROUP BY 1, 2
HAVING sum(attack_count) > 0 ORDER BY attacks DESC, country_code, target_country LIMIT 100""")
def flow_totals_pairs(spark, sf_dir):
    """A20 + F12: totals per (origin, target) > 0, top 100."""
    return SR.flow_totals(_flows(spark, sf_dir), ["country_code", "target_country"], 100) \
             .withColumn("attacks", F.col("attacks").cast("bigint"))


@register("flow_totals_origins", F_SQL + """
SELECT country_code, sum(attack_count) AS attacks FROM flows GROUP BY 1
HAVING sum(attack_count) > 0 ORDER BY attacks DESC, country_code LIMIT 15""")
def flow_totals_origins(spark, sf_dir):
    """Totals per origin, top 15."""
    return SR.flow_totals(_flows(spark, sf_dir), ["country_code"], 15) \
             .withColumn("attacks", F.col("attacks").cast("bigint"))


@register("flow_mean_confidence", F_SQL + f"""
SELECT country_code, {rnd_sql('avg(avg_confidence)')} AS mean_confidence FROM flows GROUP BY 1
ORDER BY avg(avg_confidence) DESC, country_code LIMIT 20""")
def flow_mean_confidence(spark, sf_dir):
    """Unweighted mean of the per-row confidence, top 20."""
    return SR.mean_confidence(_flows(spark, sf_dir), 20)


@register("flow_edge_styles", F_SQL + f"""
, tot AS (SELECT country_code, target_country, sum(attack_count) AS attacks FROM flows GROUP BY 1, 2)
SELECT country_code, target_country,
       {rnd_sql('greatest(0.8, ln(1 + attacks) / ln(1 + max(attacks) OVER ()) * 5.0)')} AS width,
       {rnd_sql('greatest(0.8, attacks / max(attacks) OVER () * 5.0)')} AS width_linear,
       {rnd_sql('least(0.8, greatest(0.25, attacks / max(attacks) OVER ()))')} AS opacity,
       {rnd_sql('greatest(4.0, least(20.0, attacks / max(attacks) OVER () * 20.0))')} AS marker
FROM tot""")
def flow_edge_styles(spark, sf_dir):
    """P20 + W5: log-scaled widths, clamped opacity and marker size against
    the global max (one broadcast aggregate row)."""
    tot = _flows(spark, sf_dir).groupBy("country_code", "target_country") \
                               .agg(F.sum("attack_count").alias("attacks"))
    mx = tot.agg(F.max("attacks").alias("mx"))
    j = tot.join(F.broadcast(mx), how="cross")
    x, m = F.col("attacks").cast("double"), F.col("mx").cast("double")
    return j.select("country_code", "target_country",
                    rnd(SR.log_weight(x, m)).alias("width"),
                    rnd(SR.log_weight(x, m, linear=True)).alias("width_linear"),
                    rnd(SR.opacity(x, m)).alias("opacity"),
                    rnd(SR.marker_size(x, m)).alias("marker"))


@register("trends_rising_rows", """
WITH t AS (SELECT event_type AS keyword, 'G' || CAST(user_id % 31 AS VARCHAR) AS geography, CAST(ts AS DATE) AS date, value,
                  CASE WHEN event_id % 11 = 0 THEN 'k' || json_extract_string(props, '$.k') END AS topic FROM events),
g AS (SELECT keyword, geography, topic, max(value) AS v FROM t WHERE topic IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY keyword, geography ORDER BY v DESC, topic) AS k FROM g)
SELECT keyword, geography, (SELECT max(date) FROM t) AS date, 0.0 AS interest_score, TRUE AS is_rising, topic AS related_topic
FROM r WHERE k <= 5""")
def trends_rising_rows(spark, sf_dir):
    """Top-five rising rows appended to the series of each pair."""
    return SR.rising_rows(trends_view(spark, sf_dir))
