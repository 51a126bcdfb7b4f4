"""Interest series and weighted flow edges.

Every statistic is a partial aggregate on its keys. Series pivots use an
explicit value list (no extra pass to discover the pivot values). "Latest
date" tests use a one-row max aggregate broadcast back, not a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd

# The seven flow targets of the flow split ("simplified model")
FLOW_TARGETS = ["USA", "Germany", "United Kingdom", "France", "Italy", "Israel",
                "Healthcare Global"]

BLACKLIST_SCHEMA = ("struct<data: array<struct<ipAddress: string, countryCode: string, "
                    "abuseConfidenceScore: double>>>")


def series_points(T: DataFrame) -> DataFrame:
    """Non-rising points with a score (Q10: rising rows carry no score)."""
    return T.filter(~F.col("is_rising") & F.col("interest_score").isNotNull())


def mean_by(T: DataFrame, keys: list[str], value: str = "interest_score") -> DataFrame:
    """Mean interest per key combination."""
    return T.groupBy(*keys).agg(F.avg(value).alias("mean_interest"))


def at_latest(T: DataFrame, date_col: str = "date") -> DataFrame:
    """Rows of the latest date (A10/A11) via a broadcast one-row max."""
    mx = T.agg(F.max(date_col).alias("_mx"))
    return T.join(F.broadcast(mx), F.col(date_col) == F.col("_mx")).drop("_mx")


def latest_pivot(T: DataFrame, row: str, col: str, values: list[str],
                 value: str = "interest_score") -> DataFrame:
    """Mean value row x col at the latest date, explicit pivot values."""
    return at_latest(T).groupBy(row).pivot(col, values).agg(F.avg(value))


def unpivot_trends(wide: DataFrame, id_cols: list[str], value_cols: list[str],
                   partial_col: str = "isPartial") -> DataFrame:
    """Interest matrix wide -> long, partial points dropped."""
    w = wide.filter(~F.coalesce(F.col(partial_col), F.lit(False)))
    return w.unpivot(id_cols, value_cols, "keyword", "interest_score") \
            .filter(F.col("interest_score").isNotNull())


def parse_blacklist(raw: DataFrame, col: str = "payload") -> DataFrame:
    """Blacklist JSON payloads -> (ip, country code, confidence) rows."""
    p = raw.select(F.from_json(col, BLACKLIST_SCHEMA).alias("p"))
    return p.select(F.inline("p.data")).select(
        F.col("ipAddress").alias("ip"), F.coalesce("countryCode", F.lit("??")).alias("country_code"),
        F.coalesce("abuseConfidenceScore", F.lit(0.0)).alias("confidence"))


def by_country(F_: DataFrame, k: int | None = None) -> DataFrame:
    """Count and mean confidence (1 decimal) per origin; ``k`` for a
    listing of the most frequent ones."""
    agg = F_.groupBy("country_code").agg(F.count(F.lit(1)).alias("count"),
                                         F.avg("confidence").alias("_avg"))
    if k is not None:
        agg = agg.orderBy(F.desc("count"), "country_code").limit(k)
    return agg.select("country_code", "count", rnd("_avg", 1).alias("avg_confidence"))


def split_flows(agg: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Every origin gets count // len(targets) per target (at least 1
    when count > 0). The target list is fixed config: exploded as a literal."""
    targets = FLOW_TARGETS if targets is None else targets
    n = len(targets)
    share = F.floor(F.col("count") / n).cast("bigint")
    share = F.when((share == 0) & (F.col("count") > 0), F.lit(1).cast("bigint")).otherwise(share)
    return agg.select("country_code", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target_country"),
                      share.alias("attack_count"), "avg_confidence")


def flow_totals(flows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Summed attack counts per key, > 0, top k."""
    s = flows.groupBy(*keys).agg(F.sum("attack_count").alias("attacks")).filter(F.col("attacks") > 0)
    return s.orderBy(F.desc("attacks"), *keys).limit(k)


def mean_confidence(flows: DataFrame, k: int = 20) -> DataFrame:
    """Unweighted mean of avg_confidence per origin, top k."""
    m = flows.groupBy("country_code").agg(F.avg("avg_confidence").alias("_m"))
    return m.orderBy(F.desc("_m"), "country_code").limit(k) \
            .select("country_code", rnd("_m", 4).alias("mean_confidence"))


def rising_rows(T: DataFrame, n: int = 5) -> DataFrame:
    """The first n rising topics of each keyword and geography (by
    interest, then topic) as rows with interest 0 on the latest date."""
    from .relational import top_n_per
    rising = T.filter(F.col("is_rising") & F.col("related_topic").isNotNull())
    rising = rising.groupBy("keyword", "geography", "related_topic").agg(F.max("interest_score").alias("_i"))
    top = top_n_per(rising, ["keyword", "geography"], [F.desc("_i"), F.col("related_topic")], n)
    day = T.agg(F.max("date").alias("date"))
    return top.crossJoin(F.broadcast(day)).select(  # one row
        "keyword", "geography", "date", F.lit(0.0).alias("interest_score"), F.lit(True).alias("is_rising"), "related_topic")


def log_weight(x: Column, global_max: Column, linear: bool = False) -> Column:
    """P20: edge width max(.8, share of the maximum * 5), by logarithms or linear."""
    share = x / global_max if linear else F.log1p(x) / F.log1p(global_max)
    return F.greatest(F.lit(0.8), share * 5.0)


def opacity(x: Column, global_max: Column) -> Column:
    return F.least(F.lit(0.8), F.greatest(F.lit(0.25), x / global_max))


def marker_size(x: Column, global_max: Column) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(20.0), x / global_max * 20.0))
