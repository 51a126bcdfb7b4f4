"""Generic relational operators used by the pages: joins, counts, top-k,
set operations, windows and filters (J*, A1-A8, T*, U*, W*, F*).

Skew notes: counts are partial aggregates (map-side combine), so a hot key
costs one row per map task, not a hot reducer. Windows that would put a
whole hot key in one task (latest-per-key over unbounded groups) are written
with ``max_by`` aggregates instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bindings import as_of_ts
from . import ranks


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------- joins --
def with_source(D: DataFrame, S: DataFrame, cols=("source_name", "source_type", "region",
                                                  "trust_level")) -> DataFrame:
    """Documents x sources (N:1); the planner picks the join by size."""
    return D.join(S.select("source_id", *cols), "source_id")


def by_flag(D: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """Documents whose flag is set (1:1 flags table)."""
    return D.join(flags.filter(F.col(flag)).select("document_id"), "document_id", "left_semi")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (null keys are a key). Only keys and order
    columns are aggregated; they meet the rows again in a join. Rows that are
    equal in all order columns: one of them stays."""
    low = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__low")).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"__low.{o}").alias(f"__o{i}") for i, o in enumerate(order)])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    for i, o in enumerate(order):
        cond = cond & F.col(o).eqNullSafe(F.col(f"__o{i}"))
    return df.join(low, cond, "left_semi").dropDuplicates([*keys, *order])


def new_only(batch: DataFrame, seen: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the batch, without keys that are stored."""
    return first_per(batch, keys, order).join(seen.select(*keys).distinct(), keys, "left_anti")


def cross_small(df: DataFrame, small: DataFrame) -> DataFrame:
    """Cross join with a small fixed list (output = |df| x |small|)."""
    return df.crossJoin(small)


def geo_enrich(df: DataFrame, coords: DataFrame, key: str) -> DataFrame:
    """Inner lookup of coordinates; unmatched rows are dropped."""
    return df.join(coords, key)


def left_lookup(df: DataFrame, dim: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join a label dimension, missing labels get defaults."""
    j = df.join(dim, key, "left")
    for c, v in defaults.items():
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return j


# ------------------------------------------------------------ aggregates --
def value_counts(df: DataFrame, col: str, k: int | None = None, name: str = "n") -> DataFrame:
    """A4: counts per non-NULL value, descending (ties by value); optional head k."""
    out = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if k is not None:
        out = out.orderBy(F.desc(name), col).limit(k)
    return out


def count_by(df: DataFrame, k1: str, k2: str, name: str = "n") -> DataFrame:
    """Observed (k1, k2) combinations with their counts."""
    return df.groupBy(k1, k2).agg(F.count(F.lit(1)).alias(name))


def n_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5: distinct counts of several columns in one pass."""
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def kpi_counts(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """Several conditional counts in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conds.items()])


def count_by_time_filled(df: DataFrame, ts_col: str, unit: str = "day",
                         name: str = "n") -> DataFrame:
    """Counts per calendar bucket with zero-filled gaps between min and max.

    The dense calendar is generated from the (tiny) min/max aggregate, so the
    only wide operation on the data is the partial count.
    """
    b = bucket(F.col(ts_col), unit)
    counts = df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias(name))
    step = {"day": "1 day", "week": "7 days", "month": "1 month"}[unit]
    bounds = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    cal = bounds.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias("bucket"))
    return cal.join(counts, "bucket", "left").select(
        "bucket", F.coalesce(F.col(name), F.lit(0)).alias(name))


def bucket(ts: Column, unit: str) -> Column:
    """Calendar keys. week = week ending Sunday; month = month end date."""
    d = F.to_date(ts)
    if unit == "day":
        return d
    if unit == "week":
        return F.date_add(F.to_date(F.date_trunc("week", d)), 6)
    if unit == "month":
        return F.last_day(d)
    if unit == "ym":
        return F.date_format(d, "yyyy-MM")
    if unit == "mon":
        return F.date_format(d, "MMM")
    raise ValueError(unit)


# ----------------------------------------------------------------- top-k --
def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Total order then limit (TakeOrderedAndProject: k rows per task)."""
    return df.orderBy(*order).limit(k)


def newest(df: DataFrame, n: int, date_col: str = "publish_date", key: str = "document_id") -> DataFrame:
    """Newest n by date, NULL dates first (as a DESC sort in PostgreSQL)."""
    return top_k(df, [F.col(date_col).desc_nulls_first(), F.col(key)], n)


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """T5: sorted distinct non-empty facet values."""
    return df.select(col).filter(F.col(col).isNotNull() & (F.col(col) != "")).distinct()


# -------------------------------------------------------------- set ops --
def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_distinct(dfs: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Concatenate with first-wins dedup on ``keys`` (an earlier input
    wins; inside one input the first row by ``order``)."""
    u = union_all(*[d.withColumn("_prio", F.lit(i)) for i, d in enumerate(dfs)])
    return first_per(u, keys, ["_prio", *order]).drop("_prio")


def nodes(edges: DataFrame, a: str, b: str, name: str = "node") -> DataFrame:
    """Distinct node set of an edge list with a dense sorted index."""
    n = edges.select(F.col(a).alias(name)).union(edges.select(F.col(b).alias(name))).distinct()
    return ranks.place(n, [F.col(name)], "_place").select(name, (F.col("_place") - 1).alias("node_idx"))


# ---------------------------------------------------------------- windows --
def latest_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row per key: the largest order value of each key (combined
    map-side) meets the rows again in a join. One of equal rows stays."""
    top = df.groupBy(*keys).agg(F.max(order).alias("__top")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "__top")
    cond = F.col(order).eqNullSafe(F.col("__top"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(top, cond, "left_semi").dropDuplicates([*keys, order])


def top_n_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Top n rows within each group (row_number <= n).

    Spark plans this with a group-limit (WindowGroupLimit) before the
    shuffle, so each map task ships at most n rows per group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def cumulative(daily: DataFrame, order: str, value: str, name: str = "cumulative") -> DataFrame:
    """Running total over a series with one row per ``order`` value."""
    return ranks.running(daily, [F.col(order)], F.col(value), name)


def paginate(df: DataFrame, key: str, after=None, size: int = 12) -> DataFrame:
    """The page after the last key seen (none: the first page). The key
    reaches the scan as a filter, so late pages cost no more than early ones."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


# ---------------------------------------------------------------- filters --
def recent(df: DataFrame, col: str, as_of: str, days: int = 0, hours: int = 0) -> DataFrame:
    """rows with col >= as_of - window."""
    since = as_of_ts(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))
    return df.filter(F.col(col) >= since)


def recent_or_all(df: DataFrame, col: str, as_of: str, days: int) -> DataFrame:
    """F7 with fallback: when nothing is recent keep every row (no driver count:
    the test is a max() over the data joined back as one broadcast row)."""
    since = as_of_ts(as_of) - F.make_dt_interval(F.lit(days))
    flag = df.agg(F.max(F.col(col) >= since).alias("_any"))
    return df.crossJoin(F.broadcast(flag)).filter(
        (F.col(col) >= since) | ~F.coalesce(F.col("_any"), F.lit(False))).drop("_any")


def facet(df: DataFrame, **sel) -> DataFrame:
    """F8: conditional filters; an empty / None selection means no filter.
    ``date_between=(col, lo, hi)``; other kwargs: column -> allowed values."""
    out = df
    for k, v in sel.items():
        if not v:
            continue
        if k == "date_between":
            c, lo, hi = v
            out = out.filter(F.col(c).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
        else:
            out = out.filter(F.col(k).isin(*list(v)))
    return out


def has_any(arr: str, sel: list[str]) -> Column:
    """array overlaps a selection (empty selection keeps all)."""
    if not sel:
        return F.lit(True)
    return F.arrays_overlap(F.col(arr), F.array(*[F.lit(s) for s in sel]))


def search(col: str, q: str, regex: bool = True, case: bool = True) -> Column:
    """free-text search; regex by default like pandas ``str.contains``."""
    c = F.col(col)
    if not case:
        c, q = F.lower(c), q.lower()
    return F.coalesce(c.rlike(q) if regex else c.contains(q), F.lit(False))


def require(cols: list[str]) -> Column:
    """required fields present and non-blank."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    return cond
