"""Label and term statistics: counts of exploded labels, hierarchical
rollups, co-occurrence and flow edges, term frequencies, keyword trends
(A13-A17, A22-A27).

Scale notes: every statistic is an explode followed by a partial aggregate,
so a label or word that occurs in a third of all documents is combined
map-side. Pairs are only formed *within one row* (labels x entities of one
document, both bounded by the dictionaries), never across rows of a group.
Top-k word lists are one row of k words that the next stage joins; nothing is
collected while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored_once

# explode_outer + a NULL filter instead of explode: an inner explode lets the
# optimizer infer "size(array) > 0" and push it (with the whole array
# expression) below a repartition into the scan stage; this keeps the
# per-row dictionary work after the spread, on all cores.


def label_counts(df: DataFrame, arr: str, k: int | None = None, name: str = "label",
                 count_name: str = "n") -> DataFrame:
    """Counts of exploded labels, optional top-k (ties by label)."""
    out = df.select(F.explode_outer(arr).alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias(count_name))
    if k is not None:
        out = out.orderBy(F.desc(count_name), name).limit(k)
    return out


def rollup_labels(df: DataFrame, a: str, b: str, default_b: str = "Unknown") -> DataFrame:
    """Parent totals and (parent, child) counts; empty child list -> default."""
    bb = F.when(F.size(b) == 0, F.array(F.lit(default_b))).otherwise(F.col(b))
    ex = df.select(F.explode_outer(a).alias("parent"), bb.alias("_b")).filter(F.col("parent").isNotNull()) \
           .select("parent", F.explode_outer("_b").alias("child")).filter(F.col("child").isNotNull())
    return ex.rollup("parent", "child").agg(F.grouping_id().cast("int").alias("level"),
                                            F.count(F.lit(1)).alias("n")) \
             .filter(F.col("level") < 3)


def cooccurrence(df: DataFrame, a: str, b: str, k: int | None = None,
                 default_b: str | None = None) -> DataFrame:
    """Bipartite co-occurrence edges (a, b) with weights, top k."""
    bb = F.col(b) if default_b is None else \
        F.when(F.size(b) == 0, F.array(F.lit(default_b))).otherwise(F.col(b))
    ex = df.select(F.explode_outer(a).alias("source"), bb.alias("_b")).filter(F.col("source").isNotNull()) \
           .select("source", F.explode_outer("_b").alias("target")).filter(F.col("target").isNotNull())
    e = ex.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    if k is not None:
        e = e.orderBy(F.desc("weight"), "source", "target").limit(k)
    return e


def flow_edges(df: DataFrame, origins: str, place: str, topics: str, k: int | None = 40,
               default_place: str = "Unknown") -> DataFrame:
    """Origins -> places -> first two topics; each stage its own top k.
    Stage 2 counts once per (origin, place, topic) of a row."""
    pl = F.when(F.size(place) == 0, F.array(F.lit(default_place))).otherwise(F.col(place))
    rows = df.select(F.explode(origins).alias("o"), pl.alias("p"), F.slice(topics, 1, 2).alias("t"))
    s1 = rows.select(F.col("o").alias("source"), F.explode("p").alias("target")) \
             .groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    s2 = rows.select(F.explode("p").alias("source"), "t").select("source", F.explode("t").alias("target")) \
             .groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))

    def top(e, stage):
        if k is not None:
            e = e.orderBy(F.desc("weight"), "source", "target").limit(k)
        return e.withColumn("stage", F.lit(stage))
    return top(s1, 1).unionByName(top(s2, 2))


def term_freq(df: DataFrame, toks: Column, k: int) -> DataFrame:
    """Corpus term frequency, top k (ties by word)."""
    w = df.select(F.explode(toks).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def top_words(df: DataFrame, toks: Column, k: int) -> DataFrame:
    """The k most frequent words as one row: array ``words``, most frequent first."""
    top = term_freq(df, toks, k).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("w"))
    return top.select(F.transform("w", lambda x: x["word"]).alias("words"))


def keyword_trend(df: DataFrame, text: Column, day: str, words: DataFrame, days: int | None = None,
                  as_of: Column | None = None) -> DataFrame:
    """Documents per (month, word) whose text contains the word (substring).

    ``words`` is one row with the array ``words``. ``days`` keeps the last
    days before ``as_of``, or every day if none lies there.
    """
    rows = df.filter(F.col(day).isNotNull())
    if days is not None:
        recent = F.col(day) >= F.date_sub(as_of, days)
        some = rows.agg(F.coalesce(F.bool_or(recent), F.lit(False)).alias("_some"))
        rows = rows.crossJoin(F.broadcast(some)).filter(~F.col("_some") | recent)  # one row
    hits = F.get(F.transform(F.array(text), lambda t: F.filter("words", lambda w: t.contains(w))), 0)
    ex = rows.crossJoin(F.broadcast(words)).select(
        F.date_format(day, "yyyy-MM").alias("month"), F.explode(hits).alias("keyword"))
    return ex.groupBy("month", "keyword").agg(F.count(F.lit(1)).alias("mentions"))


def trend_insight(trend: DataFrame, words: DataFrame, n_rising: int = 4) -> DataFrame:
    """Over all keywords the peak month (the earliest of equals), the
    number of months and the mean per month; the dominant keyword (the first
    by name of equals) and its total; the rising keywords: more than half of
    their mentions in the last two months of the series, in the order of
    ``words``, if the series has two months or more."""
    months = trend.groupBy("month").agg(F.sum("mentions").alias("n"))
    whole = months.agg(F.min_by("month", F.struct((-F.col("n")).alias("n"), "month")).alias("peak_month"),
                       F.count(F.lit(1)).alias("active_months"), F.sum("n").alias("total"),
                       F.slice(F.sort_array(F.collect_list("month"), False), 1, 2).alias("last2"))
    per = trend.crossJoin(F.broadcast(whole.select("last2"))).groupBy("keyword").agg(
        F.sum("mentions").alias("total"),
        F.sum(F.when(F.array_contains("last2", F.col("month")), F.col("mentions")).otherwise(0)).alias("recent"))
    top = per.agg(F.min_by("keyword", F.struct((-F.col("total")).alias("n"), "keyword")).alias("dominant"),
                  F.max("total").alias("dominant_total"),
                  F.collect_list(F.when(F.col("recent") / F.col("total") > 0.5, F.col("keyword"))).alias("up"))
    out = whole.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(words)).filter("active_months > 0")
    rising = F.slice(F.filter("words", lambda w: F.array_contains("up", w)), 1, n_rising)
    mean = F.floor(F.col("total") / F.col("active_months") * 10.0 + 0.5) / 10.0
    return out.select("dominant", "dominant_total", "peak_month", "active_months", mean.alias("mean_per_month"),
                      F.when((F.col("active_months") >= 2) & (F.size(rising) > 0), F.array_join(rising, "|")).alias("rising"))


def top_words_per_row(df: DataFrame, keys: list[str], toks: Column, n: int) -> DataFrame:
    """The n most frequent words of each row's text; ties by first
    appearance. One group per row key (bounded by that text's length)."""
    ex = df.select(*keys, F.posexplode(toks).alias("pos", "word"))
    c = ex.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    top = c.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= n)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rk", "word"))).alias("_w")) \
              .select(*keys, F.transform("_w", lambda x: x["word"]).alias("top_words"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair of observed labels with its count, zero where none (the
    result is the product of both label sets; the planner picks the smaller
    one to broadcast, if it is small). The counts are stored: both label sets
    and the cells come from them, and ``df`` is worked out once."""
    n = stored_once(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), "crosstab")
    grid = n.select(a).distinct().crossJoin(n.select(b).distinct())
    return grid.join(n, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def crosstab_wide(df: DataFrame, a: str, b: str, columns: list) -> DataFrame:
    """One row per ``a``, one zero-filled column per given value of ``b``."""
    return df.groupBy(a).pivot(b, columns).agg(F.count(F.lit(1))).na.fill(0)


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def seasonality(df: DataFrame, labels: str, day: str, k: int | None = 15) -> DataFrame:
    """Label x calendar month counts in calendar order, zero-filled, of
    the k labels most frequent over all rows (with or without a date)."""
    ex = df.select(F.explode(labels).alias("label"), F.month(day).alias("_m"))
    cells = [F.count_if(F.col("_m") == i + 1).alias(name) for i, name in enumerate(MONTHS)]
    out = ex.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("_m").alias("_dated"), *cells)
    if k is not None:
        out = out.orderBy(F.desc("n"), "label").limit(k)
    return out.filter("_dated > 0").select("label", *MONTHS)
