"""Registered queries: joins, counts, top-k, set operations, windows, filters
over the document model and the star schema (J*, A1-A8, T*, U*, W*, F*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..bindings import notes_view, read, trends_view
from ..functions.text import clean_url, content_hash, html_title
from ..operators import distinct as DS
from ..operators import ranks as RK
from ..operators import relational as RL
from ..operators import search as SE
from ..operators import tagging
from ..session import ensure_checkpoint_dir
from . import sqlviews as V
from .model import model
from .registry import register

DOCS = V.with_(V.D_DOCS, V.DN_DOCS, V.S_SRC)
SCORED = V.with_(*V.SCORED_CHAIN)


# ------------------------------------------------------------ overview --
@register("overview_kpis", SCORED + f"""
SELECT (SELECT count(*) FROM d_docs) AS total_docs,
       (SELECT count(*) FROM d_docs WHERE scraped_at >= {V.AS_OF} - INTERVAL 7 DAY) AS new_docs_week,
       (SELECT count(*) FROM scored) AS total_signals,
       (SELECT count(*) FROM scored WHERE strategic_score >= 7.0) AS high_signals""")
def overview_kpis(spark, sf_dir):
    """A1: one pass per table, one row of KPIs."""
    m = model(spark, sf_dir)
    docs = RL.kpi_counts(m.D, {
        "total_docs": F.lit(True),
        "new_docs_week": F.col("scraped_at") >= F.to_timestamp(F.lit(m.as_of)) - F.expr("INTERVAL 7 DAYS")})
    sig = RL.kpi_counts(m.scored, {"total_signals": F.lit(True),
                                   "high_signals": F.col("strategic_score") >= 7.0})
    return docs.crossJoin(sig)


@register("docs_by_source", DOCS + """
SELECT s.source_name, count(*) AS n_docs FROM dn_docs d JOIN s_src s USING (source_id)
GROUP BY s.source_name""")
def docs_by_source(spark, sf_dir):
    """A2 + J1."""
    m = model(spark, sf_dir)
    return RL.with_source(m.Dn, m.S, ("source_name",)).groupBy("source_name") \
             .agg(F.count(F.lit(1)).alias("n_docs"))


@register("docs_by_country", DOCS + """
SELECT country, count(*) AS n_docs FROM dn_docs WHERE country IS NOT NULL AND country <> ''
GROUP BY country ORDER BY n_docs DESC, country LIMIT 10""")
def docs_by_country(spark, sf_dir):
    """A3: non-empty countries, top 10."""
    d = model(spark, sf_dir).Dn.filter(F.col("country") != "")
    return RL.value_counts(d, "country", 10, "n_docs")


@register("docs_by_type", DOCS + """
SELECT document_type, count(*) AS n_docs FROM dn_docs WHERE document_type IS NOT NULL GROUP BY 1""")
def docs_by_type(spark, sf_dir):
    """A4: value_counts of document_type."""
    return RL.value_counts(model(spark, sf_dir).Dn, "document_type", None, "n_docs")


@register("distinct_counts", DOCS + """
SELECT count(DISTINCT source_id) AS n_source_id, count(DISTINCT country) AS n_country,
       count(DISTINCT document_type) AS n_document_type, count(DISTINCT language) AS n_language
FROM dn_docs""")
def distinct_counts(spark, sf_dir):
    """A5."""
    return RL.n_unique(model(spark, sf_dir).Dn, ["source_id", "country", "document_type", "language"])


def _period_sql(table: str, day: str) -> str:
    """Every row once for each period it counts in."""
    return " UNION ALL ".join(
        f"SELECT *, '{p}' AS period, {start} AS start FROM {table}" + (f" WHERE {day} IS NOT NULL" if p != "all" else "")
        for p, start in (("day", day), ("week", f"CAST(date_trunc('week', {day}) AS DATE) + 6"),
                         ("month", f"last_day({day})"), ("all", "CAST(NULL AS DATE)")))


def _distinct_in_batches(spark, batches, keys, day, value):
    """Distinct counts from states that the batches were merged into."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/distinct-{uuid.uuid4().hex}"
    states = DS.DistinctStates(spark, path, keys, day)
    for version, rows in enumerate(batches):
        states.add(rows, value, version)
    return states


@register("distinct_sources_by_period", DOCS + f"""
, p AS ({_period_sql('dn_docs', 'publish_date')})
SELECT country, document_type, period, start, count(DISTINCT source_id) AS n_sources
FROM p WHERE source_id IS NOT NULL GROUP BY 1, 2, 3, 4""")
def distinct_sources_by_period(spark, sf_dir):
    """A5: different sources per country and type for days, weeks, months and
    all time, from day states that two batches (older and newer scrapes) fill."""
    m = model(spark, sf_dir)
    d = m.Dn.select("country", "document_type", "publish_date", "source_id",
                    F.coalesce(F.col("scraped_at") < F.to_timestamp(F.lit(m.as_of)) - F.expr("INTERVAL 36 HOURS"), F.lit(False)).alias("old"))
    st = _distinct_in_batches(spark, [d.filter("old"), d.filter("not old")], ["country", "document_type"], "publish_date", "source_id")
    return st.counts(name="n_sources")


@register("distinct_users_by_period", f"""
WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), p AS ({_period_sql('e', 'day')})
SELECT period, start, count(DISTINCT user_id) AS n_users FROM p WHERE user_id IS NOT NULL GROUP BY 1, 2""")
def distinct_users_by_period(spark, sf_dir):
    """A5: different users over all event types per day, week, month and all
    time, from states kept per type and day; one batch per half of the time."""
    e = read(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    late = F.coalesce(F.col("day") >= F.lit("2024-01-16").cast("date"), F.lit(False))
    st = _distinct_in_batches(spark, [e.filter(~late), e.filter(late)], ["event_type"], "day", "user_id")
    return st.counts([], name="n_users")


@register("kind_kpis", DOCS + """
SELECT count(*) FILTER (WHERE document_type = 'journal_article') AS papers,
       count(*) FILTER (WHERE document_type = 'clinical_trial') AS trials,
       count(*) FILTER (WHERE contains(lower(document_type), 'drucksache')) AS parliament_docs,
       count(*) FILTER (WHERE language = 'de') AS german_docs
FROM dn_docs""")
def kind_kpis(spark, sf_dir):
    """Conditional counts in one pass."""
    d = model(spark, sf_dir).Dn
    return RL.kpi_counts(d, {
        "papers": F.col("document_type") == "journal_article",
        "trials": F.col("document_type") == "clinical_trial",
        "parliament_docs": F.lower("document_type").contains("drucksache"),
        "german_docs": F.col("language") == "de"})


@register("type_by_language", DOCS + """
SELECT document_type, language, count(*) AS n_docs FROM dn_docs GROUP BY 1, 2""")
def type_by_language(spark, sf_dir):
    """Two-key counts, observed combinations only."""
    return RL.count_by(model(spark, sf_dir).Dn, "document_type", "language", "n_docs")


@register("weekly_by_type", DOCS + """
SELECT CAST(date_trunc('week', publish_date) + INTERVAL 6 DAY AS DATE) AS week,
       document_type, count(*) AS n_docs
FROM dn_docs WHERE publish_date IS NOT NULL GROUP BY 1, 2""")
def weekly_by_type(spark, sf_dir):
    """A7 + P18: week ending Sunday x type."""
    d = model(spark, sf_dir).Dn.filter(F.col("publish_date").isNotNull())
    return d.groupBy(RL.bucket(F.col("publish_date"), "week").alias("week"), "document_type") \
            .agg(F.count(F.lit(1)).alias("n_docs"))


@register("monthly_docs_filled", DOCS + """
, m AS (SELECT last_day(publish_date) AS bucket, count(*) AS n FROM dn_docs
        WHERE publish_date IS NOT NULL GROUP BY 1),
cal AS (SELECT last_day(CAST(g AS DATE)) AS bucket
        FROM (SELECT min(bucket) lo, max(bucket) hi FROM m),
             generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH) t(g))
SELECT cal.bucket, coalesce(m.n, 0) AS n FROM cal LEFT JOIN m USING (bucket)""")
def monthly_docs_filled(spark, sf_dir):
    """Monthly counts, zero-filled calendar."""
    d = model(spark, sf_dir).Dn.filter(F.col("publish_date").isNotNull())
    counts = d.groupBy(RL.bucket(F.col("publish_date"), "month").alias("bucket")) \
              .agg(F.count(F.lit(1)).alias("n"))
    b = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    cal = b.select(F.explode(F.sequence(F.trunc("lo", "month"), "hi", F.expr("interval 1 month"))).alias("m")) \
           .select(F.last_day("m").alias("bucket"))
    return cal.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@register("daily_events_filled", """
WITH c AS (SELECT CAST(ts AS DATE) AS bucket, count(*) AS n FROM events GROUP BY 1),
cal AS (SELECT CAST(g AS DATE) AS bucket FROM (SELECT min(bucket) lo, max(bucket) hi FROM c),
        generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) t(g))
SELECT cal.bucket, coalesce(c.n, 0) AS n FROM cal LEFT JOIN c USING (bucket)""")
def daily_events_filled(spark, sf_dir):
    """Daily event counts, zero-filled."""
    return RL.count_by_time_filled(read(spark, sf_dir, "events"), "ts", "day")


# ------------------------------------------------------------ top-k --
@register("newest_regulatory", V.with_(*V.SCORED_CHAIN, V.DN_DOCS) + """
SELECT d.document_id, d.title, d.publish_date FROM dn_docs d JOIN f_flags f USING (document_id)
WHERE f.is_regulatory ORDER BY d.publish_date DESC NULLS FIRST, d.document_id LIMIT 50""")
def newest_regulatory(spark, sf_dir):
    """T1 + J2: 50 newest regulatory documents (NULL dates first)."""
    m = model(spark, sf_dir)
    d = tagging.with_source_type(tagging.with_hits(m.Dn, m.K), m.S)
    flags = tagging.merged_flags(tagging.match_flags(), tagging.type_flags())
    d = d.select("document_id", "title", "publish_date", *flags).filter("is_regulatory")
    return RL.newest(d, 50).select("document_id", "title", "publish_date")


@register("sources_ranked", DOCS + """
SELECT source_name, trust_level FROM s_src ORDER BY trust_level DESC NULLS FIRST, source_name LIMIT 10""")
def sources_ranked(spark, sf_dir):
    """Ranked listing."""
    s = model(spark, sf_dir).S
    return RL.top_k(s, [F.col("trust_level").desc_nulls_first(), F.col("source_name")], 10) \
             .select("source_name", "trust_level")


@register("top_nations_revenue", """
SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name ORDER BY sum(l.l_extendedprice * (1 - l.l_discount)) DESC, n.n_name LIMIT 10""")
def top_nations_revenue(spark, sf_dir):
    """T4: top-k of an aggregate over the star schema."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey) \
          .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    agg = j.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    return RL.top_k(agg, [F.desc("rev"), F.col("n_name")], 10) \
             .select("n_name", F.round("rev", 2).alias("revenue"))


@register("facet_languages", DOCS + """
SELECT DISTINCT language FROM dn_docs WHERE language IS NOT NULL AND language <> ''""")
def facet_languages(spark, sf_dir):
    """T5: distinct facet values."""
    return RL.facet_values(model(spark, sf_dir).Dn, "language")


# ------------------------------------------------------------ set ops --
@register("union_feeds", DOCS + """
SELECT document_id, title, language, NULL::VARCHAR AS country FROM dn_docs WHERE language = 'de'
UNION ALL
SELECT document_id, title, NULL::VARCHAR AS language, country FROM dn_docs WHERE language = 'fr'""")
def union_feeds(spark, sf_dir):
    """Union by name with missing columns as NULL."""
    d = model(spark, sf_dir).Dn
    a = d.filter(F.col("language") == "de").select("document_id", "title", "language")
    b = d.filter(F.col("language") == "fr").select("document_id", "title", "country")
    return RL.union_all(a, b)


@register("pages_first_wins", r"""
WITH u AS (
  SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS clean, 0 AS prio FROM pages WHERE url LIKE 'https%'
  UNION ALL
  SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS clean, 1 AS prio FROM pages)
SELECT arg_min(page_id, (prio, page_id)) AS page_id, clean AS clean_url FROM u GROUP BY clean""")
def pages_first_wins(spark, sf_dir):
    """Two feeds (secure pages first, then all pages) concatenated with
    first-wins dedup on the URL without its query string."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", clean_url("url").alias("clean_url"))
    secure = p.filter(F.col("url").startswith("https"))
    return RL.union_distinct([secure, p], ["clean_url"], ["page_id"]).select("page_id", "clean_url")


# ------------------------------------------------------------ windows --
@register("latest_note_per_document", """
SELECT conv_id AS document_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS author,
       arg_max(length(text), turn) AS note_len
FROM conversations GROUP BY conv_id""")
def latest_note_per_document(spark, sf_dir):
    """Newest note per document (aggregate form, hot-key safe)."""
    n = notes_view(spark, sf_dir).select("document_id", "turn", "author",
                                         F.length("note_text").cast("bigint").alias("note_len"))
    return RL.latest_per(n, ["document_id"], "turn")


@register("rising_top5", """
SELECT keyword, geography, date, interest_score, related_topic FROM (
  SELECT event_type AS keyword, 'G' || CAST(user_id % 31 AS VARCHAR) AS geography, CAST(ts AS DATE) AS date,
         value AS interest_score, 'k' || json_extract_string(props, '$.k') AS related_topic,
         row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn
  FROM events WHERE event_id % 11 = 0) WHERE rn <= 5""")
def rising_top5(spark, sf_dir):
    """Top 5 rising topics per keyword."""
    t = trends_view(spark, sf_dir).filter("is_rising")
    top = RL.top_n_per(t, ["keyword"], [F.desc("interest_score"), F.col("event_id")], 5)
    return top.select("keyword", "geography", "date", "interest_score", "related_topic")


@register("cumulative_daily_events", """
SELECT day, n, sum(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS cumulative
FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""")
def cumulative_daily_events(spark, sf_dir):
    """Running total by day after daily aggregation (tiny single partition)."""
    e = read(spark, sf_dir, "events")
    daily = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return RL.cumulative(daily, "day", "n")


@register("docs_page_2", DOCS + """
SELECT document_id, title FROM dn_docs ORDER BY document_id LIMIT 12 OFFSET 24""")
def docs_page_2(spark, sf_dir):
    """The third page of 12 by id; ids come first, so only 36 are sorted."""
    d = model(spark, sf_dir).Dn.select("document_id", "title")
    return d.orderBy("document_id").offset(24).limit(12)


@register("docs_pages", DOCS + """
, p AS (SELECT document_id, row_number() OVER (ORDER BY publish_date DESC NULLS FIRST, title, document_id) - 1 AS k FROM dn_docs)
SELECT document_id, k // 12 + 1 AS page, k % 12 + 1 AS place FROM p""")
def docs_pages(spark, sf_dir):
    """The page and place of every document, newest first, then by title."""
    d = model(spark, sf_dir).Dn.select("document_id", "publish_date", "title")
    order = [F.col("publish_date").desc_nulls_first(), F.col("title"), F.col("document_id")]
    return RK.pages(d, order, 12).select("document_id", "page", "place")


@register("max_scaled_edges", """
WITH e AS (SELECT 'C' || CAST(user_id % 60 AS VARCHAR) AS origin, event_type AS target, count(*) AS w
           FROM events GROUP BY 1, 2)
SELECT origin, target, w, round(w / max(w) OVER (), 4) AS share FROM e""")
def max_scaled_edges(spark, sf_dir):
    """Global max for scaling, as one broadcast aggregate row."""
    e = read(spark, sf_dir, "events")
    edges = e.groupBy(F.concat(F.lit("C"), (F.col("user_id") % 60).cast("string")).alias("origin"),
                      F.col("event_type").alias("target")).agg(F.count(F.lit(1)).alias("w"))
    mx = edges.agg(F.max("w").alias("mx"))
    return edges.crossJoin(F.broadcast(mx)).select(
        "origin", "target", "w", F.round(F.col("w") / F.col("mx"), 4).alias("share"))


# ------------------------------------------------------------ filters --
@register("recent_docs_week", DOCS + f"""
SELECT count(*) AS n_docs FROM dn_docs WHERE scraped_at >= {V.AS_OF} - INTERVAL 2 DAY""")
def recent_docs_week(spark, sf_dir):
    """F7."""
    m = model(spark, sf_dir)
    return RL.recent(m.Dn, "scraped_at", m.as_of, days=2).agg(F.count(F.lit(1)).alias("n_docs"))


@register("recent_or_all_730", DOCS + f"""
, w AS (SELECT *, CAST(publish_date AS TIMESTAMP) AS pts FROM dn_docs),
a AS (SELECT * FROM w WHERE pts >= {V.AS_OF} - INTERVAL 200 DAY)
SELECT 'some recent' AS kind, count(*) AS n_docs FROM a
UNION ALL SELECT 'none recent', count(*) FROM w
WHERE NOT EXISTS (SELECT 1 FROM w WHERE pts >= TIMESTAMP '2030-01-01 00:00:00' - INTERVAL 730 DAY)""")
def recent_or_all_730(spark, sf_dir):
    """F7 with the fall-back to all rows when nothing is recent: once with
    recent rows, once (as of 2030) without."""
    m = model(spark, sf_dir)
    d = m.Dn.withColumn("pts", F.col("publish_date").cast("timestamp"))

    def n(kind, as_of, days):
        rows = RL.recent_or_all(d, "pts", as_of, days)
        return rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_docs"))
    return n("some recent", m.as_of, 200).unionByName(n("none recent", "2030-01-01 00:00:00", 730))


@register("facet_filtered", DOCS + """
SELECT document_id, country, document_type FROM dn_docs
WHERE publish_date BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'
  AND country IN ('Germany', 'USA') AND document_type IN ('news', 'clinical_trial')""")
def facet_filtered(spark, sf_dir):
    """F8: date BETWEEN + IN facets; empty selections are no-ops."""
    d = model(spark, sf_dir).Dn
    return RL.facet(d, date_between=("publish_date", "2024-03-01", "2024-06-30"),
                    country=["Germany", "USA"], document_type=["news", "clinical_trial"],
                    language=[]).select("document_id", "country", "document_type")


@register("regex_search", DOCS + r"""
SELECT document_id FROM dn_docs WHERE regexp_matches(full_text, 'keit[a-z]+ und')""")
def regex_search(spark, sf_dir):
    """regex search (pandas str.contains default)."""
    d = model(spark, sf_dir).Dn
    return d.filter(RL.search("full_text", "keit[a-z]+ und")).select("document_id")


@register("search_phrases", r"""
WITH q AS (SELECT item_id, array_to_string(list_slice(string_split_regex(trim(text), '\s+'), 2, 5), ' ') AS pattern FROM benchmark)
SELECT item_id, doc_id AS document_id FROM documents JOIN q ON contains(documents.text, q.pattern)""")
def search_phrases(spark, sf_dir):
    """a phrase of every benchmark item (its second to fifth word), looked
    up in all documents by one index."""
    words = F.split(F.trim("text"), r"\s+")
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(words, 2, 4), " ").alias("pattern"))
    found = SE.search_all(read(spark, sf_dir, "documents"), q, "doc_id", "text", regex=False)
    return found.select(F.col("query").alias("item_id"), F.col("doc_id").alias("document_id"))


@register("search_patterns", r"""
WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
q AS (SELECT item_id, w[2] || '\s+' || w[3] || '[a-z]*|' || w[5] || 's? ' || w[6] || '\s' AS pattern FROM w)
SELECT item_id, doc_id AS document_id FROM documents JOIN q ON regexp_matches(documents.text, q.pattern)""")
def search_patterns(spark, sf_dir):
    """a regular expression of every benchmark item (two pairs of its
    words, either of which may occur), tried on all documents by one index."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)
    w = [F.get(words, i) for i in (1, 2, 4, 5)]
    pattern = F.concat(w[0], F.lit(r"\s+"), w[1], F.lit("[a-z]*|"), w[2], F.lit("s? "), w[3], F.lit(r"\s"))
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), pattern.alias("pattern"))
    found = SE.search_all(read(spark, sf_dir, "documents"), q, "doc_id", "text")
    return found.select(F.col("query").alias("item_id"), F.col("doc_id").alias("document_id"))


@register("pages_with_title", r"""
SELECT page_id FROM pages
WHERE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> ''""")
def pages_with_title(spark, sf_dir):
    """required fields non-empty."""
    p = read(spark, sf_dir, "pages").withColumn("title", html_title("html"))
    return p.filter(RL.require(["title"])).select("page_id")


@register("events_enum", """
SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1""")
def events_enum(spark, sf_dir):
    """enum membership."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("high_signal_count", SCORED + """
SELECT count(*) FILTER (WHERE strategic_score >= 5.0) AS ge5, count(*) FILTER (WHERE strategic_score >= 6.0) AS ge6,
       count(*) FILTER (WHERE strategic_score >= 7.0) AS ge7, count(*) FILTER (WHERE strategic_score >= 8.0) AS ge8
FROM scored""")
def high_signal_count(spark, sf_dir):
    """threshold filters."""
    sc = model(spark, sf_dir).scored
    return RL.kpi_counts(sc, {f"ge{t}": F.col("strategic_score") >= float(t) for t in (5, 6, 7, 8)})


@register("scientific_docs", SCORED + """
SELECT count(*) AS n_docs FROM f_flags WHERE is_scientific""")
def scientific_docs(spark, sf_dir):
    """flag equality."""
    m = model(spark, sf_dir)
    return tagging.flags_from_type(m.D, m.S).filter("is_scientific").agg(F.count(F.lit(1)).alias("n_docs"))


# ------------------------------------------------------------ joins --
@register("labels_by_source", DOCS + """
SELECT s.source_name, count(*) AS n_labeled, CAST(sum(l.quality) AS BIGINT) AS n_quality,
       CAST(sum(l.toxic) AS BIGINT) AS n_toxic
FROM labels l JOIN dn_docs d ON d.document_id = l.doc_id JOIN s_src s USING (source_id)
GROUP BY s.source_name""")
def labels_by_source(spark, sf_dir):
    """Child rows (labels) joined to their documents and sources."""
    m = model(spark, sf_dir)
    lab = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    j = RL.with_source(lab.join(m.Dn.select("document_id", "source_id"), "document_id"), m.S, ("source_name",))
    return j.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_labeled"),
                                        F.sum("quality").cast("bigint").alias("n_quality"),
                                        F.sum("toxic").cast("bigint").alias("n_toxic"))


@register("docs_label_status", DOCS + """
SELECT CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS status,
       count(*) AS n_docs
FROM dn_docs d LEFT JOIN labels l ON l.doc_id = d.document_id GROUP BY 1""")
def docs_label_status(spark, sf_dir):
    """Left outer join with a default for missing rows."""
    m = model(spark, sf_dir)
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    j = m.Dn.select("document_id").join(lab, "document_id", "left")
    st = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "good").otherwise("poor")
    return j.groupBy(st.alias("status")).agg(F.count(F.lit(1)).alias("n_docs"))


@register("new_unlabeled_docs", DOCS + """
, h AS (SELECT document_id, sha256(coalesce(title, 'None') || coalesce(language, 'None') || coalesce(full_text, 'None')) AS content_hash FROM dn_docs),
first AS (SELECT content_hash, min(document_id) AS document_id FROM h GROUP BY content_hash),
seen AS (SELECT DISTINCT h.content_hash FROM h JOIN labels l ON l.doc_id = h.document_id)
SELECT document_id, content_hash FROM first WHERE content_hash NOT IN (SELECT content_hash FROM seen)""")
def new_unlabeled_docs(spark, sf_dir):
    """J8 + P6: dedup by content hash inside the batch (first document wins),
    then drop hashes already stored (here: documents that carry labels)."""
    m = model(spark, sf_dir)
    h = m.Dn.select("document_id", content_hash("title", "language", "full_text").alias("content_hash"))
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    seen = h.join(lab, "document_id", "left_semi").select("content_hash")
    return RL.new_only(h, seen, ["content_hash"], ["document_id"]).select("document_id", "content_hash")


@register("keyword_geo_pairs", """
SELECT k.keyword, g.geography FROM (SELECT DISTINCT event_type AS keyword FROM events) k
CROSS JOIN (SELECT DISTINCT 'G' || CAST(user_id % 31 AS VARCHAR) AS geography FROM events) g""")
def keyword_geo_pairs(spark, sf_dir):
    """Keywords x geographies (both bounded dictionaries)."""
    t = trends_view(spark, sf_dir)
    kw = t.select("keyword").distinct()
    geo = t.select("geography").distinct()
    return RL.cross_small(kw, geo)


@register("notes_newest", """
SELECT n.conv_id AS document_id, n.turn, d.source, length(n.text) AS note_len
FROM conversations n JOIN documents d ON d.doc_id = n.conv_id
ORDER BY n.turn DESC, n.conv_id LIMIT 50""")
def notes_newest(spark, sf_dir):
    """Notes joined with documents, newest first."""
    n = notes_view(spark, sf_dir).select("document_id", "turn", F.length("note_text").cast("bigint").alias("note_len"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source")
    j = n.join(d, "document_id")
    return RL.top_k(j, [F.desc("turn"), F.col("document_id")], 50) \
             .select("document_id", "turn", "source", "note_len")


COORDS = [("Germany", 51.2, 10.4), ("USA", 39.8, -98.6), ("China", 35.9, 104.2),
          ("UK", 55.4, -3.4), ("Italy", 41.9, 12.6), ("India", 20.6, 79.0), ("Kenya", -0.0236, 37.9)]


@register("docs_geo", DOCS + """
, coords AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {a}, {b})" for c, a, b in COORDS) + """) t(country, lat, lon))
SELECT country, lat, lon, count(*) AS n_docs FROM dn_docs JOIN coords USING (country)
GROUP BY country, lat, lon""")
def docs_geo(spark, sf_dir):
    """Inner coordinate lookup; unmatched (EU, NULL) dropped."""
    d = model(spark, sf_dir).Dn
    coords = spark.createDataFrame(COORDS, "country string, lat double, lon double")
    return RL.geo_enrich(d.select("country"), coords, "country") \
             .groupBy("country", "lat", "lon").agg(F.count(F.lit(1)).alias("n_docs"))


# ------------------------------------------------ star-schema rollups --
@register("revenue_rollup_region_nation", """
SELECT r.r_name AS region, n.n_name AS nation, CAST(grouping(r.r_name, n.n_name) AS INTEGER) AS level,
       round(sum(o.o_totalprice), 2) AS revenue, count(*) AS n_orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY ROLLUP (r.r_name, n.n_name)""")
def revenue_rollup_region_nation(spark, sf_dir):
    """A15 on the star schema: hierarchical totals with rollup + grouping id."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    j = o.join(c, o.o_custkey == c.c_custkey) \
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey) \
         .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(
        F.grouping_id().cast("int").alias("level"),
        F.round(F.sum("o_totalprice"), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n_orders"))


@register("returnflag_pivot", """
SELECT l_returnflag,
       round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS qty_F,
       round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS qty_O
FROM lineitem GROUP BY l_returnflag""")
def returnflag_pivot(spark, sf_dir):
    """A11-style pivot with an explicit value list."""
    li = read(spark, sf_dir, "lineitem")
    p = li.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", F.round("F", 2).alias("qty_F"), F.round("O", 2).alias("qty_O"))


@register("monthly_revenue_running", """
SELECT month, round(revenue, 2) AS revenue,
       round(sum(revenue) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS running
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)""")
def monthly_revenue_running(spark, sf_dir):
    """W1 on the star schema: monthly totals, then a running sum."""
    o = read(spark, sf_dir, "orders")
    m = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("rev"))
    c = RL.cumulative(m, "month", "rev", "run")
    return c.select("month", F.round("rev", 2).alias("revenue"), F.round("run", 2).alias("running"))


# Fixed-label defaults used by the pages


# ------------------------------------------------ text filters, J4, A29 --
FILTER_TERMS = ["keit", "license", "token"]
GROUPS = [["that", "with"], ["tion", "ment"]]
SOURCE_FILTERS = {"src1": ["keit"], "src2": ["pour", "que "]}


def _fsql(t, terms):
    return "(" + " OR ".join(f"contains({t}, '{x}')" for x in terms) + ")"


@register("text_filters", DOCS + f"""
SELECT count(*) FILTER (WHERE {_fsql('lower(full_text)', FILTER_TERMS)}) AS n_any,
       count(*) FILTER (WHERE {_fsql('lower(full_text)', GROUPS[0])} AND {_fsql('lower(full_text)', GROUPS[1])}) AS n_all_groups,
       count(*) FILTER (WHERE CASE source
            {' '.join(f"WHEN '{s}' THEN {_fsql('lower(full_text)', t)}" for s, t in SOURCE_FILTERS.items())}
            ELSE TRUE END) AS n_source_switch
FROM dn_docs""")
def text_filters(spark, sf_dir):
    """F1 contains-any, F2 all groups, F3 per-source filter switch (sources
    without a list keep every row)."""
    from ..functions.text import contains_all_groups, contains_any
    j = model(spark, sf_dir).Dn
    sw = None
    for s, terms in SOURCE_FILTERS.items():
        c = contains_any("full_text", terms)
        sw = F.when(F.col("source") == s, c) if sw is None else sw.when(F.col("source") == s, c)
    sw = sw.otherwise(F.lit(True))
    return j.agg(F.count_if(contains_any("full_text", FILTER_TERMS)).alias("n_any"),
                 F.count_if(contains_all_groups("full_text", GROUPS)).alias("n_all_groups"),
                 F.count_if(sw).alias("n_source_switch"))


@register("neuro_signals", SCORED + """
SELECT document_id, keyword_id, keyword, source_name, coalesce(NULL, cluster) AS disease,
       floor(strategic_score * 10000.0 + 0.5) / 10000.0 AS strategic_score
FROM scored JOIN k_lex USING (keyword_id, keyword, level)
WHERE is_neuro ORDER BY strategic_score DESC, document_id, keyword_id LIMIT 100""")
def neuro_signals(spark, sf_dir):
    """J4 + P17: signals of neuro-flagged documents with document, source and
    keyword; disease area falls back to the keyword cluster; top 100."""
    from ..functions.numeric import rnd
    m = model(spark, sf_dir)
    k = m.K.select("keyword_id", F.coalesce("disease_area", "cluster").alias("disease"))
    j = m.scored.filter("is_neuro").join(F.broadcast(k), "keyword_id")
    top = RL.top_k(j, [F.desc("strategic_score"), F.col("document_id"), F.col("keyword_id")], 100)
    return top.select("document_id", "keyword_id", "keyword", "source_name", "disease",
                      rnd("strategic_score").alias("strategic_score"))


@register("run_totals", """
WITH h AS (SELECT source, doc_id, sha256(coalesce(text, 'None')) AS hsh FROM documents),
firsts AS (SELECT hsh, min(doc_id) AS doc_id FROM h GROUP BY hsh)
SELECT count(*) AS total_fetched, (SELECT count(*) FROM firsts) AS total_new,
       count(DISTINCT source) AS n_sources FROM documents""")
def run_totals(spark, sf_dir):
    """Totals over the per-source run stats (K8)."""
    from .. import sinks as K
    d = read(spark, sf_dir, "documents")
    h = d.select("source", "doc_id", content_hash("text").alias("hsh"))
    st = K.run_stats(h, "source", F.lit(True), "hsh", "doc_id")
    return st.agg(F.sum("fetched").alias("total_fetched"), F.sum("new").alias("total_new"),
                  F.count(F.lit(1)).alias("n_sources"))
