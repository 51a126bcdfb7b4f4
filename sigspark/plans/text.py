"""Registered queries: dictionary classification, entities, label and term
statistics, HTML extraction and scalar text functions (M15-M18, A13-A17,
A22-A28, P2-P25, S2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..bindings import notes_view, read
from ..functions import text as T
from ..functions.dates import to_date_safe
from ..functions.numeric import rnd, rnd_sql
from ..operators import classify as C
from ..operators import heavy as HV
from ..operators import textstats as TS
from ..operators.scoring import weighted_relevance
from ..session import spread, stored_once
from . import sqlviews as V
from .model import model
from .registry import register

q = V.q


# ----------------------------------------------------------- SQL helpers --
def _any(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(x)})" for x in terms) + ")"


def topics_sql(t: str, rules=L.TEST_TOPICS, default=L.TEST_TOPIC_DEFAULT) -> str:
    arr = "list_filter([" + ", ".join(f"CASE WHEN {_any(t, terms)} THEN {q(lab)} END"
                                      for lab, terms in rules) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({arr}) = 0 THEN [{q(default)}] ELSE {arr} END"


def entities_sql(t: str, mapping=L.TEST_ENTITIES) -> str:
    items = [(k, v) for k, v in mapping.items() if not v.endswith("(region)")]
    arr = "[" + ", ".join(f"CASE WHEN contains({t}, {q(k)}) THEN {q(v)} END" for k, v in items) + "]"
    return f"list_sort(list_distinct(list_filter({arr}, lambda x: x IS NOT NULL)))"


def first_rule_sql(t: str, rules, default) -> str:
    return "CASE " + " ".join(f"WHEN {_any(t, terms)} THEN {q(lab)}" for lab, terms in rules) \
        + f" ELSE {q(default)} END"


def groups_sql(arr: str, groups=L.TEST_ENTITY_GROUPS, default="Other") -> str:
    m = " ".join(f"WHEN x = {q(k)} THEN {q(v)}" for k, v in groups.items())
    return f"list_sort(list_distinct(list_transform({arr}, lambda x: CASE {m} ELSE {q(default)} END)))"


STOP_SQL = "[" + ", ".join(q(w) for w in L.STOP_WORDS) + "]"
TOKENS_SQL = ("list_filter(regexp_extract_all(lower({t}), '[a-z]{{3,}}'), "
              "lambda w: NOT list_contains(" + STOP_SQL + ", w))")

CLS = V.with_(V.D_DOCS, V.DN_DOCS) + ", cls AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(full_text, '')) AS t FROM dn_docs)"
CLS_T = CLS + f""",
cls2 AS (SELECT document_id, language, publish_date, t, {topics_sql('t')} AS topics,
                {entities_sql('t')} AS entities FROM cls)
"""


# ----------------------------------------------------------- Spark helpers --
def _cls(spark, sf_dir):
    d = spread(model(spark, sf_dir).Dn, "document_id")
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("full_text", F.lit(""))))
    return d.withColumn("t", t)


def _cls2(spark, sf_dir):
    d = _cls(spark, sf_dir)
    return d.select("document_id", "language", "publish_date", "t",
                    C.classify_multi("t", L.TEST_TOPICS, L.TEST_TOPIC_DEFAULT, lower=False).alias("topics"),
                    C.extract_entities("t", L.TEST_ENTITIES, lower=False).alias("entities"))


def _toks(c):
    return T.tokens(c, "[a-z]{3,}", L.STOP_WORDS)


# ------------------------------------------------------- classification --
@register("doc_topics", CLS_T + """
SELECT document_id, array_to_string(topics, '|') AS topics, topics[1] AS primary_topic,
       CAST(greatest(len(topics), 1) AS INTEGER) AS n_topics FROM cls2""")
def doc_topics(spark, sf_dir):
    """M15 + P23: ordered multi-label topics, primary = first."""
    d = _cls2(spark, sf_dir)
    return d.select("document_id", F.array_join("topics", "|").alias("topics"),
                    F.col("topics")[0].alias("primary_topic"),
                    F.greatest(F.size("topics"), F.lit(1)).alias("n_topics"))


@register("doc_threat_type", CLS + f"""
SELECT document_id, {first_rule_sql("lower(substr(title, 1, 90))", L.TEST_THREATS, L.TEST_THREAT_DEFAULT)} AS threat
FROM cls""")
def doc_threat_type(spark, sf_dir):
    """Single-label ordered rules on the title cut to 90 characters."""
    d = _cls(spark, sf_dir)
    return d.select("document_id", C.classify_first("title", L.TEST_THREATS, L.TEST_THREAT_DEFAULT,
                                                    max_chars=90).alias("threat"))


@register("doc_entities", CLS_T + """
SELECT document_id, array_to_string(entities, '|') AS entities FROM cls2""")
def doc_entities(spark, sf_dir):
    """Sorted entity set by dictionary ('(region)' labels excluded)."""
    d = _cls2(spark, sf_dir)
    return d.select("document_id", F.array_join("entities", "|").alias("entities"))


@register("doc_entity_groups", CLS_T + f"""
SELECT document_id, array_to_string({groups_sql('entities')}, '|') AS groups FROM cls2""")
def doc_entity_groups(spark, sf_dir):
    """Entity -> group, distinct groups, default Other."""
    d = _cls2(spark, sf_dir)
    return d.select("document_id", F.array_join(C.group_entities("entities", L.TEST_ENTITY_GROUPS),
                                                "|").alias("groups"))


@register("topic_counts", CLS_T + """
SELECT label, count(*) AS n FROM (SELECT unnest(topics) AS label FROM cls2)
GROUP BY label ORDER BY n DESC, label LIMIT 10""")
def topic_counts(spark, sf_dir):
    """Exploded label counts, top 10."""
    return TS.label_counts(_cls2(spark, sf_dir), "topics", 10)


@register("topic_entity_rollup", CLS_T + """
SELECT parent, child, CAST(grouping(parent, child) AS INTEGER) AS level, count(*) AS n
FROM (SELECT unnest(topics) AS parent, CASE WHEN len(entities) = 0 THEN ['Unknown'] ELSE entities END AS e FROM cls2),
     unnest(e) AS u(child)
GROUP BY ROLLUP (parent, child) HAVING grouping(parent, child) < 3""")
def topic_entity_rollup(spark, sf_dir):
    """Parent totals = sum of children, default child Unknown."""
    return TS.rollup_labels(_cls2(spark, sf_dir), "topics", "entities")


@register("topic_entity_edges", CLS_T + """
SELECT source, target, count(*) AS weight
FROM (SELECT unnest(topics) AS source, entities FROM cls2), unnest(entities) AS u(target)
GROUP BY source, target ORDER BY weight DESC, source, target LIMIT 50""")
def topic_entity_edges(spark, sf_dir):
    """Bipartite co-occurrence edges, top 50."""
    return TS.cooccurrence(_cls2(spark, sf_dir), "topics", "entities", 50)


@register("edge_nodes", CLS_T + """
, e AS (SELECT source, target, count(*) AS weight
        FROM (SELECT unnest(topics) AS source, entities FROM cls2), unnest(entities) AS u(target)
        GROUP BY source, target ORDER BY weight DESC, source, target LIMIT 50),
n AS (SELECT source AS node FROM e UNION SELECT target FROM e)
SELECT node, row_number() OVER (ORDER BY node) - 1 AS node_idx FROM n""")
def edge_nodes(spark, sf_dir):
    """Distinct node set of the edge list with a dense index."""
    from ..operators.relational import nodes
    e = TS.cooccurrence(_cls2(spark, sf_dir), "topics", "entities", 50)
    return nodes(e, "source", "target").withColumn("node_idx", F.col("node_idx").cast("bigint"))


@register("flow_edges", CLS_T + """
, r0 AS (SELECT [language, 'any'] AS os, entities, topics FROM cls2),
r AS (SELECT unnest(os) AS o, CASE WHEN len(entities) = 0 THEN ['Unknown'] ELSE entities END AS p,
               topics[1:2] AS t FROM r0),
s1 AS (SELECT o AS source, pp AS target, count(*) AS weight FROM r, unnest(p) AS u(pp)
       GROUP BY 1, 2 ORDER BY weight DESC, source, target LIMIT 40),
s2 AS (SELECT pp AS source, tt AS target, count(*) AS weight FROM r, unnest(p) AS u(pp), unnest(t) AS v(tt)
       GROUP BY 1, 2 ORDER BY weight DESC, source, target LIMIT 40)
SELECT source, target, weight, 1 AS stage FROM s1 UNION ALL SELECT source, target, weight, 2 FROM s2""")
def flow_edges(spark, sf_dir):
    """Three-level flow (origins -> entities -> first two topics)."""
    d = _cls2(spark, sf_dir).withColumn("origins", F.array("language", F.lit("any")))
    return TS.flow_edges(d, "origins", "entities", "topics", 40)


@register("topic_by_language", CLS_T + """
, x AS (SELECT unnest(topics) AS label, language FROM cls2)
SELECT a.label, b.language, count(x.label) AS n
FROM (SELECT DISTINCT label FROM x) a CROSS JOIN (SELECT DISTINCT language FROM x) b
LEFT JOIN x ON x.label = a.label AND x.language = b.language GROUP BY 1, 2""")
def topic_by_language(spark, sf_dir):
    """Crosstab (long form, zero-filled) of topic x language."""
    d = _cls2(spark, sf_dir).select(F.explode("topics").alias("label"), "language")
    return TS.crosstab(d, "label", "language")


@register("topic_language_wide", CLS_T + """
, x AS (SELECT unnest(topics) AS label, language FROM cls2)
SELECT label, count(*) FILTER (WHERE language = 'de') AS de, count(*) FILTER (WHERE language = 'en') AS en,
       count(*) FILTER (WHERE language = 'es') AS es, count(*) FILTER (WHERE language = 'fr') AS fr
FROM x GROUP BY label""")
def topic_language_wide(spark, sf_dir):
    """Crosstab (wide form) of topic x language."""
    d = _cls2(spark, sf_dir).select(F.explode("topics").alias("label"), "language")
    return TS.crosstab_wide(d, "label", "language", ["de", "en", "es", "fr"])


@register("topic_seasonality", CLS_T + """
, x AS (SELECT unnest(topics) AS label, month(publish_date) AS m FROM cls2),
top AS (SELECT label FROM x GROUP BY label ORDER BY count(*) DESC, label LIMIT 15)
SELECT label, """ + ", ".join(f"count(*) FILTER (WHERE m = {i + 1}) AS {n}" for i, n in enumerate(TS.MONTHS)) + """
FROM x WHERE label IN (SELECT label FROM top) GROUP BY label HAVING count(m) > 0""")
def topic_seasonality(spark, sf_dir):
    """Topic x calendar month, zero-filled, calendar order."""
    return TS.seasonality(_cls2(spark, sf_dir), "topics", "publish_date")


# ------------------------------------------------------- term statistics --
@register("term_freq_top25", V.with_(V.D_DOCS) + f"""
SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS_SQL.format(t='full_text')}) AS word FROM d_docs)
GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def term_freq_top25(spark, sf_dir):
    """A22 + P16: corpus term frequency, stop words removed, top 25."""
    d = spread(model(spark, sf_dir).D, "document_id")
    return TS.term_freq(d, _toks(F.col("full_text")), 25)


@register("term_freq_long", V.with_(V.D_DOCS) + f"""
SELECT word, count(*) AS n
FROM (SELECT unnest(list_filter(regexp_extract_all(lower(full_text), '[a-z]{{4,}}'), lambda w: NOT list_contains({STOP_SQL}, w))) AS word FROM d_docs)
GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def term_freq_long(spark, sf_dir):
    """P16, second pattern: words of four letters or more."""
    d = spread(model(spark, sf_dir).D, "document_id")
    return TS.term_freq(d, T.tokens("full_text", "[a-z]{4,}", L.STOP_WORDS), 25)


@register("tag_freq", CLS_T + """
, packed AS (SELECT CASE WHEN len(topics[1:5]) > 0 THEN '[Tags: ' || array_to_string(topics[1:5], ', ') || '] ' || t
                         ELSE t END AS note FROM cls2),
parsed AS (SELECT regexp_extract(note, '^\\[Tags:\\s*(.+?)\\]', 1) AS raw FROM packed)
SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '')) AS tag
                                FROM parsed WHERE raw <> '')
GROUP BY tag ORDER BY n DESC, tag LIMIT 20""")
def tag_freq(spark, sf_dir):
    """A23 + P15: build '[Tags: a, b] text' notes, parse them back, count tags."""
    d = _cls2(spark, sf_dir)
    packed = d.select(T.join_tags("topics", "t").alias("note"))
    tags, _rest = T.split_tags("note")
    return packed.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")) \
                 .orderBy(F.desc("n"), "tag").limit(20)


@register("country_term_matrix", V.with_(V.D_DOCS, V.DN_DOCS) + f"""
, tk AS (SELECT country, unnest({TOKENS_SQL.format(t='full_text')}) AS word FROM dn_docs WHERE country IS NOT NULL),
c AS (SELECT country, word, count(*) AS n FROM tk GROUP BY 1, 2),
tc AS (SELECT country FROM c GROUP BY country ORDER BY sum(n) DESC, country LIMIT 15),
tw AS (SELECT word FROM c GROUP BY word ORDER BY sum(n) DESC, word LIMIT 15)
SELECT tc.country, tw.word, coalesce(c.n, 0) AS n FROM tc CROSS JOIN tw LEFT JOIN c USING (country, word)""")
def country_term_matrix(spark, sf_dir):
    """Countries with most tokens x most frequent words, zero-filled.
    The counts are stored once; both top lists and the grid read them."""
    d = spread(model(spark, sf_dir).Dn.filter(F.col("country").isNotNull()), "document_id")
    c = d.select("country", F.explode(_toks(F.col("full_text"))).alias("word")) \
         .groupBy("country", "word").agg(F.count(F.lit(1)).alias("n"))
    c = stored_once(c, "country-terms")
    top_w = c.groupBy("word").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "word").limit(15)
    top_c = c.groupBy("country").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "country").limit(15)
    grid = top_c.select("country").crossJoin(F.broadcast(top_w.select("word")))  # 15 x 15
    return grid.join(c, ["country", "word"], "left").select("country", "word", F.coalesce("n", F.lit(0)).alias("n"))


def _top_sql(keys: str) -> str:
    return V.with_(V.D_DOCS) + f""", tk AS (SELECT {keys}, unnest({TOKENS_SQL.format(t='full_text')}) AS word FROM d_docs),
c AS (SELECT {keys}, word, count(*) AS n FROM tk GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, word) AS place FROM c)
SELECT {keys}, place, word, n FROM r WHERE place <= 25"""


def _top_by(spark, sf_dir, keys):
    d = spread(model(spark, sf_dir).D, "document_id")
    top = HV.heavy_hitters(d, keys, _toks(F.col("full_text")), 25).top
    return top.select(*keys, "place", F.col("value").alias("word"), "n")


@register("top_words_by_source", _top_sql("source"))
def top_words_by_source(spark, sf_dir):
    """The 25 most frequent words of every source, by bins."""
    return _top_by(spark, sf_dir, ["source"])


@register("top_words_by_language_type", _top_sql("language, document_type"))
def top_words_by_language_type(spark, sf_dir):
    """The 25 most frequent words of every language and document type."""
    return _top_by(spark, sf_dir, ["language", "document_type"])


@register("source_term_grid", V.with_(V.D_DOCS) + f"""
, tk AS (SELECT source, unnest({TOKENS_SQL.format(t='full_text')}) AS word FROM d_docs WHERE source IS NOT NULL),
c AS (SELECT source, word, count(*) AS n FROM tk GROUP BY 1, 2),
ts AS (SELECT source FROM c GROUP BY source ORDER BY sum(n) DESC, source LIMIT 15),
tw AS (SELECT word FROM c GROUP BY word ORDER BY sum(n) DESC, word LIMIT 40)
SELECT ts.source, tw.word, coalesce(c.n, 0) AS n FROM ts CROSS JOIN tw LEFT JOIN c USING (source, word)""")
def source_term_grid(spark, sf_dir):
    """Sources with most words x most frequent words, by bins."""
    d = spread(model(spark, sf_dir).D, "document_id")
    g = HV.heavy_grid(d, "source", _toks(F.col("full_text")), 15, 40)
    return g.select("source", F.col("value").alias("word"), "n")


TREND_DAYS, TREND_AS_OF = 200, "2024-12-31"


def _trend_sql(days: int | None) -> str:
    cut = f"DATE '{TREND_AS_OF}' - INTERVAL {days} DAY"
    keep = f"AND (d.publish_date >= {cut} OR NOT EXISTS (SELECT 1 FROM d_docs WHERE publish_date >= {cut}))" if days else ""
    return V.with_(V.D_DOCS) + f"""
, tl AS (SELECT document_id, publish_date, lower(coalesce(title, '') || ' ' || coalesce(full_text, '')) AS t FROM d_docs),
tw AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rk
       FROM (SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS_SQL.format(t='t')}) AS word FROM tl) GROUP BY word)
       ORDER BY n DESC, word LIMIT 8),
trend AS (SELECT strftime(d.publish_date, '%Y-%m') AS month, tw.word AS keyword, count(*) AS mentions
          FROM tl d JOIN tw ON contains(d.t, tw.word)
          WHERE d.publish_date IS NOT NULL {keep} GROUP BY 1, 2)
"""


def _trend(spark, sf_dir, days=None):
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("full_text", F.lit(""))))
    d = spread(model(spark, sf_dir).D, "document_id")
    words = stored_once(TS.top_words(d, _toks(text), 8), "top-words")
    as_of = F.lit(TREND_AS_OF).cast("date")
    return TS.keyword_trend(d, text, "publish_date", words, days, as_of), words


@register("keyword_trend", _trend_sql(None) + "SELECT month, keyword, mentions FROM trend")
def keyword_trend(spark, sf_dir):
    """Monthly document mentions (substring) of the top-8 words."""
    return _trend(spark, sf_dir)[0]


@register("keyword_trend_recent", _trend_sql(TREND_DAYS) + "SELECT month, keyword, mentions FROM trend")
def keyword_trend_recent(spark, sf_dir):
    """A25 over the last days, or over all if none lies there."""
    return _trend(spark, sf_dir, TREND_DAYS)[0]


@register("trend_insight", _trend_sql(None) + """
, mo AS (SELECT month, sum(mentions) AS n FROM trend GROUP BY month),
kw AS (SELECT keyword, sum(mentions) AS total,
              sum(CASE WHEN month IN (SELECT month FROM mo ORDER BY month DESC LIMIT 2) THEN mentions ELSE 0 END) AS recent
       FROM trend GROUP BY keyword),
up AS (SELECT kw.keyword, row_number() OVER (ORDER BY tw.rk) AS k FROM kw JOIN tw ON tw.word = kw.keyword
       WHERE recent / total > 0.5 AND (SELECT count(*) FROM mo) >= 2)
SELECT (SELECT keyword FROM kw ORDER BY total DESC, keyword LIMIT 1) AS dominant,
       (SELECT CAST(max(total) AS BIGINT) FROM kw) AS dominant_total,
       (SELECT month FROM mo ORDER BY n DESC, month LIMIT 1) AS peak_month,
       (SELECT count(*) FROM mo) AS active_months,
       (SELECT floor(sum(n) / count(*) * 10.0 + 0.5) / 10.0 FROM mo) AS mean_per_month,
       (SELECT string_agg(keyword, '|' ORDER BY k) FROM up WHERE k <= 4) AS rising
FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM trend)""")
def trend_insight(spark, sf_dir):
    """Trend summary from A25."""
    return TS.trend_insight(*_trend(spark, sf_dir))


@register("note_top_words", """
WITH tk AS (SELECT conv_id, turn, w.word, w.pos
            FROM (SELECT conv_id, turn,
                         unnest(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'),
                                                   lambda x: NOT list_contains(""" + STOP_SQL + """, x)),
                                               lambda x, i: {'word': x, 'pos': i})) AS w
                  FROM conversations)),
c AS (SELECT conv_id, turn, word, count(*) AS n, min(pos) AS first FROM tk GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) AS rk FROM c)
SELECT conv_id AS document_id, turn, array_to_string(list(word ORDER BY rk), ',') AS top_words
FROM r WHERE rk <= 10 GROUP BY conv_id, turn""")
def note_top_words(spark, sf_dir):
    """Top 10 words per note (a turn of a conversation), ties by first appearance."""
    n = notes_view(spark, sf_dir)
    t = TS.top_words_per_row(n, ["document_id", "turn"], _toks(F.col("note_text")), 10)
    return t.select("document_id", "turn", F.array_join("top_words", ",").alias("top_words"))


WEIGHTS = {"keit": 2.0, "that": 1.5, "license": 3.0, "pour": 1.0, "para": 2.5}
TYPE_BONUS = {"Drucksache (Gesetzentwurf)": 3.0, "news": 0.5}


@register("weighted_relevance", V.with_(V.D_DOCS) + """
SELECT document_id, """ + rnd_sql("least(" + " + ".join(
    f"CASE WHEN contains(lower(coalesce(title, '') || ' ' || coalesce(full_text, '')), {q(k)}) THEN {v} ELSE 0.0 END" for k, v in WEIGHTS.items())
    + " + " + V.case_map("document_type", TYPE_BONUS, 0.0) + ", 10.0)") + """ AS health_relevance
FROM d_docs""")
def q_weighted_relevance(spark, sf_dir):
    """Weighted term sum + type bonus, capped at 10."""
    d = model(spark, sf_dir).D
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("full_text", F.lit("")))
    return d.select("document_id", rnd(weighted_relevance(text, "document_type", WEIGHTS, TYPE_BONUS))
                    .alias("health_relevance"))


# ------------------------------------------------------------ pages / HTML --
@register("page_extract", r"""
WITH p AS (SELECT page_id, url, html,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'),
     '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS stripped
  FROM pages)
SELECT page_id,
       trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
       regexp_replace(url, '[?#].*$', '') AS clean_url,
       regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1) AS host,
       array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), '|') AS links,
       trim(regexp_replace(replace(replace(replace(replace(replace(replace(stripped, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text
FROM p""")
def page_extract(spark, sf_dir):
    """S2 + P4 + P8: title, visible text, links, host and clean URL of each page."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", T.html_title("html").alias("title"), T.clean_url("url").alias("clean_url"),
                    T.url_host("url").alias("host"), F.array_join(T.html_links("html"), "|").alias("links"),
                    T.html_to_text("html").alias("text"))


@register("page_links_resolved", r"""
SELECT page_id, CASE WHEN starts_with(l, 'http') THEN l WHEN starts_with(l, '/') THEN 'https://site.example.org' || l
                     ELSE 'https://site.example.org/' || l END AS link
FROM pages, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS u(l)""")
def page_links_resolved(spark, sf_dir):
    """Relative links resolved against a base."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(T.html_links("html")).alias("l")) \
            .select("page_id", T.resolve_url("l", "https://site.example.org").alias("link"))


@register("page_post_type", f"""
SELECT {first_rule_sql('lower(url)', L.TEST_POST_TYPES, L.TEST_POST_DEFAULT)} AS post_type, count(*) AS n
FROM pages GROUP BY 1""")
def page_post_type(spark, sf_dir):
    """Ordered URL-pattern classification."""
    p = read(spark, sf_dir, "pages")
    return p.groupBy(C.post_type("url", L.TEST_POST_TYPES, L.TEST_POST_DEFAULT).alias("post_type")) \
            .agg(F.count(F.lit(1)).alias("n"))


SOURCE_KINDS = [("Low", ["src1", "src2"]), ("Teen", ["src1"]), ("Other", ["src"])]


@register("source_kind", V.with_(V.S_SRC) + f"""
SELECT source_name, {first_rule_sql('lower(source_name)', SOURCE_KINDS, 'Unknown')} AS kind FROM s_src""")
def source_kind(spark, sf_dir):
    """Kind from a source-name substring."""
    s = model(spark, sf_dir).S
    return s.select("source_name", C.doc_kind("source_name", SOURCE_KINDS, "Unknown").alias("kind"))


# ------------------------------------------------------- scalar functions --
DATES_SQL = r"""
WITH s AS (
  SELECT event_id,
    CASE event_id % 5
      WHEN 0 THEN strftime(ts, '%Y-%m-%d')
      WHEN 1 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000')
      WHEN 2 THEN strftime(ts, '%Y-%m')
      WHEN 3 THEN strftime(ts, '%d.%m.%Y')
      ELSE 'n/a' END AS raw
  FROM events)
SELECT event_id, raw, coalesce(
    CAST(try_strptime(raw, '%Y-%m-%d') AS DATE),
    CAST(timezone('UTC', try_strptime(regexp_replace(raw, '^[A-Za-z]{3}, ', ''), '%d %b %Y %H:%M:%S %z')) AS DATE),
    CAST(try_strptime(raw, '%Y-%m') AS DATE),
    CAST(try_strptime(raw, '%d.%m.%Y') AS DATE)) AS parsed
FROM s"""


@register("parse_dates", DATES_SQL)
def parse_dates(spark, sf_dir):
    """Date parse, first fitting format wins, else NULL."""
    from ..functions.dates import parse_date_any
    e = read(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")) \
           .when(k == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss '+0000'")) \
           .when(k == 2, F.date_format("ts", "yyyy-MM")) \
           .when(k == 3, F.date_format("ts", "dd.MM.yyyy")) \
           .otherwise(F.lit("n/a"))
    return e.select("event_id", raw.alias("raw")).select(
        "event_id", "raw", parse_date_any("raw", ["yyyy-MM-dd", "rfc822", "yyyy-MM", "dd.MM.yyyy"]).alias("parsed"))


@register("text_scalars", V.with_(V.D_DOCS, V.DN_DOCS) + f"""
SELECT document_id,
  CASE WHEN length(title) > 70 THEN substr(title, 1, 70) || '...' ELSE title END AS short_title,
  CASE WHEN country IS NULL OR country = '' THEN 'Unknown' ELSE country END AS country_label,
  CASE WHEN country = 'Germany' THEN 'de' ELSE 'en' END AS derived_language,
  'DOC-' || source || '-' || CAST(document_id AS VARCHAR) AS ext_id,
  substr(regexp_replace(trim(string_split(language || ', ' || source || ', ' || coalesce(country, ''), ',')[-1]), '\\.+$', ''), 1, 95) AS affiliation_country,
  array_to_string(list_transform(['a', 'b'], lambda x: upper(x) || ':' || language), '; ') AS joined,
  CASE WHEN publish_date IS NULL THEN 'N/A' ELSE strftime(publish_date, '%b %Y') END AS month_label,
  format('{{:,}}', n_chars) AS chars_label,
  CASE WHEN document_type = 'news' THEN 'news' ELSE 'trends' END AS derived_source_type
FROM dn_docs""")
def text_scalars(spark, sf_dir):
    """P3 clip, P17 default, P25 derived language, P7 external id, P11
    affiliation country, P19 string join, P18 month label."""
    j = model(spark, sf_dir).Dn
    aff = F.concat(F.col("language"), F.lit(", "), F.col("source"), F.lit(", "), F.coalesce("country", F.lit("")))
    return j.select(
        "document_id",
        T.clip("title", 70, "...").alias("short_title"),
        T.default("country", "Unknown").alias("country_label"),
        F.when(F.col("country") == "Germany", "de").otherwise("en").alias("derived_language"),
        F.concat(F.lit("DOC-"), F.col("source"), F.lit("-"), F.col("document_id").cast("string")).alias("ext_id"),
        T.affiliation_country(aff).alias("affiliation_country"),
        F.array_join(F.transform(F.array(F.lit("a"), F.lit("b")),
                                 lambda x: F.concat(F.upper(x), F.lit(":"), F.col("language"))), "; ").alias("joined"),
        F.when(F.col("publish_date").isNull(), "N/A")
         .otherwise(F.date_format("publish_date", "MMM yyyy")).alias("month_label"),
        F.format_number("n_chars", 0).alias("chars_label"),
        F.when(F.col("document_type") == "news", "news").otherwise("trends").alias("derived_source_type"))


@register("safe_dates", """
SELECT event_id, CAST(try_strptime(CASE WHEN event_id % 3 = 0 THEN 'bad-' || CAST(event_id AS VARCHAR)
                                        ELSE strftime(ts, '%Y-%m-%d') END, '%Y-%m-%d') AS DATE) AS d
FROM events""")
def safe_dates(spark, sf_dir):
    """Coercion to date, bad values -> NULL."""
    e = read(spark, sf_dir, "events")
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("bad-"), F.col("event_id").cast("string"))) \
         .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", to_date_safe(s).alias("d"))


@register("display_values", V.with_(*V.SCORED_CHAIN) + """
SELECT document_id, keyword_id, printf('%.1f', floor(strategic_score * 10.0 + 0.5) / 10.0) AS score_label,
       CASE WHEN is_regulatory THEN 'yes' ELSE '-' END AS reg_mark,
       replace(title, 'the ', '') AS title_clean
FROM scored""")
def display_values(spark, sf_dir):
    """Display columns (1-decimal score, flag mark, phrase removed)."""
    sc = model(spark, sf_dir).scored
    return sc.select("document_id", "keyword_id",
                     F.format_string("%.1f", rnd("strategic_score", 1)).alias("score_label"),
                     F.when(F.col("is_regulatory"), "yes").otherwise("-").alias("reg_mark"),
                     F.replace("title", F.lit("the "), F.lit("")).alias("title_clean"))
