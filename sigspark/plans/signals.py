"""Registered queries: tagging, flags, scoring, novelty, alerts (M*, N*, J3, J7, J13, T2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..bindings import as_of_ts, read
from ..functions.numeric import rnd, rnd_sql
from ..operators import alerts as AL
from ..operators import anchors, tagging
from . import sqlviews as V
from .model import model
from .registry import register

R = 4  # rounding digits for doubles in compared outputs

SCORE_COLS = ("relevance_score", "novelty_score", "impact_score", "strategic_score")


def _round_scores(df, cols=SCORE_COLS):
    for c in cols:
        df = df.withColumn(c, rnd(c, R))
    return df


def _sql_scores(prefix: str = "") -> str:
    return ", ".join(f"{rnd_sql(prefix + c, R)} AS {c}" for c in SCORE_COLS)


# --------------------------------------------------------------------------
# Flagship: top signals with source and keyword (minimum slice of the build)
# --------------------------------------------------------------------------
@register("top_signals", V.with_(*V.SCORED_CHAIN) + f"""
SELECT document_id, keyword_id, keyword, source_name, title, urgency, {_sql_scores()}
FROM scored WHERE strategic_score >= 5.0
ORDER BY strategic_score DESC, document_id, keyword_id LIMIT 10""")
def top_signals(spark, sf_dir, min_score: float = 5.0, n: int = 10):
    sc = model(spark, sf_dir).scored
    top = sc.filter(F.col("strategic_score") >= min_score) \
            .orderBy(F.desc("strategic_score"), "document_id", "keyword_id").limit(n)
    return _round_scores(top.select("document_id", "keyword_id", "keyword", "source_name", "title",
                                    "urgency", *SCORE_COLS))


@register("tag_exact", V.with_(V.D_DOCS, V.k_lex(), V.D_SEARCH, V.G_EXACT)
          + "SELECT document_id, keyword_id, match_score FROM g_exact")
def q_tag_exact(spark, sf_dir):
    m = model(spark, sf_dir)
    return tagging.tag_exact(m.D, m.K).select("document_id", "keyword_id", "match_score")


@register("signals_per_keyword", V.with_(*V.SIGNAL_CHAIN) + """
SELECT k.keyword_id, k.keyword, count(g.document_id) AS n_signals,
       count(*) FILTER (WHERE g.match_score = 9.5) AS n_head
FROM k_lex k LEFT JOIN g_sig g USING (keyword_id) GROUP BY k.keyword_id, k.keyword""")
def signals_per_keyword(spark, sf_dir):
    m = model(spark, sf_dir)
    agg = m.G.groupBy("keyword_id").agg(F.count(F.lit(1)).alias("n_signals"),
                                        F.count_if(F.col("match_score") == 9.5).alias("n_head"))
    return m.K.select("keyword_id", "keyword").join(agg, "keyword_id", "left") \
              .select("keyword_id", "keyword", F.coalesce("n_signals", F.lit(0)).alias("n_signals"),
                      F.coalesce("n_head", F.lit(0)).alias("n_head"))


@register("document_flags", V.with_(*V.SIGNAL_CHAIN, V.FLAGS) + "SELECT * FROM f_flags")
def q_document_flags(spark, sf_dir):
    return model(spark, sf_dir).flags


@register("flags_from_matches", V.with_(*V.SIGNAL_CHAIN, V.FLAGS) + "SELECT * FROM f_match")
def q_flags_from_matches(spark, sf_dir):
    m = model(spark, sf_dir)
    return tagging.flags_from_matches(m.D, m.K)


@register("flags_from_type", V.with_(*V.SIGNAL_CHAIN, V.FLAGS) + "SELECT * FROM f_type")
def q_flags_from_type(spark, sf_dir):
    m = model(spark, sf_dir)
    return tagging.flags_from_type(m.D, m.S)


@register("flag_counts", V.with_(*V.SIGNAL_CHAIN, V.FLAGS) + "SELECT "
          + ", ".join(f"count(*) FILTER (WHERE {f}) AS n_{f}" for f in L.FLAG_NAMES)
          + ", count(*) AS n_docs FROM f_flags")
def flag_counts(spark, sf_dir):
    fl = model(spark, sf_dir).flags
    return fl.agg(*[F.count_if(f).alias(f"n_{f}") for f in L.FLAG_NAMES],
                  F.count(F.lit(1)).alias("n_docs"))


@register("signals_scored", V.with_(*V.SCORED_CHAIN) + f"""
SELECT document_id, keyword_id, source_id, urgency, {_sql_scores()} FROM scored""")
def signals_scored(spark, sf_dir):
    sc = model(spark, sf_dir).scored
    return _round_scores(sc.select("document_id", "keyword_id", "source_id", "urgency", *SCORE_COLS))


@register("relevance", V.with_(*V.SCORED_CHAIN)
          + f"SELECT document_id, keyword_id, {rnd_sql("relevance_score", R)} AS relevance_score FROM scored")
def q_relevance(spark, sf_dir):
    sc = model(spark, sf_dir).scored
    return sc.select("document_id", "keyword_id", rnd("relevance_score", R).alias("relevance_score"))


@register("impact_by_document", V.with_(V.D_DOCS, V.S_SRC, V.D_SIDE)
          + f"SELECT document_id, {rnd_sql("impact_score", R)} AS impact_score FROM d_side")
def impact_by_document(spark, sf_dir):
    from ..operators.scoring import document_side
    m = model(spark, sf_dir)
    return document_side(m.D, m.S).select("document_id", rnd("impact_score", R).alias("impact_score"))


@register("novelty", V.with_(*V.SCORED_CHAIN) + f"""
SELECT document_id, keyword_id, kw.kw_signals, kw.kw_recent, ks.kw_src_signals,
       {rnd_sql("novelty_score", R)} AS novelty_score
FROM scored JOIN sc_kw kw USING (keyword_id) JOIN sc_kws ks USING (keyword_id, source_id)""")
def q_novelty(spark, sf_dir):
    sc = model(spark, sf_dir).scored
    return sc.select("document_id", "keyword_id", "kw_signals", "kw_recent", "kw_src_signals",
                     rnd("novelty_score", R).alias("novelty_score"))


@register("urgency_counts", V.with_(*V.SCORED_CHAIN)
          + "SELECT urgency, count(*) AS n_signals FROM scored GROUP BY urgency")
def urgency_counts(spark, sf_dir):
    return model(spark, sf_dir).scored.groupBy("urgency").agg(F.count(F.lit(1)).alias("n_signals"))


@register("untagged_documents", V.with_(*V.SIGNAL_CHAIN) + """
SELECT document_id, title FROM d_docs d
WHERE NOT EXISTS (SELECT 1 FROM g_sig g WHERE g.document_id = d.document_id)""")
def untagged_documents(spark, sf_dir):
    m = model(spark, sf_dir)
    return tagging.untagged(m.D, m.K).select("document_id", "title")


@register("country_normalized", V.with_(V.D_DOCS) + f"""
SELECT {V.country_norm('country')} AS country, count(*) AS n_docs
FROM d_docs GROUP BY 1""")
def country_normalized(spark, sf_dir):
    d = model(spark, sf_dir).D
    return d.groupBy(tagging.normalize_country("country").alias("country")) \
            .agg(F.count(F.lit(1)).alias("n_docs"))


@register("signal_detail", V.with_(*V.SCORED_CHAIN) + f"""
SELECT document_id, keyword_id, keyword, level, source_name, title, country, document_type,
       {rnd_sql("strategic_score", R)} AS strategic_score
FROM scored WHERE strategic_score >= 7.0""")
def signal_detail(spark, sf_dir):
    """Signals joined with documents, sources and keywords (score >= 7)."""
    sc = model(spark, sf_dir).scored
    return sc.filter(F.col("strategic_score") >= 7.0).select(
        "document_id", "keyword_id", "keyword", "level", "source_name", "title", "country",
        "document_type", rnd("strategic_score", R).alias("strategic_score"))


ALERT_SQL = V.with_(*V.SCORED_CHAIN) + f"""
, alert_sel AS (
  SELECT * FROM scored
  WHERE strategic_score >= {L.ALERT_MIN_SCORE}
    AND scraped_at >= {V.AS_OF} - INTERVAL {L.ALERT_LOOKBACK_HOURS} HOUR
  ORDER BY strategic_score DESC, document_id, keyword_id LIMIT {L.ALERT_MAX})
"""


@register("alerts", ALERT_SQL + f"""
SELECT document_id, keyword_id, keyword, source_name, substr(title, 1, 80) AS subject,
       {rnd_sql("strategic_score", R)} AS strategic_score,
       CASE WHEN strategic_score >= {L.ALERT_IMMEDIATE} THEN 'immediate' ELSE 'digest' END AS channel
FROM alert_sel""")
def q_alerts(spark, sf_dir):
    m = model(spark, sf_dir)
    a = AL.select_alerts(m.scored, m.as_of)
    return a.select("document_id", "keyword_id", "keyword", "source_name", "subject",
                    rnd("strategic_score", R).alias("strategic_score"), "channel")


@register("alert_digest", ALERT_SQL + f"""
SELECT count(*) AS n_signals,
       string_agg(CAST(document_id AS VARCHAR) || ':' || CAST(keyword_id AS VARCHAR), '|'
                  ORDER BY strategic_score DESC, document_id, keyword_id) AS items
FROM alert_sel WHERE strategic_score < {L.ALERT_IMMEDIATE}""")
def q_alert_digest(spark, sf_dir):
    m = model(spark, sf_dir)
    return AL.digest(AL.select_alerts(m.scored, m.as_of))


CHILD_KINDS = f"""c_docs AS (
  SELECT *, CASE document_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'app' WHEN 2 THEN 'paper' END AS child_kind,
         document_id % 3 = 0 AS child_neuro, document_id % 5 = 0 AS child_digital,
         lower(coalesce(title, '') || ' ' || coalesce(full_text, '')) AS both_text
  FROM d_docs),
f_child AS (
  SELECT document_id,
         coalesce(child_kind IN ('decision', 'app'), FALSE) AS is_regulatory,
         coalesce(child_kind = 'paper', FALSE) AS is_parliamentary,
         coalesce(child_kind IN ('decision', 'app')
                  OR child_kind = 'paper' AND {V._contains_any('both_text', L.PAPER_REIMBURSEMENT_TERMS)}, FALSE) AS is_reimbursement,
         coalesce(child_kind = 'app' OR child_kind = 'decision' AND child_digital
                  OR child_kind = 'paper' AND {V._contains_any('both_text', L.PAPER_DIGA_TERMS)}, FALSE) AS is_diga,
         coalesce(child_kind IN ('decision', 'app') AND child_neuro, FALSE) AS is_neuro
  FROM c_docs)"""


def _with_children(d):
    """D with the child record of a document (a decision, an app or a paper)."""
    i = F.col("document_id")
    kind = F.when(i % 4 == 0, "decision").when(i % 4 == 1, "app").when(i % 4 == 2, "paper")
    return d.withColumns({"child_kind": kind, "child_neuro": i % 3 == 0, "child_digital": i % 5 == 0})


@register("flags_from_children", V.with_(V.D_DOCS, CHILD_KINDS) + "SELECT * FROM f_child")
def q_flags_from_children(spark, sf_dir):
    """M7: flags that child records set."""
    d = _with_children(model(spark, sf_dir).D)
    return d.select("document_id", *[c.alias(n) for n, c in tagging.child_flags().items()])


@register("flags_merged", V.with_(*V.SIGNAL_CHAIN, V.FLAGS, CHILD_KINDS) + """
SELECT document_id, f.is_regulatory OR c.is_regulatory AS is_regulatory, f.is_scientific,
       f.is_neuro OR c.is_neuro AS is_neuro, f.is_lmic,
       f.is_parliamentary OR c.is_parliamentary AS is_parliamentary,
       f.is_reimbursement OR c.is_reimbursement AS is_reimbursement, f.is_diga OR c.is_diga AS is_diga
FROM f_flags f JOIN f_child c USING (document_id)""")
def q_flags_merged(spark, sf_dir):
    """M8: matches, types and child records merged."""
    m = model(spark, sf_dir)
    return tagging.document_flags(_with_children(m.D), m.S, m.K, children=True)


@register("alerts_window_docs", V.with_(V.D_DOCS) + f"""
SELECT count(*) AS n_docs FROM d_docs
WHERE scraped_at >= {V.AS_OF} - INTERVAL {L.ALERT_LOOKBACK_HOURS} HOUR""")
def alerts_window_docs(spark, sf_dir):
    d = model(spark, sf_dir).D
    since = as_of_ts(L.AS_OF) - F.make_dt_interval(F.lit(0), F.lit(L.ALERT_LOOKBACK_HOURS))
    return d.filter(F.col("scraped_at") >= since).agg(F.count(F.lit(1)).alias("n_docs"))


# --------------------------------------------------------------------------
# Fuzzy matching (M2, M3) and the full tag union (M4)
# --------------------------------------------------------------------------
FULL_LEXICON = L.TEST_LEXICON + L.TEST_FUZZY_TERMS


def _full_k(spark):
    from ..bindings import lexicon_view
    return lexicon_view(spark, FULL_LEXICON)


@register("tag_fuzzy", V.with_(V.D_DOCS, V.k_lex(FULL_LEXICON, "k_all"), V.D_SEARCH, V.fuzzy_ctes("k_all", every=True))
          + f"SELECT document_id, keyword_id, {rnd_sql('match_score', R)} AS match_score FROM g_fuzzy")
def q_tag_fuzzy(spark, sf_dir):
    m = model(spark, sf_dir)
    fz = tagging.tag_fuzzy(m.D, _full_k(spark))
    return fz.select("document_id", "keyword_id", rnd("match_score", R).alias("match_score"))


@register("tag_all", V.with_(V.D_DOCS, V.k_lex(FULL_LEXICON, "k_all"), V.D_SEARCH,
                             V.fuzzy_ctes("k_all"),
                             V.G_EXACT.replace("k_lex", "k_all")) + f"""
SELECT document_id, keyword_id, {rnd_sql('match_score', R)} AS match_score, 'exact' AS match_kind FROM g_exact
UNION ALL
SELECT document_id, keyword_id, {rnd_sql('match_score', R)} AS match_score, 'fuzzy' AS match_kind FROM g_fuzzy""")
def q_tag_all(spark, sf_dir):
    m = model(spark, sf_dir)
    g = tagging.tag(m.D, _full_k(spark))
    return g.select("document_id", "keyword_id", rnd("match_score", R).alias("match_score"), "match_kind")


@register("fuzzy_hits_per_term", V.with_(V.D_DOCS, V.k_lex(FULL_LEXICON, "k_all"), V.D_SEARCH,
                                         V.fuzzy_ctes("k_all")) + f"""
SELECT keyword_id, count(*) AS n_docs, {rnd_sql('max(match_score)', R)} AS best_score
FROM g_fuzzy GROUP BY keyword_id""")
def fuzzy_hits_per_term(spark, sf_dir):
    m = model(spark, sf_dir)
    fz = tagging.tag_fuzzy(m.D, _full_k(spark))
    return fz.groupBy("keyword_id").agg(F.count(F.lit(1)).alias("n_docs"),
                                        rnd(F.max("match_score"), R).alias("best_score"))


# --------------------------------------------------------------------------
# A lexicon that comes from data (M1, J9): words and word pairs of ``benchmark``
# --------------------------------------------------------------------------
def _benchmark_terms(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    b = read(spark, sf_dir, "benchmark").select(w.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
                        lambda i: F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)))
    terms = b.select(F.explode(F.concat("w", pairs)).alias("keyword")).filter(F.col("keyword").isNotNull()).distinct()
    return terms.withColumn("keyword_id", F.col("keyword"))


@register("lexicon_terms", V.with_(V.D_DOCS, V.D_SEARCH, """b_words AS (
  SELECT regexp_extract_all(lower(text), '\\p{L}+') AS w FROM benchmark),
b_terms AS (
  SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS keyword
  FROM b_words)""") + f"""
SELECT keyword, count(*) AS n_docs,
       count(*) FILTER (WHERE contains(substr(search_text, 1, {L.EXACT_HEAD_CHARS}), keyword)) AS n_head
FROM d_search JOIN b_terms ON contains(search_text, keyword) GROUP BY keyword""")
def lexicon_terms(spark, sf_dir):
    """M1 / J9 with every word and word pair of ``benchmark`` as a term: the
    documents that contain it, at all and in their heads."""
    hits = anchors.tag_indexed(model(spark, sf_dir).D, _benchmark_terms(spark, sf_dir))
    return hits.groupBy(F.col("keyword_id").alias("keyword")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("match_score") == L.EXACT_HEAD_SCORE).alias("n_head"))
