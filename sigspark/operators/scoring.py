"""Signal scoring: relevance, novelty, impact, strategic score, urgency.

Plan shape (what keeps this cheap at scale):
* Matching, flags and impact are expressions of a document's own row, so the
  texts are read once and never leave the scan's tasks. The resulting narrow
  signal table (exact and fuzzy hits) is stored once.
* Novelty needs counts over *all* signals of a keyword (and of a keyword
  and source). These are partial aggregates (map-side combine) of the stored
  table, joined back -- no window over a hot keyword, no correlated
  sub-queries, no forced broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..bindings import as_of_ts
from ..session import short_scans, stored_once
from .tagging import match_flags, merged_flags, normalize_country, signals, type_flags, with_hits


def lookup(c, mapping: dict, default) -> Column:
    """Small literal dictionary lookup as a CASE chain (codegen friendly)."""
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def type_impact(doc_type, table=None, default: float = L.DEFAULT_TYPE_IMPACT) -> Column:
    """First dictionary entry (in order) contained in the type, case-insensitive."""
    table = L.DOC_TYPE_IMPACT if table is None else table
    dt = F.lower(F.coalesce(F.col(doc_type) if isinstance(doc_type, str) else doc_type, F.lit("")))
    expr = None
    for pat, val in table:
        cond = dt.contains(pat.lower())
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.otherwise(F.lit(default))


def impact_expr(doc_type="document_type", full_text="full_text", country="country",
                trust="trust_level") -> Column:
    """.4 type + trust authority + .25 coverage + .2 trial phase, cap 10."""
    dt = F.lower(F.coalesce(F.col(doc_type), F.lit("")))
    ft = F.col(full_text)
    low = F.lower(ft)
    trial = F.when(dt.contains("trial") & ft.isNotNull() & (ft != ""),
                   F.when(low.contains("phase 3") | low.contains("phase iii"), F.lit(9.0 * 0.20))
                    .when(low.contains("phase 2") | low.contains("phase ii"), F.lit(7.0 * 0.20))
                    .otherwise(F.lit(5.0 * 0.20))).otherwise(F.lit(5.0 * 0.20))
    geo = F.when(F.col(country).isin(*L.WIDE_COVERAGE), F.lit(9.0 * 0.25)).otherwise(F.lit(5.0 * 0.25))
    authority = F.col(trust) / 5.0 * 10.0 * 0.15
    total = type_impact(doc_type) * 0.40 + authority + geo + trial
    return F.least(total, F.lit(10.0))


def relevance_expr(match="match_score", trust="trust_level", level="level",
                   country="country") -> Column:
    """M9: .4 match + trust + focus(level) + geography, cap 10."""
    kw = F.col(match) * 0.4
    tr = F.col(trust) / 5.0 * 10.0 * 0.25
    focus = lookup(level, L.FOCUS_BY_LEVEL, L.DEFAULT_FOCUS) * 0.20
    geo = lookup(country, L.PRIORITY_COUNTRIES, L.DEFAULT_GEO_RELEVANCE) * 10.0 * 0.15
    return F.least(kw + tr + focus + geo, F.lit(10.0))


def rarity_points(n) -> Column:
    """Signals of the keyword <= 3 -> 3, <= 10 -> 2, <= 30 -> 1, else 0."""
    n = F.col(n) if isinstance(n, str) else n
    expr = None
    for bound, pts in L.RARITY_STEPS:
        expr = F.when(n <= bound, F.lit(pts)) if expr is None else expr.when(n <= bound, F.lit(pts))
    return expr.otherwise(F.lit(0.0))


def strategic_expr(rel="relevance_score", imp="impact_score", nov="novelty_score",
                   country="country", flags_present="has_flags",
                   weights: dict | None = None, default_geo_need: float = L.DEFAULT_GEO_NEED) -> Column:
    """Weighted composite; documents without a flags row use (rel+imp)/2."""
    w = L.STRATEGIC_WEIGHTS if weights is None else weights
    r, i, n = F.col(rel), F.col(imp), F.col(nov)
    reg = F.col("is_regulatory") | F.col("is_parliamentary") | F.col("is_reimbursement")
    c1 = F.when(reg, i * w["regulatory"]).otherwise(r * 0.5 * w["regulatory"])
    c2 = F.when(F.col("is_scientific"), i * w["scientific"]).otherwise(r * 0.5 * w["scientific"])
    c3 = n * w["market_trend"]
    need = lookup(country, L.PRIORITY_COUNTRIES, default_geo_need) * 10.0
    c4 = F.when(F.col("is_lmic"), F.lit(L.LMIC_NEED * w["country_need"])).otherwise(need * w["country_need"])
    flagged = F.least(c1 + c2 + c3 + c4, F.lit(10.0))
    return F.when(F.col(flags_present), flagged).otherwise((r + i) / 2.0)


def urgency_expr(score="strategic_score") -> Column:
    """>= 8 immediate, >= 6 short_term, >= 4 medium_term, else informational."""
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for bound, label in L.URGENCY:
        expr = F.when(s >= bound, F.lit(label)) if expr is None else expr.when(s >= bound, F.lit(label))
    return expr.otherwise(F.lit(L.URGENCY_DEFAULT))


def document_side(D: DataFrame, S: DataFrame) -> DataFrame:
    """Per-document attributes the scores need (impact computed here)."""
    d = D.select("document_id", "source_id", "publish_date", "scraped_at", "title", "url",
                 normalize_country("country").alias("country"), "document_type", "full_text")
    s = S.select("source_id", "source_name", "trust_level")
    j = d.join(s, "source_id")          # J13: missing source -> skipped
    return j.select("document_id", "source_id", "source_name", "trust_level", "publish_date",
                    "scraped_at", "title", "url", "country", "document_type",
                    impact_expr().alias("impact_score"))


def novelty_counts(base: DataFrame, as_of: str, days: int = L.NOVELTY_RECENT_DAYS):
    """Per-keyword and per-(keyword, source) signal counts (J14 / W4); rows
    with a column ``n`` stand for as many signals."""
    cutoff = F.to_date(as_of_ts(as_of) - F.make_dt_interval(F.lit(days)))
    n = F.col("n") if "n" in base.columns else F.lit(1).cast("long")
    recent = F.when(F.col("publish_date") >= cutoff, n).otherwise(F.lit(0).cast("long"))
    by_kw = base.groupBy("keyword_id").agg(F.sum(n).alias("kw_signals"), F.sum(recent).alias("kw_recent"))
    by_kw_src = base.groupBy("keyword_id", "source_id").agg(F.sum(n).alias("kw_src_signals"))
    return by_kw, by_kw_src


def signal_counts(signals: DataFrame) -> DataFrame:
    """Signals per keyword, source and day: what novelty needs of older ones."""
    return signals.groupBy("keyword_id", "source_id", "publish_date").agg(F.count(F.lit(1)).alias("n"))


def novelty_expr(as_of: str, days: int = L.NOVELTY_RECENT_DAYS) -> Column:
    """N1 + N2 + N3 from joined counts (own signal excluded where required)."""
    cutoff = F.to_date(as_of_ts(as_of) - F.make_dt_interval(F.lit(days)))
    own_recent = F.coalesce(F.col("publish_date") >= cutoff, F.lit(False)).cast("int")
    other_recent = F.col("kw_recent") - own_recent
    other_src = F.col("kw_src_signals") - 1
    score = rarity_points("kw_signals") \
        + F.when(other_recent == 0, F.lit(L.NOVELTY_FIRST_POINTS)).otherwise(F.lit(0.0)) \
        + F.when(other_src == 0, F.lit(L.NOVELTY_NEW_SOURCE_POINTS)).otherwise(F.lit(0.0))
    return F.least(score, F.lit(10.0))


def finish(base: DataFrame, as_of: str, weights: dict | None = None,
           default_geo_need: float = L.DEFAULT_GEO_NEED, over: DataFrame | None = None) -> DataFrame:
    """Scores of signal rows that carry their document's columns and flags.

    The novelty counts are aggregates of ``over`` (all signals, or counts of
    them; by default ``base`` itself), narrow columns of a stored table, so no
    text is matched again; the planner picks their joins.
    """
    by_kw, by_kw_src = novelty_counts(base if over is None else over, as_of)
    j = base.join(by_kw, "keyword_id").join(by_kw_src, ["keyword_id", "source_id"])
    j = j.withColumn("relevance_score", relevance_expr()).withColumn("novelty_score", novelty_expr(as_of))
    j = j.withColumn("strategic_score", strategic_expr(weights=weights, default_geo_need=default_geo_need))
    j = j.withColumn("urgency", urgency_expr())
    return j.select("document_id", "keyword_id", "keyword", "level", "source_id", "source_name",
                    "title", "url", "country", "document_type", "publish_date", "scraped_at",
                    "match_score", "match_kind", "kw_signals", "kw_recent", "kw_src_signals",
                    "relevance_score", "novelty_score", "impact_score",
                    "strategic_score", "urgency", *L.FLAG_NAMES)


def signal_rows(D: DataFrame, S: DataFrame, K: DataFrame, **options) -> DataFrame:
    """Every exact and fuzzy signal with its document's attributes, flags and
    impact, in one pass over the texts."""
    s = S.select("source_id", "source_name", "trust_level", "source_type")
    m = with_hits(D, K, **options).join(s, "source_id")       # J13: missing source -> skipped
    m = m.withColumn("country", normalize_country("country"))
    m = m.select("document_id", "source_id", "source_name", "trust_level", "publish_date", "scraped_at",
                 "title", "url", "country", "document_type", impact_expr().alias("impact_score"),
                 *merged_flags(match_flags(), type_flags()), "hits")
    cols = [c for c in m.columns if c != "hits"]
    return signals(m, *cols).withColumn("has_flags", F.lit(True))


def score_documents(D: DataFrame, S: DataFrame, K: DataFrame, as_of: str = L.AS_OF,
                    weights: dict | None = None, default_geo_need: float = L.DEFAULT_GEO_NEED,
                    **options) -> DataFrame:
    """Tag -> flags -> score: M1-M12 over all documents. The signals are
    stored once; counts and scores read the stored rows."""
    with short_scans(D.sparkSession):
        sig = stored_once(signal_rows(D, S, K, **options), "signals")
    return finish(sig, as_of, weights, default_geo_need)


def score(G: DataFrame, D: DataFrame, K: DataFrame, S: DataFrame,
          flags: DataFrame | None, as_of: str = L.AS_OF, weights: dict | None = None,
          default_geo_need: float = L.DEFAULT_GEO_NEED, already: DataFrame | None = None) -> DataFrame:
    """Score the stored signals G (document_id, keyword_id, match_score).

    ``flags`` is the document-flags table; ``None`` means no flags rows exist
    (every signal then uses the (relevance + impact) / 2 branch). ``already``
    holds the keys (document_id, keyword_id) that have a score: these count
    for novelty but are not scored again.
    """
    ds = document_side(D, S)
    k = K.select("keyword_id", "keyword", "level")
    kind = F.col("match_kind") if "match_kind" in G.columns else F.lit(None).cast("string")
    base = G.select("document_id", "keyword_id", "match_score", kind.alias("match_kind")) \
            .join(ds, "document_id").join(k, "keyword_id")
    if flags is not None:
        base = base.join(flags.withColumn("has_flags", F.lit(True)), "document_id", "left")
    else:
        base = base.withColumns({f: F.lit(None).cast("boolean") for f in L.FLAG_NAMES}) \
                   .withColumn("has_flags", F.lit(False))
    base = base.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in (*L.FLAG_NAMES, "has_flags")})
    new = base if already is None else base.join(
        already.select("document_id", "keyword_id"), ["document_id", "keyword_id"], "left_anti")
    return finish(new, as_of, weights, default_geo_need, over=base)


def weighted_relevance(text, doc_type, weights: dict, type_bonus: dict,
                       cap: float = 10.0) -> Column:
    """Sum of weights of contained terms (overlaps all add) + type bonus."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    total = F.lit(0.0)
    for term, w in weights.items():
        total = total + F.when(t.contains(term.lower()), F.lit(float(w))).otherwise(F.lit(0.0))
    dt = F.col(doc_type) if isinstance(doc_type, str) else doc_type
    total = total + lookup(dt, type_bonus, 0.0)
    return F.least(total, F.lit(cap))
