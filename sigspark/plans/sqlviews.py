"""DuckDB-side definitions of the model views (the oracle).

Independent SQL for the same semantics as ``sigspark.bindings`` and the
operators; the driver runs these on the raw parquet views and compares
results with the Spark side. Generated from the same constant tables in
``sigspark.lexicon`` so the dictionaries cannot drift apart.
"""

from __future__ import annotations

import re

from .. import lexicon as L


def q(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "TRUE" if s else "FALSE"
    if isinstance(s, (int, float)):
        return repr(s)
    return "'" + str(s).replace("'", "''") + "'"


def case_pick(expr: str, values: list) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def case_map(expr: str, mapping: dict, default) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {q(k)} THEN {q(v)}" for k, v in mapping.items()) \
        + f" ELSE {q(default)} END"


AS_OF = f"TIMESTAMP '{L.AS_OF}'"

D_DOCS = f"""d_docs AS (
  SELECT doc_id AS document_id,
         CAST(substr(source, 4) AS INTEGER) AS source_id,
         source || '-' || CAST(doc_id AS VARCHAR) AS external_id,
         split_part(split_part(text, chr(10), 1), '.', 1) AS title,
         'doc/' || CAST(doc_id AS VARCHAR) AS url,
         CASE WHEN doc_id % 17 = 0 THEN NULL
              ELSE DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) END AS publish_date,
         {AS_OF} - to_hours(CAST(doc_id % 72 AS BIGINT)) AS scraped_at,
         lang AS language,
         text AS full_text,
         {case_pick('doc_id % 10', L.TEST_COUNTRIES)} AS country,
         {case_pick('doc_id % 8', L.TEST_DOC_TYPES)} AS document_type,
         source, n_chars
  FROM documents)"""

S_SRC = f"""s_src AS (
  SELECT CAST(substr(source, 4) AS INTEGER) AS source_id,
         source AS source_name,
         {case_pick('CAST(substr(source, 4) AS INTEGER) % 7', L.TEST_SOURCE_TYPES)} AS source_type,
         CAST(NULL AS VARCHAR) AS country,
         {case_pick('CAST(substr(source, 4) AS INTEGER) % 5', L.TEST_REGIONS)} AS region,
         CAST(substr(source, 4) AS INTEGER) % 5 + 1 AS trust_level
  FROM (SELECT DISTINCT source FROM documents))"""


def k_lex(rows=None, name: str = "k_lex") -> str:
    rows = L.TEST_LEXICON if rows is None else rows
    vals = ", ".join(f"({k}, {q(w)}, {lv}, {q(c)})" for k, w, lv, c in rows)
    return f"""{name} AS (
  SELECT CAST(keyword_id AS INTEGER) AS keyword_id, keyword, CAST(level AS INTEGER) AS level, cluster
  FROM (VALUES {vals}) t(keyword_id, keyword, level, cluster))"""


D_SEARCH = f"""d_search AS (
  SELECT document_id,
         lower(coalesce(title, '') || CASE WHEN full_text IS NOT NULL AND full_text <> ''
                                      THEN ' ' || full_text ELSE '' END) AS search_text
  FROM d_docs)"""

G_EXACT = f"""g_exact AS (
  SELECT s.document_id, k.keyword_id,
         CASE WHEN contains(substr(s.search_text, 1, {L.EXACT_HEAD_CHARS}), lower(k.keyword))
              THEN {L.EXACT_HEAD_SCORE} ELSE {L.EXACT_BODY_SCORE} END AS match_score
  FROM d_search s JOIN k_lex k ON contains(s.search_text, lower(k.keyword)))"""


def country_norm(expr: str) -> str:
    m = " ".join(f"WHEN lower({expr}) = {q(k)} THEN {q(v)}" for k, v in L.COUNTRY_ALIASES.items())
    return f"CASE {m} ELSE {expr} END"


def _contains_any(expr: str, terms) -> str:
    if not terms:
        return "FALSE"
    return "(" + " OR ".join(f"contains({expr}, {q(t)})" for t in terms) + ")"


def type_impact_sql(dt: str) -> str:
    low = f"lower(coalesce({dt}, ''))"
    whens = " ".join(f"WHEN contains({low}, {q(p.lower())}) THEN {v}" for p, v in L.DOC_TYPE_IMPACT)
    return f"CASE {whens} ELSE {L.DEFAULT_TYPE_IMPACT} END"


IMPACT = f"""least({type_impact_sql('d.document_type')} * 0.4
   + s.trust_level / 5.0 * 10.0 * 0.15
   + CASE WHEN country_n IN ('EU', 'International', 'Global') THEN 9.0 * 0.25 ELSE 5.0 * 0.25 END
   + CASE WHEN contains(lower(coalesce(d.document_type, '')), 'trial') AND d.full_text IS NOT NULL AND d.full_text <> ''
          THEN CASE WHEN contains(lower(d.full_text), 'phase 3') OR contains(lower(d.full_text), 'phase iii') THEN 9.0 * 0.2
                    WHEN contains(lower(d.full_text), 'phase 2') OR contains(lower(d.full_text), 'phase ii') THEN 7.0 * 0.2
                    ELSE 5.0 * 0.2 END
          ELSE 5.0 * 0.2 END, 10.0)"""

D_SIDE = f"""d_side AS (
  SELECT d.document_id, d.source_id, s.source_name, s.trust_level, d.publish_date, d.scraped_at,
         d.title, d.url, country_n AS country, d.document_type,
         {IMPACT} AS impact_score
  FROM (SELECT *, {country_norm('country')} AS country_n FROM d_docs) d
  JOIN s_src s ON s.source_id = d.source_id)"""

FLAGS = f"""f_match AS (
  SELECT g.document_id,
         bool_or(k.level = 2) AS is_regulatory, bool_or(k.level = 3) AS is_neuro,
         bool_or(k.level = 4) AS is_lmic, bool_or(k.level = 5) AS is_reimbursement,
         bool_or(k.cluster IN ('diga', 'dipa')) AS is_diga
  FROM g_sig g JOIN k_lex k USING (keyword_id) GROUP BY g.document_id),
f_type AS (
  SELECT d.document_id,
         (coalesce(s.source_type, '') = 'scientific' OR lower(coalesce(d.document_type, '')) IN ('journal_article', 'clinical_trial')) AS is_scientific,
         (coalesce(s.source_type, '') IN ('regulatory', 'hta') OR {_contains_any("lower(coalesce(d.document_type, ''))", L.DOC_TYPE_FLAGS['regulatory'])}) AS is_regulatory,
         (coalesce(s.source_type, '') = 'parliamentary' OR {_contains_any("lower(coalesce(d.document_type, ''))", L.DOC_TYPE_FLAGS['parliamentary'])}) AS is_parliamentary
  FROM d_docs d LEFT JOIN s_src s USING (source_id)),
f_flags AS (
  SELECT document_id,
         coalesce(bool_or(is_regulatory), FALSE) AS is_regulatory,
         coalesce(bool_or(is_scientific), FALSE) AS is_scientific,
         coalesce(bool_or(is_neuro), FALSE) AS is_neuro,
         coalesce(bool_or(is_lmic), FALSE) AS is_lmic,
         coalesce(bool_or(is_parliamentary), FALSE) AS is_parliamentary,
         coalesce(bool_or(is_reimbursement), FALSE) AS is_reimbursement,
         coalesce(bool_or(is_diga), FALSE) AS is_diga
  FROM (SELECT document_id, is_regulatory, FALSE AS is_scientific, is_neuro, is_lmic,
               FALSE AS is_parliamentary, is_reimbursement, is_diga FROM f_match
        UNION ALL
        SELECT document_id, is_regulatory, is_scientific, FALSE, FALSE, is_parliamentary, FALSE, FALSE FROM f_type)
  GROUP BY document_id)"""


def _rarity(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {b} THEN {p}" for b, p in L.RARITY_STEPS) + " ELSE 0.0 END"


def _urgency(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {s} >= {b} THEN {q(lab)}" for b, lab in L.URGENCY) \
        + f" ELSE {q(L.URGENCY_DEFAULT)} END"


CUTOFF = f"CAST({AS_OF} - INTERVAL {L.NOVELTY_RECENT_DAYS} DAY AS DATE)"
W = L.STRATEGIC_WEIGHTS

SCORED = f"""sc_base AS (
  SELECT g.document_id, g.keyword_id, g.match_score, k.keyword, k.level, d.*
         EXCLUDE (document_id)
  FROM g_sig g JOIN d_side d USING (document_id) JOIN k_lex k USING (keyword_id)),
sc_kw AS (
  SELECT keyword_id, count(*) AS kw_signals,
         count(*) FILTER (WHERE publish_date >= {CUTOFF}) AS kw_recent
  FROM sc_base GROUP BY keyword_id),
sc_kws AS (
  SELECT keyword_id, source_id, count(*) AS kw_src_signals FROM sc_base GROUP BY keyword_id, source_id),
sc1 AS (
  SELECT b.*, f.* EXCLUDE (document_id), (f.document_id IS NOT NULL) AS has_flags,
         least(b.match_score * 0.4 + b.trust_level / 5.0 * 10.0 * 0.25
               + {case_map('b.level', L.FOCUS_BY_LEVEL, L.DEFAULT_FOCUS)} * 0.2
               + {case_map('b.country', L.PRIORITY_COUNTRIES, L.DEFAULT_GEO_RELEVANCE)} * 10.0 * 0.15, 10.0) AS relevance_score,
         least({_rarity('kw.kw_signals')}
               + CASE WHEN kw.kw_recent - CAST(coalesce(b.publish_date >= {CUTOFF}, FALSE) AS INTEGER) = 0
                      THEN {L.NOVELTY_FIRST_POINTS} ELSE 0.0 END
               + CASE WHEN ks.kw_src_signals - 1 = 0 THEN {L.NOVELTY_NEW_SOURCE_POINTS} ELSE 0.0 END, 10.0) AS novelty_score
  FROM sc_base b JOIN sc_kw kw USING (keyword_id) JOIN sc_kws ks USING (keyword_id, source_id)
  LEFT JOIN f_flags f USING (document_id)),
sc2 AS (
  SELECT *,
    CASE WHEN has_flags THEN least(
        CASE WHEN is_regulatory OR is_parliamentary OR is_reimbursement THEN impact_score * {W['regulatory']}
             ELSE relevance_score * 0.5 * {W['regulatory']} END
      + CASE WHEN is_scientific THEN impact_score * {W['scientific']}
             ELSE relevance_score * 0.5 * {W['scientific']} END
      + novelty_score * {W['market_trend']}
      + CASE WHEN is_lmic THEN {L.LMIC_NEED * W['country_need']}
             ELSE {case_map('country', L.PRIORITY_COUNTRIES, L.DEFAULT_GEO_NEED)} * 10.0 * {W['country_need']} END, 10.0)
    ELSE (relevance_score + impact_score) / 2.0 END AS strategic_score
  FROM sc1),
scored AS (
  SELECT *, {_urgency('strategic_score')} AS urgency FROM sc2)"""


_DEC = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def doubles(sql: str) -> str:
    """DuckDB types 0.4 as DECIMAL; Spark as DOUBLE. Make every decimal literal
    outside quotes a DOUBLE so both engines do the same float arithmetic."""
    parts = sql.split("'")
    for i in range(0, len(parts), 2):
        parts[i] = _DEC.sub(r"CAST(\1 AS DOUBLE)", parts[i])
    return "'".join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def lcs_sql(a: str, b: str) -> str:
    """LCS length by row DP (DuckDB lambdas); mirrors functions.text.lcs_length."""
    return (f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_reduce(range(1, length({a}) + 1), "
            f"lambda prev, i: list_reduce(range(1, length({b}) + 1), "
            f"lambda cur, j: list_append(cur, CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) "
            f"THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0]), "
            f"list_resize([0], length({b}) + 1, 0))[length({b}) + 1] END")


def fuzzy_ctes(lex_name: str = "k_lex", threshold: float = L.FUZZY_THRESHOLD, every: bool = False) -> str:
    """Fuzzy windows -> first window with ratio >= threshold (M2/M3).

    ``every``: the ratio of every different (term, window) is computed unless
    the lengths alone rule it out (an LCS is no longer than the shorter one);
    otherwise a Levenshtein bound saves most of that work."""
    short = f"200.0 * least(length(kw), length(chunk)) >= {threshold} * (length(kw) + length(chunk))"
    near = short if every else (short + " AND levenshtein(kw, chunk) <= "
                                f"(1.0 - {threshold} / 100.0) * (length(kw) + length(chunk)) + 0.000001")
    return f"""fz_pairs AS (
  SELECT s.document_id, k.keyword_id, lower(k.keyword) AS kw,
         len(string_split(lower(k.keyword), ' ')) AS n, s.ws
  FROM (SELECT document_id, search_text,
               list_filter(regexp_split_to_array(search_text, '\\s+'), lambda w: w <> '') AS ws
        FROM d_search) s
  JOIN {lex_name} k ON len(string_split(lower(k.keyword), ' ')) >= {L.FUZZY_MIN_TERM_WORDS}
                   AND NOT contains(s.search_text, lower(k.keyword))),
fz_win AS (
  SELECT document_id, keyword_id, kw, CAST(st / n AS BIGINT) AS w_pos,
         array_to_string(ws[st + 1 : st + n], ' ') AS chunk
  FROM (SELECT *, unnest(generate_series(0, len(ws) - n, n)) AS st FROM fz_pairs)),
fz_ratio AS (
  SELECT kw, chunk,
         (1.0 - (length(kw) + length(chunk) - 2 * ({lcs_sql('kw', 'chunk')})) / (length(kw) + length(chunk))) * 100.0 AS ratio
  FROM (SELECT DISTINCT kw, chunk FROM fz_win WHERE {near})),
g_fuzzy AS (
  SELECT document_id, keyword_id, arg_min(ratio, w_pos) / 100.0 * {L.FUZZY_SCALE} AS match_score
  FROM fz_win JOIN fz_ratio USING (kw, chunk)
  WHERE ratio >= {threshold} GROUP BY document_id, keyword_id)"""


DN_DOCS = f"""dn_docs AS (SELECT * REPLACE ({country_norm('country')} AS country) FROM d_docs)"""

# Standard chain: docs, sources, lexicon, exact and fuzzy signals, flags, scores.
G_SIG = """g_sig AS (SELECT document_id, keyword_id, match_score FROM g_exact
  UNION ALL SELECT document_id, keyword_id, match_score FROM g_fuzzy)"""
SIGNAL_CHAIN = (D_DOCS, S_SRC, k_lex(), D_SEARCH, G_EXACT, fuzzy_ctes(), G_SIG)
SCORED_CHAIN = (*SIGNAL_CHAIN, D_SIDE, FLAGS, SCORED)
