"""Lexicon matching: documents x keywords -> signals, and document flags.

Plan shape: the lexicon, whatever its size, is one array in one row that is
joined to the documents once. All matching happens inside a document's row:
exact hits are a ``filter`` over the terms, fuzzy hits compare the row's own
word windows. No window rows, no shuffle; the flags that matches and types
set are expressions of the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import bind, fuzzy_budget, fuzzy_edits, fuzzy_possible, indel_ratio, search_text, single_spaced, words
from ..session import spread

SIGNAL_COLS = ("document_id", "keyword_id", "match_score", "match_kind")


def lexicon_row(K: DataFrame, threshold: float = L.FUZZY_THRESHOLD) -> DataFrame:
    """The active lexicon as one row: an array of its terms in id order, with
    what fuzzy hits of the threshold need of them."""
    kw = F.lower("keyword")
    act = K.filter(F.coalesce(F.col("active"), F.lit(True)))
    term = F.struct(F.col("keyword_id").cast("int").alias("keyword_id"), kw.alias("kw"),
                    F.size(words(kw)).alias("n"), F.length(kw).alias("len"), F.col("level").cast("int").alias("level"), "cluster")
    row = act.agg(F.sort_array(F.collect_list(term)).alias("terms"))
    return row.withColumn("terms", F.transform("terms", lambda t: with_fit(t, threshold))) if threshold > 0 else row


def _hit(t: Column, score: Column, kind: str) -> Column:
    return F.struct(t["keyword_id"].alias("keyword_id"), t["kw"].alias("kw"), t["level"].alias("level"),
                    t["cluster"].alias("cluster"), score.alias("match_score"), F.lit(kind).alias("match_kind"))


def held_terms(text: Column, terms: Column) -> Column:
    """``terms`` with ``held``: the text contains it (looked for once, for exact and fuzzy hits)."""
    return F.transform(terms, lambda t: t.withField("held", text.contains(t["kw"])))


def exact_hits(text: Column, terms: Column, head: int = L.EXACT_HEAD_CHARS) -> Column:
    """M1: ``held_terms`` contained in the text; 9.5 inside its head, else 8.0."""
    return F.transform(
        F.filter(terms, lambda t: t["held"]),
        lambda t: _hit(t, F.when(F.substring(text, 1, head).contains(t["kw"]), F.lit(L.EXACT_HEAD_SCORE))
                       .otherwise(F.lit(L.EXACT_BODY_SCORE)), "exact"))


def with_fit(t: Column, threshold: float) -> Column:
    """A term with ``fit``, null for terms that have no fuzzy hits: ``edits`` that
    the threshold allows a window of each length (up to ``top``, which is too
    long), and for these edits the term cut into one part more (``parts``), so
    that they leave a part whole. Lengths that do not fit have no parts."""
    none = F.greatest(fuzzy_budget(t["len"], threshold), F.lit(0)) + 1

    def allowed(n):
        k = fuzzy_edits(t["len"], n, threshold)
        return F.when(F.abs(t["len"] - n) <= k, k).otherwise(none)

    def parts(edits):
        def of(k):
            def cut(i):
                return F.floor(i * t["len"] / (k + 1)).cast("int")
            whole = F.transform(F.sequence(F.lit(0), k), lambda i: F.substring(t["kw"], cut(i) + 1, cut(i + 1) - cut(i)))
            return F.when((k < none) & F.array_contains(edits, k), whole).otherwise(F.array().cast("array<string>"))
        return F.transform(F.sequence(F.lit(0), none), of)

    fit = bind(F.transform(F.sequence(F.lit(0), t["len"] + none), allowed), lambda edits: F.struct(
        (F.size(edits) - 1).alias("top"), edits.alias("edits"), parts(edits).alias("parts")))
    return t.withField("fit", F.when(t["n"] >= L.FUZZY_MIN_TERM_WORDS, fit))


def fitting(chunks: Column, kw: Column, fit: Column) -> Column:
    """The windows that hold a part of the term and are within the edits of their length."""
    def of(edits, parts, top):
        def held(c):
            k = F.get(edits, F.least(F.length(c), top))
            return F.exists(F.get(parts, k), lambda p: c.contains(p)) & (F.call_function("levenshtein", kw, c, k) >= 0)
        return F.filter(chunks, held)
    return bind(fit["edits"], lambda edits: bind(fit["parts"], lambda parts: bind(fit["top"], lambda top: of(edits, parts, top))))


def fuzzy_hits(text: Column, terms: Column, threshold: float = L.FUZZY_THRESHOLD,
               max_words: int | None = None) -> Column:
    """M2: for ``held_terms`` of three words or more without an exact hit, the
    first non-overlapping window of as many words (start 0, step n) whose ratio
    reaches the threshold; it scores ratio / 100 * 7.

    Windows are cut from the text in one pass, without an array of its words. A
    window's length gives the edits that the ratio allows; it must hold one of
    the term's parts, one part more than these edits, before the edit distance
    is worked out, and only what is left meets the ratio.

    ``max_words`` limits the words that are looked at (off by default).
    """
    def windows(spaced):
        """For each window size that a term needs: its windows."""
        def of(n):
            pattern = F.concat(F.lit(r"\G ?([^ ]+(?: [^ ]+){"), (n - 1).cast("string"), F.lit("}+)"))
            chunks = F.regexp_extract_all(spaced, pattern, F.lit(1))
            if max_words:
                chunks = F.slice(chunks, 1, F.floor(F.lit(max_words) / n).cast("int"))
            return F.struct(n.alias("n"), chunks.alias("chunks"))
        return F.transform(F.array_distinct(F.transform(long_miss, lambda t: t["n"])), of)

    def hit(t, wins):
        chunks = F.get(F.filter(wins, lambda w: w["n"] == t["n"]), 0)["chunks"]
        if threshold > 0:
            chunks = fitting(chunks, t["kw"], t["fit"])
        near = F.filter(chunks, lambda c: fuzzy_possible(t["kw"], c, threshold, t["len"]))
        good = F.filter(F.transform(near, lambda c: indel_ratio(t["kw"], c)), lambda r: r >= threshold)
        return _hit(t, F.get(good, 0) / 100.0 * L.FUZZY_SCALE, "fuzzy")

    long_miss = F.filter(terms, lambda t: (t["n"] >= L.FUZZY_MIN_TERM_WORDS) & ~t["held"])
    spaced = single_spaced(F.when(F.size(long_miss) > 0, text))
    hits = bind(spaced, lambda x: bind(windows(x), lambda wins: F.transform(long_miss, lambda t: hit(t, wins))))
    return F.filter(hits, lambda h: h["match_score"].isNotNull())


def with_hits(docs: DataFrame, K: DataFrame, exact: bool = True, fuzzy: bool = True,
              threshold: float = L.FUZZY_THRESHOLD, cap: int | None = None,
              max_words: int | None = None, head: int = L.EXACT_HEAD_CHARS,
              partitions: int | None = None) -> DataFrame:
    """``docs`` with ``hits``: every exact and fuzzy match of a document."""
    d = spread(docs, "document_id", partitions).crossJoin(F.broadcast(lexicon_row(K, threshold)))  # one row
    terms = F.col("terms")

    def hits(text):
        def of(known):
            parts = [exact_hits(text, known, head)] if exact else []
            if fuzzy:
                parts.append(fuzzy_hits(text, known, threshold, max_words))
            return F.concat(*parts) if len(parts) > 1 else parts[0]
        return bind(held_terms(text, terms), of)

    return d.withColumn("hits", bind(search_text("title", "full_text", cap), hits)).drop("terms")


def signals(matched: DataFrame, *cols: str) -> DataFrame:
    """One row per hit: the given columns and the hit's fields.

    An inner explode would let the optimizer infer that ``hits`` is not empty and
    push that, with the whole matching, below the matching itself: each text
    would be matched twice.
    """
    return matched.select(*cols, F.explode_outer("hits").alias("t")).filter(F.col("t").isNotNull()).select(
        *cols, "t.keyword_id", F.col("t.kw").alias("keyword"), "t.level", "t.cluster",
        "t.match_score", "t.match_kind")


def tag_exact(D: DataFrame, K: DataFrame, **options) -> DataFrame:
    """M1: exact lower-case substring hits."""
    return signals(with_hits(D, K, fuzzy=False, **options), "document_id").select(*SIGNAL_COLS)


def tag_fuzzy(D: DataFrame, K: DataFrame, **options) -> DataFrame:
    """M2: fuzzy hits of terms of three words or more."""
    return signals(with_hits(D, K, exact=False, **options), "document_id").select(*SIGNAL_COLS)


def tag(D: DataFrame, K: DataFrame, fuzzy: bool = True, **options) -> DataFrame:
    """M4: signals = exact hits and fuzzy hits, one row per (doc, keyword)."""
    g = signals(with_hits(D, K, fuzzy=fuzzy, **options), "document_id").select(*SIGNAL_COLS)
    return g.withColumn("sentiment", F.lit("neutral"))


# ------------------------------------------------------------------ flags --
def match_flags(hits: str = "hits") -> dict[str, Column]:
    """M5: flags that a row's matches set."""
    def level(lv):
        return F.exists(hits, lambda t: t["level"] == lv)

    out = {name: level(lv) for lv, name in L.LEVEL_FLAGS.items()}
    out["is_diga"] = F.exists(hits, lambda t: t["cluster"].isin(*L.DIGA_CLUSTERS))
    return out


def type_flags(doc_type: str = "document_type", source_type: str = "source_type") -> dict[str, Column]:
    """M6: flags that a row's document type and source type set."""
    st = F.coalesce(F.col(source_type), F.lit(""))
    dt = F.lower(F.coalesce(F.col(doc_type), F.lit("")))

    def any_in(terms):
        c = F.lit(False)
        for t in terms:
            c = c | dt.contains(t)
        return c

    return {"is_scientific": (st == "scientific") | dt.isin("journal_article", "clinical_trial"),
            "is_regulatory": st.isin("regulatory", "hta") | any_in(L.DOC_TYPE_FLAGS["regulatory"]),
            "is_parliamentary": (st == "parliamentary") | any_in(L.DOC_TYPE_FLAGS["parliamentary"])}


def child_flags(kind: str = "child_kind", neuro: str = "child_neuro", digital: str = "child_digital",
                title: str = "title", text: str = "full_text") -> dict[str, Column]:
    """M7: flags that a document's child record sets.

    ``kind``: decision (reimbursement and regulatory; diga if digital, neuro
    if so marked), app (regulatory, reimbursement and diga; neuro if so
    marked) or paper (parliamentary; diga and reimbursement by terms in its
    title and text); null where there is no child record.
    """
    k = F.col(kind)
    both = F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit(""))))

    def any_in(terms):
        c = F.lit(False)
        for t in terms:
            c = c | both.contains(t)
        return c

    decision, app, paper = k.eqNullSafe("decision"), k.eqNullSafe("app"), k.eqNullSafe("paper")
    yes = {c: F.coalesce(F.col(c), F.lit(False)) for c in (neuro, digital)}
    return {"is_regulatory": decision | app, "is_parliamentary": paper,
            "is_reimbursement": decision | app | (paper & any_in(L.PAPER_REIMBURSEMENT_TERMS)),
            "is_diga": app | (decision & yes[digital]) | (paper & any_in(L.PAPER_DIGA_TERMS)),
            "is_neuro": (decision | app) & yes[neuro]}


def merged_flags(*parts: dict[str, Column]) -> list[Column]:
    """M8: each flag is set if any part sets it; a missing one is false."""
    out = []
    for name in L.FLAG_NAMES:
        c = F.lit(False)
        for p in parts:
            if name in p:
                c = c | F.coalesce(p[name], F.lit(False))
        out.append(c.alias(name))
    return out


def with_source_type(D: DataFrame, S: DataFrame) -> DataFrame:
    return D.join(S.select("source_id", "source_type"), "source_id", "left")


def document_flags(D: DataFrame, S: DataFrame, K: DataFrame, children: bool = False, **options) -> DataFrame:
    """Flags of every document: matches, type rules and (``children``: D has
    child_kind, child_neuro, child_digital) child records, in one row pass."""
    cols = ["document_id", "source_type", "document_type", "hits"]
    if children:
        cols += ["title", "full_text", "child_kind", "child_neuro", "child_digital"]
    m = with_source_type(with_hits(D, K, **options), S).select(*cols)
    parts = [match_flags(), type_flags()] + ([child_flags()] if children else [])
    return m.select("document_id", *merged_flags(*parts))


def flags_from_matches(D: DataFrame, K: DataFrame, **options) -> DataFrame:
    """M5: flags of documents with a match."""
    m = with_hits(D, K, **options).filter(F.size("hits") > 0)
    return m.select("document_id", *[c.alias(n) for n, c in match_flags().items()])


def flags_from_type(D: DataFrame, S: DataFrame) -> DataFrame:
    """M6: flags from document type and source type (lower-cased type)."""
    return with_source_type(D, S).select("document_id", *[c.alias(n) for n, c in type_flags().items()])


def normalize_country(c, aliases: dict | None = None):
    """P10: case-insensitive alias lookup; unknown values kept as they are."""
    aliases = L.COUNTRY_ALIASES if aliases is None else aliases
    m = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (c == ""), c).otherwise(F.coalesce(m[F.lower(c)], c))


def untagged(D: DataFrame, K: DataFrame, **options) -> DataFrame:
    """Documents without any signal."""
    return with_hits(D, K, **options).filter(F.size("hits") == 0).drop("hits")
