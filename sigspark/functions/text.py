"""Column expression builders for text (all native Spark expressions).

Lengths and substrings count code points, as Python slicing does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def search_text(title="title", body="full_text", cap: int | None = None) -> Column:
    """lower(title + ' ' + body); the body part is left out when empty.

    ``cap`` limits the body to its first characters (off by default).
    """
    b = col_(body)
    part = F.when(b.isNotNull() & (b != ""), F.substring(b, 1, cap) if cap else b)
    return F.lower(F.concat_ws(" ", F.coalesce(col_(title), F.lit("")), part))


def clip(c, n: int, ellipsis: str = "") -> Column:
    """Cut to n code points; append ``ellipsis`` only when something was cut."""
    c = col_(c)
    cut = F.substring(c, 1, n)
    if not ellipsis:
        return cut
    return F.when(F.length(c) > n, F.concat(cut, F.lit(ellipsis))).otherwise(c)


def words(c) -> Column:
    """Whitespace tokens, empty pieces dropped (Python ``str.split()``)."""
    return F.filter(F.split(col_(c), r"\s+"), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not once per use."""
    return F.get(F.transform(F.array(value), body), 0)


def single_spaced(c) -> Column:
    """Every run of whitespace as one blank, also at the ends.

    Line breaks are most of what is no blank; what is left to the (slower)
    pattern is looked for first.
    """
    blanks = F.replace(col_(c), F.lit("\n"), F.lit(" "))

    def squeezed(x):
        other = contains_any(x, ["  ", "\t", "\x0b", "\f", "\r"], lower=False)
        return F.when(other, F.regexp_replace(x, r"\s{2,}|[^\S ]", " ")).otherwise(x)
    return bind(blanks, squeezed)


def contains_any(text, terms: list[str], lower: bool = True) -> Column:
    """True when ``text`` contains any term; an empty list keeps every row."""
    if not terms:
        return F.lit(True)
    t = F.lower(col_(text)) if lower else col_(text)
    cond = None
    for term in terms:
        c = t.contains(term.lower() if lower else term)
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False))


def first_rule(text, rules: list[tuple[str, list[str]]], default: str | None,
               lower: bool = True) -> Column:
    """Ordered single-label classification: first rule with a contained term."""
    t = F.lower(col_(text)) if lower else col_(text)
    expr = None
    for label, terms in rules:
        cond = None
        for term in terms:
            c = t.contains(term)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


#: Bits of a block: a sum of two blocks and a carry stays a positive long.
LCS_BITS = 62


def lcs_length(a, b) -> Column:
    """Longest-common-subsequence length: one step of bit operations per
    character of ``b`` and block of 62 characters of ``a``.

    Bit i of the state is cleared when the subsequence grows at character i of
    ``a``; a step adds the places where ``a`` has the character to the state,
    with the carry going from block to block. No row of the table is kept.
    """
    a, b = col_(a), col_(b)
    la, lb = F.length(a), F.length(b)
    full = F.lit((1 << LCS_BITS) - 1)
    zero = F.lit(0).cast("long")
    chars = F.regexp_extract_all(b, F.lit("(?s)."), 0)
    own = F.regexp_extract_all(a, F.lit("(?s)."), 0)

    def places(part, c):
        """Bits of the places where the characters ``part`` are ``c``."""
        at = F.transform(part, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero))
        return F.aggregate(at, zero, lambda v, m: v.bitwiseOR(m))

    def masks(part):
        different = F.array_distinct(part)
        return F.map_from_arrays(different, F.transform(different, lambda c: places(part, c)))

    def in_block(table):
        def step(v, c):
            u = v.bitwiseAND(F.coalesce(F.try_element_at(table, c), zero))
            return (v + u).bitwiseOR(v - u).bitwiseAND(full)
        return F.aggregate(chars, full, step)

    def in_blocks(tables):
        def step(vs, c):
            def block(state, vm):
                u = vm["v"].bitwiseAND(F.coalesce(F.try_element_at(vm["m"], c), zero))
                total = vm["v"] + u + state["carry"]
                new = total.bitwiseOR(vm["v"] - u).bitwiseAND(full)
                return F.struct(F.array_append(state["vs"], new).alias("vs"), F.shiftright(total, LCS_BITS).alias("carry"))
            start = F.struct(F.array().cast("array<bigint>").alias("vs"), zero.alias("carry"))
            pairs = F.zip_with(vs, tables, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
            return F.aggregate(pairs, start, block, lambda s: s["vs"])
        return F.aggregate(chars, F.transform(tables, lambda _m: full), step)

    def cleared(v):
        return F.lit(LCS_BITS) - F.bit_count(v)

    # values that several steps use are worked out once, as the element of an array
    short = F.get(F.transform(F.array(masks(own)), lambda m: cleared(in_block(m))), 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((la - 1) / LCS_BITS).cast("int")),
                        lambda k: masks(F.slice(own, k * LCS_BITS + 1, LCS_BITS)))
    long = F.get(F.transform(F.array(parts), lambda ts: F.aggregate(
        in_blocks(ts), F.lit(0), lambda n, v: n + cleared(v))), 0)
    return F.when((la == 0) | (lb == 0), F.lit(0)).when(la <= LCS_BITS, short).otherwise(long)


def indel_ratio(a, b) -> Column:
    """100 * (1 - indel / (len a + len b)); indel = la + lb - 2 * LCS."""
    a, b = col_(a), col_(b)
    tot = F.length(a) + F.length(b)
    indel = tot - 2 * lcs_length(a, b)
    return F.when(tot == 0, F.lit(100.0)).otherwise((F.lit(1.0) - indel / tot) * 100.0)


def fuzzy_possible(a, b, threshold: float, la: Column | None = None, lb: Column | None = None) -> Column:
    """False when indel_ratio is provably below ``threshold``.

    ratio >= t  <=>  indel <= (1 - t/100) * (la + lb). Both |la - lb| and the
    Levenshtein distance are lower bounds of indel, so pairs failing either
    bound are dropped before the quadratic DP (exact, not a heuristic).
    ``la``, ``lb``: the lengths, where they are known.
    """
    a, b = col_(a), col_(b)
    la, lb = F.length(a) if la is None else la, F.length(b) if lb is None else lb
    budget = fuzzy_edits(la, lb, threshold)
    return (F.abs(la - lb) <= budget) & (F.call_function("levenshtein", a, b, budget) >= 0)


def fuzzy_edits(la: Column, lb: Column, threshold: float) -> Column:
    """The largest indel of strings of these lengths whose ratio reaches ``threshold``."""
    return F.floor((1.0 - threshold / 100.0) * (la + lb) + 1e-9).cast("int")


def fuzzy_budget(la: Column, threshold: float) -> Column:
    """The largest indel of a string of length ``la`` and any other one whose
    ratio reaches ``threshold`` (above 0).

    With s = 1 - threshold / 100, indel <= s * (la + lb) and lb <= la + indel,
    so indel <= 2 * s * la / (1 - s).
    """
    s = 1.0 - threshold / 100.0
    return F.floor(2.0 * s / (1.0 - s) * la + 1e-6).cast("int")


def html_to_text(c) -> Column:
    """Strip script/style blocks and tags, decode common entities, squeeze blanks."""
    x = col_(c)
    x = F.regexp_replace(x, r"(?is)<script\b.*?</script\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<style\b.*?</style\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                    ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def html_title(c) -> Column:
    return F.trim(F.regexp_extract(col_(c), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(c) -> Column:
    """href values of links, in double, single or no quotes."""
    raw = F.regexp_extract_all(col_(c), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), 1)
    return F.transform(raw, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))


def clean_url(c) -> Column:
    """Drop query string and fragment."""
    return F.regexp_replace(col_(c), r"[?#].*$", "")


def resolve_url(c, base: str) -> Column:
    """Relative link -> absolute against ``base`` (scheme://host)."""
    c = col_(c)
    b = base.rstrip("/")
    return F.when(c.startswith("http"), c) \
            .when(c.startswith("/"), F.concat(F.lit(b), c)) \
            .otherwise(F.concat(F.lit(b + "/"), c))


def url_host(c) -> Column:
    return F.regexp_extract(col_(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)


def content_hash(*cols, null_as: str = "None") -> Column:
    """sha256 hex of the concatenated fields (missing value rendered as text)."""
    parts = [F.coalesce(col_(c).cast("string"), F.lit(null_as)) for c in cols]
    return F.sha2(F.concat(*parts), 256)


def split_tags(c) -> tuple[Column, Column]:
    """'[Tags: a, b] rest' -> (array('a','b'), 'rest'); no prefix -> ([], text)."""
    c = col_(c)
    raw = F.regexp_extract(c, r"^\[Tags:\s*(.+?)\]", 1)
    tags = F.when(raw == "", F.array().cast("array<string>")) \
            .otherwise(F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)),
                                lambda t: t != ""))
    rest = F.trim(F.regexp_replace(c, r"^\[Tags:\s*.+?\]\s*", ""))
    return tags, rest


def join_tags(tags, text, max_tags: int = 5) -> Column:
    t = F.slice(col_(tags), 1, max_tags)
    return F.when(F.size(t) > 0,
                  F.concat(F.lit("[Tags: "), F.array_join(t, ", "), F.lit("] "), col_(text))) \
            .otherwise(col_(text))


def tokens(c, pattern: str = "[a-z]{3,}", stop: list[str] | None = None,
           min_len: int = 0, lower: bool = True) -> Column:
    """Regex tokens of (lower-cased) text minus stop words; duplicates kept."""
    x = F.lower(col_(c)) if lower else col_(c)
    toks = F.regexp_extract_all(x, F.lit(f"({pattern})"), 1)
    if stop or min_len:
        stop_arr = F.array(*[F.lit(s) for s in (stop or [])]) if stop else None

        def keep(w):
            k = F.length(w) > min_len if min_len else F.lit(True)
            if stop_arr is not None:
                k = k & ~F.array_contains(stop_arr, w)
            return k
        toks = F.filter(toks, keep)
    return toks


def affiliation_country(c, max_len: int = 95) -> Column:
    """Last comma part, trimmed, trailing '.' removed, cut to ``max_len``."""
    last = F.trim(F.element_at(F.split(col_(c), ","), -1))
    return F.substring(F.regexp_replace(last, r"\.+$", ""), 1, max_len)


def default(c, value: str) -> Column:
    """Python ``x or value``: NULL and '' both count as missing."""
    c = col_(c)
    return F.when(c.isNull() | (c == ""), F.lit(value)).otherwise(c)


def first_match(arr, pred, default=None) -> Column:
    """First element satisfying ``pred`` (a Column lambda), else default."""
    hit = F.get(F.filter(col_(arr), pred), 0)
    return F.coalesce(hit, F.lit(default)) if default is not None else hit


def contains_all_groups(text, groups: list[list[str]], lower: bool = True) -> Column:
    """every term group has at least one contained term."""
    cond = F.lit(True)
    for g in groups:
        cond = cond & contains_any(text, g, lower)
    return cond
