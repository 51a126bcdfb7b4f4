"""Dictionary classification and entity extraction.

Dictionaries are small, ordered literal lists (config), so every operator
here is a single native expression evaluated inside the scan stage: an array
of ``CASE`` results compacted to the labels that fired. No UDF, no join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col_, first_rule


def _any_contains(t: Column, terms: list[str]) -> Column:
    cond = None
    for term in terms:
        c = t.contains(term)
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False))


def classify_multi(text, rules: list[tuple[str, list[str]]], default: str | None,
                   lower: bool = True) -> Column:
    """Every label whose terms occur, in dictionary order; none -> [default]."""
    t = F.lower(col_(text)) if lower else col_(text)
    hits = F.array_compact(F.array(*[F.when(_any_contains(t, terms), F.lit(label))
                                     for label, terms in rules]))
    if default is None:
        return hits
    # the hits are worked out once, as the element of an array, and used twice
    return F.get(F.transform(F.array(hits), lambda h: F.when(F.size(h) == 0, F.array(F.lit(default))).otherwise(h)), 0)


def classify_first(text, rules: list[tuple[str, list[str]]], default: str | None,
                   lower: bool = True, max_chars: int | None = None) -> Column:
    """First rule (in order) with a contained term, else default.
    ``max_chars`` cuts the input first (e.g. titles cut to 90 characters)."""
    t = col_(text)
    if max_chars:
        t = F.substring(t, 1, max_chars)
    return first_rule(t, rules, default, lower)


def extract_entities(text, mapping: dict[str, str], exclude_suffix: str | None = "(region)",
                     lower: bool = True) -> Column:
    """Sorted distinct set of mapped entities whose key occurs in the text."""
    t = F.lower(col_(text)) if lower else col_(text)
    items = [(k, v) for k, v in mapping.items()
             if not (exclude_suffix and v.endswith(exclude_suffix))]
    arr = F.array(*[F.when(t.contains(k), F.lit(v)) for k, v in items])
    return F.array_sort(F.array_distinct(F.array_compact(arr)))


def group_entities(arr, groups: dict[str, str], default: str = "Other") -> Column:
    """Entity -> group, distinct sorted groups per row (default for unknown)."""
    m = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.lit(v))])
    return F.array_sort(F.array_distinct(
        F.transform(col_(arr), lambda e: F.coalesce(F.element_at(m, e), F.lit(default)))))


def post_type(url, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Classify by URL pattern, ordered."""
    return first_rule(url, rules, default, lower=True)


def doc_kind(source_name, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Kind from a substring of the source name."""
    return first_rule(source_name, rules, default, lower=True)
