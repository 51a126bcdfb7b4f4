"""Date parsing and calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def _one(c: Column, fmt: str) -> Column:
    if fmt == "rfc822":
        # Spark cannot parse day names ('EEE'); drop "Mon, " first.
        body = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "")
        return F.coalesce(F.try_to_timestamp(body, F.lit("dd MMM yyyy HH:mm:ss Z")),
                          F.try_to_timestamp(body, F.lit("dd MMM yyyy HH:mm:ss z")))
    return F.try_to_timestamp(c, F.lit(fmt))


def parse_date_any(c, formats: list[str], default: Column | None = None) -> Column:
    """First format that parses wins; otherwise ``default`` (NULL if None).
    'rfc822' stands for RFC-822 dates with a leading day name."""
    c = col_(c)
    ts = F.coalesce(*[_one(c, f) for f in formats]) if len(formats) > 1 else _one(c, formats[0])
    out = F.to_date(ts)
    return F.coalesce(out, default) if default is not None else out


def to_date_safe(c, fmt: str = "yyyy-MM-dd") -> Column:
    """Bad values become NULL instead of failing the job (ANSI mode)."""
    return F.try_to_date(col_(c), fmt)
