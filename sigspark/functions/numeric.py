"""Numeric helpers shared by queries and their oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c, digits: int = 4) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d.

    Written with plain IEEE operations (no decimal conversion) so that any
    engine computing the same double gets the same rounded double.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** digits)
    return F.floor(c * s + 0.5) / s


def rnd_sql(expr: str, digits: int = 4) -> str:
    s = float(10 ** digits)
    return f"(floor(({expr}) * {s} + 0.5) / {s})"
