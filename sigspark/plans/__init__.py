"""Registered queries (one per operator / page result set) and their oracles."""

from __future__ import annotations

from .registry import ORACLE, QUERIES

_MODULES = ("signals", "relational", "text", "series", "ingest", "streams", "pages")


def _load():
    import importlib
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracle_sql():
    _load()
    return dict(ORACLE)
