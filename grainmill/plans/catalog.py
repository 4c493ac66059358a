"""The registry of queries and the SQL they are checked against."""

from __future__ import annotations

from . import blending, built, composed, files, measure, text, training

MODULES = [text, blending, training, measure, files, composed, built]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
