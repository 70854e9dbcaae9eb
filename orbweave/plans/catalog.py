"""The registered queries on the driver tables, and their SQL."""

from __future__ import annotations

from . import codecs, relational


def queries() -> dict:
    return {n: q.run for n, q in (relational.QUERIES | codecs.QUERIES).items()} | codecs.RESULTS_ONLY


def oracle_sql() -> dict:
    return {n: q.sql for n, q in (relational.QUERIES | codecs.QUERIES).items()}
