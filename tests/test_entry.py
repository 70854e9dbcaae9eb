"""The driver's entry points, and every query against its SQL."""

from __future__ import annotations

import builtins
import importlib
import math
import sys

import duckdb
import pytest

import __spark_entry__
from orbweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, float):
        return repr(float(x))
    return repr([plain(y) for y in x]) if isinstance(x, list | tuple) else repr(x)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    names = sorted(got.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert names == sorted(columns)
    want = sorted([plain(dict(zip(columns, r, strict=True))[n]) for n in names] for r in found.fetchall())
    assert sorted([plain(r[n]) for n in names] for r in got.collect()) == want


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["frame", "particle", "dim", "delta"]


def test_results_only(spark, sf):
    rows = catalog.queries()["container_sizes"](spark, sf).collect()
    assert rows and all(r["bytes"] > 0 for r in rows)


def test_without_the_llm_parts(monkeypatch):
    """The rest must import and work when the subpackage and the pipeline are gone."""
    real = builtins.__import__

    def gone(name, *a, **k):
        if name.startswith(("orbweave.llm", "corpus_pipeline")) or name == "orbweave.llm" or (a and a[2] and name == "orbweave" and "llm" in a[2]):
            raise ModuleNotFoundError(f"No module named {name!r}", name="orbweave.llm" if "llm" in name or name == "orbweave" else name)
        return real(name, *a, **k)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("orbweave.llm") or k in ("corpus_pipeline", "__spark_entry__")}
    monkeypatch.setattr(builtins, "__import__", gone)
    try:
        entry = importlib.import_module("__spark_entry__")
        assert set(entry.queries()) == set(catalog.queries())
        assert set(entry.oracle_sql()) == set(catalog.oracle_sql())
    finally:
        sys.modules.update(kept)
