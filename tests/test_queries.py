"""Every registered query with SQL against DuckDB on the smallest scale."""

import datetime
import os

import duckdb
import pytest

from pagewright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if hasattr(v, "quantize") else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_entry_survives_without_the_optional_operators(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("pagewright.llm"):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", refuse)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    try:
        assert not any(n.startswith("op") for n in entry.queries()) and len(entry.queries()) > 60
        assert entry.entry(spark).columns == ["chunk_id", "similarity", "toxic"]
    finally:
        sys.modules.pop("__spark_entry__", None)
