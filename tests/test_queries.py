"""Every registered query runs on the smallest tables, and gives the rows of its SQL."""

import collections
import math
import os

import pytest

import __spark_entry__ as entry

CORE = [n for n in entry.core.QUERIES]


@pytest.fixture(scope="session")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, (int, float)) or hasattr(v, "__float__"):
        return round(float(v), 5)
    return v


def rows(df):
    return collections.Counter(tuple(normal(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CORE)
def test_query(name, spark, sf_dir, duck):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_llm_is_used_by_nothing_else():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "quernstone")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "quernstone.llm" not in open(os.path.join(folder, f)).read(), f
