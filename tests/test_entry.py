"""Every registered query runs, and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


def value(x):
    if x is None or isinstance(x, (str, bytes)):
        return x
    if hasattr(x, "__len__"):
        return [value(v) for v in x]
    try:
        return None if float(x) != float(x) else round(float(x), 5)
    except (TypeError, ValueError):
        return str(x)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_core_and_llm_are_apart():
    for folder, _, names in os.walk("lumika"):
        if "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "lumika.llm" not in f.read()


def test_the_flagship_query(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n == "p7_found" or not n.startswith("p") or not n[1].isdigit()])
def test_query_agrees_with_its_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    rows = sorted(repr([value(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    if name in entry.oracle_sql():
        found = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        assert rows == sorted(repr([value(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
