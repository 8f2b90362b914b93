import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from turnmill.plans import catalog


def _value(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, list):
        return [_value(x) for x in v]
    return {k: _value(x) for k, x in v.items()} if isinstance(v, dict) else str(v)


@pytest.fixture(scope="session")
def duck(tiny):
    c = duckdb.connect()
    for p in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, tiny, duck, name):
    df = catalog.QUERIES[name](spark, tiny)
    cur = duck.execute(catalog.ORACLE[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str([_value(r[cols.index(c)]) for c in sorted(cols)]) for r in cur.fetchall())
    got = sorted(str([_value(r[c]) for c in sorted(cols)]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, tiny, name):
    assert catalog.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
