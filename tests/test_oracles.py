"""Every query that has oracle SQL against DuckDB at sf0.001; the others at least run."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from dialogmill import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 8)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


SLOW = {"stream_failed_queue", "stream_ingest"}


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in SLOW])
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    got = con.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(x[names.index(c)]) for c in cols)) for x in got.fetchall())
    assert rows == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
