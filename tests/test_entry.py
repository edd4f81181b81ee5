import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def _plain(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return "None"
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return str(int(v)) if math.isfinite(v) and v == int(v) else repr(round(v, 9))
    return str(v)


@pytest.fixture(scope="module")
def sql():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def _names():
    from sedge.plans import core_queries, reference_queries

    return [*reference_queries.QUERIES, *core_queries.QUERIES]


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, sql, name):
    import __spark_entry__ as e

    got = e.queries()[name](spark, DATA).toPandas()
    twin = e.oracle_sql().get(name)
    if twin is None:
        assert len(got) > 0 and not got.isna().all(axis=None)
        return
    want = sql.sql(twin).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (sorted(tuple(map(_plain, r)) for r in x[columns].itertuples(index=False, name=None)) for x in (got, want))
    assert a == b
