"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidegate.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(x):
    return "~" if x is None or x != x else f"{x:.4f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in result.description]
    want = sorted(tuple(norm(row[names.index(c)]) for c in sorted(names)) for row in result.fetchall())
    assert columns == sorted(names)
    assert got == want
    assert len({t[1] for t in df.dtypes} & {"void"}) == 0


def test_the_rest_has_rows(spark):
    for name in catalogue.QUERIES.keys() - catalogue.ORACLES.keys():
        assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_delta_bounds_are_pushed(spark):
    plan = catalogue.QUERIES["delta_window"](spark, DATA)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert "event_type" not in plan.split("ReadSchema")[1].split("\n")[0]
