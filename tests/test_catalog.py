"""Every registered query of the core beside its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from umbra.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _value(x):
    return ("nan" if math.isnan(x) else f"{x:.9g}") if isinstance(x, float) else repr(x) if x is None or isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_twin(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(catalog.oracle_sql()[name])
    at = sorted(range(len(want.description)), key=lambda i: want.description[i][0])
    assert columns == [want.description[i][0] for i in at]
    rows = sorted(tuple(map(_value, r)) for r in got.select(columns).collect())
    assert rows == sorted(tuple(_value(r[i]) for i in at) for r in want.fetchall())
