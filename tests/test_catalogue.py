"""Every query of the library with SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(frame):
    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) or type(x).__name__ in ("Decimal", "int64", "int32", "float64", "bool") else str(x)

    names = sorted(frame.columns)
    return names, sorted(([plain(x) for x in r] for r in frame[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    mine = rows(catalogue.queries()[name](spark, FOLDER).toPandas())
    other = rows(duck.execute(catalogue.oracle_sql()[name]).df())
    assert mine[0] == other[0]
    assert len(mine[1]) == len(other[1])
    for a, b in zip(mine[1], other[1], strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_runs_whole(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
