"""Every query of the catalogue beside its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from glyphmill.plans import load
from glyphmill.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_imports_without_session():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
