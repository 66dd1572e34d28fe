"""Every ledger query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tallyspark import queries

DATA = Path("/root/testdata/sf0.001")


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.date
    return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def db():
    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, db, name):
    found = queries.QUERIES[name](spark, str(DATA)).toPandas()
    if name in queries.ORACLE_SQL:
        want = db.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert plain(found) == plain(want)
    else:
        assert len(found)
