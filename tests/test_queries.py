"""Every query of the catalogue against its SQL on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from millrace.plans import catalogues

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for c in catalogues() for k, v in c.queries.items()}
ORACLES = {k: v for c in catalogues() for k, v in c.oracles.items()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(df: pd.DataFrame) -> list:
    def value(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return ""
        return str(round(float(x), 6)) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    return sorted(tuple(value(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    out = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        expected = duck.execute(ORACLES[name]).df()
        assert sorted(out.columns) == sorted(expected.columns)
        assert plain(out) == plain(expected)
    else:
        assert len(out.columns) > 0
