"""Each registered query against its SQL twin, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quire.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "customer events documents embeddings pages benchmark conversations".split()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(df):
    return sorted((tuple(map(plain, x)) for x in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(own.queries()))
def test_query(spark, duck, name):
    got = own.queries()[name](spark, SF).toPandas()
    assert len(got)
    assert rows(got) == rows(duck.execute(own.oracle_sql()[name]).df())
