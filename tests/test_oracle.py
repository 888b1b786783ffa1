"""Every registered query against its SQL in the other engine, whole tables."""

import decimal

import duckdb
import pandas as pd
import pytest

from pricewright import queries as retail

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else str(v)

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(retail.SQL))
def test_same_rows(spark, sf, con, name):
    got, want = retail.QUERIES[name](spark, sf).toPandas(), con.execute(retail.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(retail.QUERIES) - set(retail.SQL)))
def test_runs(spark, sf, name):
    assert retail.QUERIES[name](spark, sf).count() > 0
