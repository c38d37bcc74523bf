"""Each core query on the smallest tables against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
            return None
        return x if not isinstance(x, float) else int(x) if x == int(x) else round(x, 9)

    return sorted((tuple(str(plain(x)) for x in r) for r in df[sorted(df.columns)].astype(object).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), db.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
