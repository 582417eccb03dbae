"""Every query with a DuckDB text, against it, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from segue.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (not isinstance(x, (list, tuple)) and not hasattr(x, "__len__") and pd.isna(x)):
        return "-"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{round(x, 6) + 0.0:.6f}"
    if isinstance(x, int) or hasattr(x, "dtype") and x.ndim == 0:
        return f"{float(x):.6f}"
    if hasattr(x, "tolist") or isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return str(x)


def rows(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
