"""Every registered query of the library against its SQL form on DuckDB."""

import duckdb
import pandas as pd
import pytest

from scrivana.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return str(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, small, name):
    ours, theirs = catalog.queries()[name](spark, small).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_runs():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert all(isinstance(q, str) for q in entry.oracle_sql().values())
