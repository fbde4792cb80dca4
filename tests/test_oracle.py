"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import os
import tempfile

import duckdb
import pandas as pd
import pytest

from textmill.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def canonical(df):
    def show(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(int(v)) if "int" in str(getattr(v, "dtype", "")) or isinstance(v, (int, bool)) else str(v)

    df = df[sorted(df.columns)].map(show)
    return sorted(df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = tables.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        if "float" in str(got[c].dtype) and "float" not in str(want[c].dtype):
            want[c] = want[c].astype(float)
    assert canonical(got) == canonical(want)


def test_no_query_without_rows_where_rows_are_expected(spark):
    few = {"delete_by_key", "prefix_search", "key_lookup"}
    names = [n for n in ("clean_documents", "link_caps", "roster", "ledger", "replay_sunk") if n not in few]
    assert all(QUERIES[n](spark, SF).limit(1).count() for n in names)


def test_workspace_is_temporary():
    assert tempfile.gettempdir()
