"""Queries of the corpus operators against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera.llm.registry import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        return sorted(str([None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x for x in r]) for r in df[columns].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)
