"""Queries of the corpus operators against their SQL twins, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sparkloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = con.sql(registry.oracle_sql()[name]).df()
    found = registry.queries()[name](spark, SF).toPandas()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    ordered = [x[columns].sort_values(columns).reset_index(drop=True) for x in (found, wanted)]
    pd.testing.assert_frame_equal(*ordered)
