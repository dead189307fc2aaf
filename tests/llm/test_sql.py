import os

import duckdb
import pytest

from chainframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    found = QUERIES[name](spark, folder)
    result = con.sql(ORACLE_SQL[name])
    at = [result.columns.index(c) for c in found.columns]
    assert sorted(result.columns) == sorted(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[k] for k in at) for r in result.fetchall())
