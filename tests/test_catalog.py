import math
import os

import duckdb
import pytest

from chainframe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Tested elsewhere on small chains.
SLOW = {"macrostate_memberships", "macrostate_memberships_crisp", "spectral_terminal_states"}
#: Names that stand for the same function count once.
NAMES = list({f: name for name, f in reversed(QUERIES.items()) if name not in SLOW}.values())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    assert rows
    if name in ORACLE_SQL:
        result = duck.sql(ORACLE_SQL[name])
        at = [result.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=str)
