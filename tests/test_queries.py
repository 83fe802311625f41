import os

import duckdb
import pytest

from pagestrata.plans import registry

DATA = "/root/testdata/sf0.001"


def same(value):
    return None if value is None else round(value, 5) if isinstance(value, float) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([same(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    own = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(registry.ORACLE_SQL[name])
    assert own == rows([d[0] for d in cursor.description], cursor.fetchall())
