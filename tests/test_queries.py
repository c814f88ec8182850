"""Every query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from estatum import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, folder, duck, name):
    df = queries.QUERIES[name](spark, folder)
    twin = duck.execute(queries.SQL[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(twin.fetchall(), [c[0] for c in twin.description])
