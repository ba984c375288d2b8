"""Every catalogue query against its SQL in DuckDB, as the driver compares them."""

import duckdb
import pytest

from tessera import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings conversations"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(plans.QUERIES) == set(plans.SQL) and len(plans.QUERIES) >= 80


def test_operators_shown():
    shown = {i for ids in plans.OPERATORS.values() for i in ids}
    assert len(shown) >= 150


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert set(dict(df.dtypes).values()) <= set(TYPES)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(plans.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    assert got == want
