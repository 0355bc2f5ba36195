"""Every query against its SQL, on the same tables."""

import math

import duckdb
import pytest

from panoquarry.plans import queries, run_queries

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)  # some values are null


QUERIES, SQL = queries.QUERIES | run_queries.QUERIES, queries.SQL | run_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.sql(SQL[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_all_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(QUERIES) - set(SQL) == {"record_json"}
