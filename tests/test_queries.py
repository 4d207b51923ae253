"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tracemill.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "orders documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def _canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(plain(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    sql = entry.oracle_sql().get(name)
    if sql:
        expected = duck.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(expected.columns)
        assert _canonical(got) == _canonical(expected)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["example_id", "rollout_id", "reward", "label"] and df.count() == 1500
