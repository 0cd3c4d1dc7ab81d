"""Every registered query of the core against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tests.conftest import SMOKE
from veilframe import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SMOKE)
    rel = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(rel.columns, rel.fetchall())


def test_all_have_sql():
    assert set(Q.QUERIES) == set(Q.ORACLE_SQL)
