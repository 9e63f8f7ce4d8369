"""Every registered query of the outbox against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidegate import oracle
from tidegate.queries import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def _told(rows):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, DIR)
    cols = sorted(df.columns)
    found = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert _told(df.select(*cols).collect()) == _told(tuple(r[i] for i in at) for r in found.fetchall())
