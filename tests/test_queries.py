"""Every registered query against its SQL in DuckDB."""

import importlib
import math

import duckdb
import pytest

from skytables.plans.registry import REGISTRY

entry = importlib.import_module("__spark_entry__")
DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(map(text, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(text, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_entry(spark):
    assert {r.kind for r in entry.entry(spark).collect()} == {"fixed", "sso"}
