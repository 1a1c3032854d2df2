"""Every query with SQL gives DuckDB's rows, names and types."""

import math
import os

import duckdb
import pytest

from kinfold.plans.queries import QUERIES, SQL

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v if math.isinf(v) or v != int(v) else int(v)
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE " + SQL[name]).fetchall()}
    assert columns == sorted(kinds)
    assert {c: KINDS[t] for c, t in found.dtypes} == kinds
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({SQL[name]})").fetchall()
    assert ordered(found.select(*columns).collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
