"""Every registered query of the engine against its DuckDB SQL."""
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from trellis import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _same(a, b):
    if isinstance(a, (float, Decimal)) and isinstance(b, (float, Decimal)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.SQL.keys()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    left = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    right = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert len(left) == len(right)
    assert all(_same(x, y) for a, b in zip(left, right, strict=True) for x, y in zip(a, b, strict=True))
