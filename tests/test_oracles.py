"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans import registry

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DIR), duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = Counter(tuple(plain(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    b = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b, f"only Spark: {list((a - b).items())[:3]}, only SQL: {list((b - a).items())[:3]}"
