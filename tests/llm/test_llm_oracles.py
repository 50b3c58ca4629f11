"""The training-data queries that have SQL give the rows that DuckDB gives."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from corpusloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = queries.QUERIES[name](spark, DIR), con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
