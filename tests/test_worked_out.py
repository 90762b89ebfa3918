"""Small cases with values worked out by hand, through the library's operators."""

import importlib

import duckdb
import pytest
from worked_out import CASES

from test_entry import plain

for part in ("titles", "pages", "contents", "matches", "records", "reviews"):
    importlib.import_module(f"worked_out.{part}")


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    f, sql = CASES[name]
    got = f(spark, None)
    cols = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=repr)
    if sql is None:
        assert rows
        return
    want = duckdb.sql(sql)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
