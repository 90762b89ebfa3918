"""Every SQL-backed query of the package against DuckDB on the smallest tables."""

import duckdb
import pytest

from palimpsest.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
