"""The operators' queries against their SQL over whole tables."""

import duckdb
import pytest

from palimpsest.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    at = [want.columns.index(c) for c in cols]
    rows = [tuple(r) for r in got.select(*cols).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_removal_sql_on_hard_texts():
    """Null and empty texts, overlapping and touching spans, characters of several bytes, repeats within one text."""
    a, b = "".join(chr(97 + i * i % 23) + str(i) for i in range(150)), "é\U0001f600" * 60
    texts = [None, "", a, "x" + a + "y", b, a[:199], a[:200] + a[:200], "z" * 1500]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    import hashlib
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for doc_id, n, removed, spans, digest in con.sql(ORACLE_SQL["op2_suffix_dedup"]).fetchall():
        t = raw[doc_id]
        gone = [False] * n
        for i in range(n - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        assert n == len(t) and removed == sum(gone)
        assert spans == sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert digest == hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()
