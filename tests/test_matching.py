"""The title match against all pairs by brute force: whole texts, the whole pool."""

import random

import pytest

from palimpsest.functions.similarity import indel_ratio
from palimpsest.operators import matching


@pytest.mark.parametrize("chunk", [1024, 3])
def test_edition_titles(spark, tmp_path, monkeypatch, chunk):
    import __spark_entry__

    monkeypatch.setattr(matching, "OLD_CHUNK", chunk)
    monkeypatch.setattr(matching, "NEW_BLOCK", max(2, chunk // 4))
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    head, tail = text(60), text(100)
    items = [head + text(100), "zz" + tail, head + tail, text(80), "", "wwww"]
    lines = [head + text(100), "qq" + tail, head + tail, tail, "vv" + text(30), "", None, head + tail, text(500), "vv" + text(30)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, None if x is None else f"{x}\nsecond line") for i, x in enumerate(lines)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, a in enumerate(items):
        exact = [j for j, b in enumerate(lines) if a and b == a]
        best = min(((-indel_ratio(a, b), j) for j, b in enumerate(lines) if a and b), default=(0, None))
        if exact:
            want |= {(i, j, "exact", 1.0, n) for n, j in enumerate(exact, 1)}
        elif -best[0] >= 0.405:
            want.add((i, best[1], "similar", -best[0], 1))
        else:
            want.add((i, None, "none", None, 1))
    got = {tuple(x) for x in __spark_entry__.queries()["match_edition_titles"](spark, str(tmp_path)).select("id", "old_id", "tier", "score", "rank").collect()}
    assert got == want
    assert {x[2] for x in got} == {"exact", "similar", "none"}


def test_many_common_subsequences():
    """Side by side, over the edges of words of bits, as one by one."""
    import numpy as np

    from palimpsest.functions.similarity import lcs_length, lcs_lengths

    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcde") for _ in range(n))
    firsts, others = [text(n) for n in (1, 62, 63, 64, 126, 127, 63, 200)], [text(n) for n in (1, 5, 63, 64, 130, 300, 62, 63)] + ["zzz"]
    coded = lambda t: np.array([ord(c) - 97 for c in t])
    lengths = np.array([len(t) for t in others])
    columns = np.zeros((lengths.max(), len(others)), np.uint8)
    for i, t in enumerate(others):
        columns[: len(t), i] = coded(t)
    first, other = (x.ravel() for x in np.meshgrid(np.arange(len(firsts)), np.arange(len(others))))
    got = lcs_lengths([coded(t) for t in firsts], columns, lengths, first, other)
    assert got.tolist() == [lcs_length(firsts[i], others[j]) for i, j in zip(first, other)]
    assert not len(lcs_lengths([coded(t) for t in firsts], columns, lengths, first[:0], other[:0]))


def test_blocks_are_scored_side_by_side(monkeypatch):
    """The pairs of a row of blocks are scored in two goes, not in some for each new key."""
    import pyarrow as pa

    calls, real = [], matching.lcs_lengths
    monkeypatch.setattr(matching, "lcs_lengths", lambda *a: calls.append(1) or real(*a))
    r = random.Random(7)
    rows = lambda many: [{"id": i, "k": "".join(r.choice("abcdefgh水") for _ in range(r.randint(1, 90)))} for i in range(many)]
    news, olds = rows(40), rows(150)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.float64())])
    batch = pa.RecordBatch.from_pydict({"block": [0, 0], "news": [news, news], "olds": [olds[:60], olds[60:]]})
    got = {row for b in matching._best(iter([batch]), 0.405, schema.names, schema) for row in zip(*(c.to_pylist() for c in b.columns))}
    best = {new["id"]: min((-indel_ratio(new["k"], old["k"]), old["id"]) for old in olds) for new in news}
    assert got == {(i, j, -s) for i, (s, j) in best.items() if -s >= 0.405} and len(got) > 20
    assert len(calls) <= 4
