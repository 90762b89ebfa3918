"""Many patterns located in texts at once, and texts cut at the places of patterns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of patterns that one automaton holds; more patterns make more automata, and the texts are read once for each.
AUTOMATON = 4 << 20
#: Places that are sent on at once.
SENT = 50_000


@lru_cache(2)
def _automaton(patterns: tuple[tuple[int, str], ...]):
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for number, pattern in patterns:
        machine.add_word(pattern, (number, len(pattern)))
    if patterns:
        machine.make_automaton()
    return machine


def _places(batches: Iterator[pa.RecordBatch], patterns: tuple) -> Iterator[pa.RecordBatch]:
    machine = _automaton(patterns)
    for b in batches if patterns else ():
        kind = b.schema.field(0).type
        found: list[tuple] = []
        for text_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for end, (number, size) in machine.iter(text or ""):
                found.append((text_id, number, end - size + 1, size))
                if len(found) >= SENT:
                    yield _batch(found, kind)
                    found = []
        if found:
            yield _batch(found, kind)


def _batch(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip(zip(*found), (kind, pa.int64(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["text_id", "number", "at", "size"])


def located(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts (id, text) and patterns (id, pattern), under any names -> text id, pattern id, at (from 0), size: every place where a pattern stands in a text, in characters; overlapping places too.

    One automaton (Aho-Corasick) goes over each text once, whatever the number of patterns; patterns beyond AUTOMATON
    characters are dealt to several automata by a hash, so that what a task holds and what is sent to it is bounded. Equal patterns are searched once. Null and empty texts and patterns are nowhere; repeated text
    ids give repeated rows.
    """
    (tid, t), (pid, p) = texts.columns, patterns.columns
    named = patterns.filter(F.col(p) != "").select(F.col(pid).alias("pattern_id"), F.xxhash64(p).alias("number"), F.col(p).alias("p"))
    wanted = named.select("number", "p").distinct()
    total = wanted.agg(F.sum(F.length("p"))).first()[0] or 0
    groups = 1 if total <= AUTOMATON else -(-2 * total // AUTOMATON)
    kind = dict(texts.dtypes)[tid]
    rows = texts.select(F.col(tid).alias("text_id"), F.col(t).alias("text"))
    found = None
    for g in range(groups):
        some = tuple(sorted((r.number, r.p) for r in wanted.filter(F.pmod("number", F.lit(groups)) == g).collect()))  # half of AUTOMATON or so
        part = rows.mapInArrow(partial(_places, patterns=some), f"text_id {kind}, number long, at long, size long")
        found = part if found is None else found.unionByName(part)
    return found.join(named.drop("p"), "number").select(F.col("text_id").alias(tid), F.col("pattern_id").alias(pid), "at", "size")


# Cutting --------------------------------------------------------------------------------------------


#: What page_norm leaves out, as characters.
LEFT_OUT = " \t\n\x0b\f\r\u200b\u200c\u200d\ufeff\u00a0\u3000·●…．._—-"


def _pieces(text: str, needles: list) -> list[str]:
    """See cut_at."""
    text = (text or "").strip(" ")
    kept = [i for i, c in enumerate(text) if c not in LEFT_OUT]
    plain = "".join([text[i] for i in kept])
    wanted = [(n or "").strip(" ") for n in needles]
    cursor, spans = 0, []
    for n in needles:
        bare = "".join([c for c in n or "" if c not in LEFT_OUT])
        at = plain.find(bare, cursor) if bare else -1
        at = plain.find(bare) if bare and at < 0 else at
        spans.append((at, at + len(bare)) if at >= 0 else None)
        cursor = at + len(bare) if at >= 0 else cursor
    out = []
    for i, (n, mine) in enumerate(zip(wanted, spans)):
        following = spans[i + 1] if i + 1 < len(spans) else None
        a, b = mine or (0, 0)
        b = following[0] if mine and following and following[0] < b else b
        found = text[kept[a] : kept[b - 1] + 1].strip(" ") if b > a else ""
        out.append(found or n)
    return out


def cut_at(text: Column, needles: Column) -> Column:
    """One piece of the text for each needle (array): where the needle stands after the one before it, else where it stands at all, blanks and dots aside.

    Pieces don't overlap: one that would is cut where the next begins. A needle that isn't there, or of which nothing is left,
    stands for itself. A small helper on Arrow batches: places in a string of bytes are counted from its begin, so that
    built-in functions read a text once for each of its pieces.
    """

    def many(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for some, wanted in texts:
            yield pd.Series([None if n is None else _pieces(t, n) for t, n in zip(some, wanted)], dtype=object)

    return F.pandas_udf(many, "array<string>")(text, needles)
