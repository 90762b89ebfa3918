"""Substring dedup over words: windows that share a minimiser travel together, and sorting counts them in their bucket, byte by byte where hashes agree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, with_key, word_spans
from .repeats import Units, columns, merged, ranges, repeated

#: Words in a minimiser; fewer give longer runs, more give rarer minimisers.
M = 6
#: Bytes of packed strings whose windows are sorted at once.
BATCH = 1 << 20


def classes(raw: bytes, first: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each range of raw; equal numbers stand for equal bytes. Sorted by hashes, neighbours are compared byte by byte."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    label = np.cumsum(new) - 1
    f, e = first[order].tolist(), end[order].tolist()
    wrong = {label[i] for i in np.flatnonzero(~new).tolist() if raw[f[i] : e[i]] != raw[f[i - 1] : e[i - 1]]}
    for w in wrong:  # different bytes with one hash
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(label == w).tolist():
            label[i] = seen.setdefault(raw[f[i] : e[i]], len(order) * (1 + len(seen)) + w)
    out = np.empty(len(order), np.int64)
    out[order] = label
    return out


def by_sorting(rows: Iterator[tuple], k: int, most: int) -> Iterator[tuple]:
    """Windows whose words are in two runs or in a run with copies. Buckets are taken together up to so many bytes."""
    held: list[tuple] = []
    size = 0

    def judged():
        mz, pk, copies, packs = columns(held)
        units = Units(packs, True)
        wins, pack, at, first, end = units.windows(k)
        label = classes(units.raw, first, end, units.hashed(at, at + k))
        _, place = np.unique(label, return_inverse=True)
        hit = np.bincount(place, weights=copies[pack])[place] > 1
        at, first, end = ranges(hit, wins)
        return mz[at], pk[at], first, end

    for row in rows:
        if size >= most and row[0] != held[-1][0]:
            yield judged()
            held, size = [], 0
        held.append(row)
        size += len(row[5])
    if held:
        yield judged()


def _cut(raw: bytes, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> bytes:
    """raw without the words of the spans and the white space after each."""
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at : starts[s]])
        at = int(starts[e]) if e < len(starts) else int(ends[-1])
    left = b"".join([*parts, raw[at:]])
    return left.rstrip(b" \t\n\x0b\x0c\r") if spans[-1][1] == len(starts) else left


def _applied(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """With digest, the columns of the counts; else the text that is left. The last two columns are the text and its spans."""
    for b in batches:
        out: list[tuple] = []
        for text, spans in zip(b.column(b.num_columns - 2).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            cut = merged(spans)
            if digest:
                words = text.split()
                keep = [w for (_, s), (e, _) in zip([(0, 0), *cut], [*cut, (len(words), 0)]) for w in words[s:e]]
                out.append((len(words), len(words) - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()))
            elif cut:
                starts, ends, _ = word_spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                left = _cut(text, cut, starts, ends)
                out.append((len(starts), sum(e - s for s, e in cut), left.decode() if left.strip() else ""))
            else:
                out.append((len(text.split()), 0, text.decode()))
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), *columns], names=[str(i) for i in range(b.num_columns + 1)])


def _with_spans(df: DataFrame, text: str, carry: list[str], k: int, names: list[str], digest: bool) -> DataFrame:
    found = repeated(df, text, k, M, True, partial(by_sorting, k=k, most=BATCH))
    keyed = with_key(df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text), F.lit("")).alias("text")))
    joined = keyed.join(found, ["k1", "k2"], "left").select(*[f"c{i}" for i in range(len(carry))], "text", "spans")
    types = dict(df.dtypes)
    schema = ", ".join([*(f"c{i} {types[c]}" for i, c in enumerate(carry)), "words long, removed long, kept string"])
    return joined.mapInArrow(partial(_applied, digest=digest), schema).toDF(*carry, *names)


def substring_dedup(df: DataFrame, text: str = "text", k: int = 35) -> DataFrame:
    """Removes from each text the words under a window of k words that also starts anywhere else, the first place included.

    Windows are judged on the input; words are [^\\x20\\x09-\\x0D]+. All columns stay; `text` has the words that are left
    with the white space that followed each; a text without repeats stays as it is; a null text becomes empty; texts of
    fewer than k words never lose any. n_words and n_removed are added under names that df doesn't have. Repeated rows
    (whole copies) count as different places, so both lose all their windows. An empty table gives an empty one.
    """
    n_words, n_removed, left = fresh(df, "n_words", "n_removed", "kept_text")
    carry = [c for c in df.columns if c != text]
    out = _with_spans(df, text, carry, k, [n_words, n_removed, left], False)
    return out.select(*[F.col(left).alias(text) if c == text else F.col(c) for c in df.columns], n_words, n_removed)


def substring_digests(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 35) -> DataFrame:
    """One row per row of df: id_col, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    return _with_spans(df, text, [id_col], k, ["n_words", "n_removed", "kept_sha256"], True)
