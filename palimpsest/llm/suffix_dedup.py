"""Substring dedup over bytes: a logarithmic family of suffix arrays.

The suffixes of a text that begin a string of k bytes are indexed. To meet their equals they travel together: those whose
strings share a least word of M bytes go as one string to the family that has this word (see repeats). A family gets the
texts' strings in batches, over the whole table. Each batch gets a suffix array in byte order, which is merge-scanned
with the arrays that are there; neighbours whose common prefix has k bytes mark each other; arrays of like size become
one, so there are logarithmically many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_bytes, with_key
from .repeats import columns, merged, ranges, repeated

#: Bytes of the word that strings travel by, and bytes of strings in a family, about.
M, FAMILY = 20, 4 << 20
#: Bytes of the suffixes that the rounds of sorting compare: few at first, since few suffixes are tied then; LATER in each further round.
FIRST, LATER = (8, 4, 4), 96


def _numbers(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n (4 or 8) bytes from each place, as numbers in byte order."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, n)[at]).view(f">u{n}").ravel().astype(np.uint64)


def arrange(data: np.ndarray, ids: np.ndarray, k: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (by where they begin in data) in the byte order of their first k bytes, and which have all k bytes in common with the one before.

    Each round sorts only what is still tied, by the next bytes. With `first`, ids are two arrays in order, the first so long: a sort that finds runs merges them, and
    what is tied in one of them alone is in its place, and stays unmarked.
    """
    ids = ids.copy()
    same = np.ones(len(ids), bool)
    same[:1] = False
    tied, group, depth = np.arange(len(ids)), np.zeros(len(ids), np.uint64), 0
    steps = chain(FIRST, repeat(LATER))
    kind, side = "stable" if first else None, np.arange(len(ids)) < first
    while depth < k and len(tied):
        n = next(steps)
        n = n if depth + n <= k else LATER
        if n == 8:
            part = _numbers(data, ids[tied] + depth, 8)
            order = np.argsort(part, kind=kind)
        elif n == 4:
            part = group << np.uint64(32) | _numbers(data, ids[tied] + depth, 4)
            order = np.argsort(part, kind=kind)
        else:
            n = min(n, k - depth)
            part = np.lib.stride_tricks.sliding_window_view(data, n)[ids[tied] + depth].view(f"S{n}").ravel()
            order = np.lexsort((part, group))
        ids[tied], part = ids[tied][order], part[order]
        equal = np.zeros(len(tied), bool)
        equal[1:] = (part[1:] == part[:-1]) & (group[1:] == group[:-1])
        going = equal.copy()
        going[:-1] |= equal[1:]
        number = np.cumsum(~equal) - 1
        if first:
            side = side[order]
            ours = np.bincount(number, weights=side)
            both = ((ours > 0) & (ours < np.bincount(number)))[number]
            equal &= both
            going &= both
            side = side[going]
        same[tied] = equal
        tied, group = tied[going], number[going].astype(np.uint64)
        depth += n
    return ids, same


class Family:
    """Suffix arrays over strings that are laid end to end, each at least twice as large as the next. `flags` tells which suffixes have an equal one."""

    def __init__(self, k: int):
        self.k = k
        self.data = np.zeros(0, np.uint8)
        self.levels: list[np.ndarray] = []
        self.flags = np.zeros(0, bool)
        self.scans = 0

    def _mark(self, ids: np.ndarray, same: np.ndarray) -> None:
        self.flags[ids[1:][same[1:]]] = self.flags[ids[:-1][same[1:]]] = True

    def add(self, strings: list[bytes]) -> np.ndarray:
        """Takes a batch of strings of k bytes or more; gives where each one's suffixes begin, and the end of the last string."""
        lengths = np.array([len(x) for x in strings], np.int64)
        begins = np.zeros(len(strings) + 1, np.int64)
        np.cumsum(lengths, out=begins[1:])
        begins += len(self.data)
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(strings), np.uint8)])
        self.flags = np.append(self.flags, np.zeros(len(self.data) - len(self.flags), bool))
        counts = lengths - (self.k - 1)
        before = np.cumsum(counts) - counts
        new, same = arrange(self.data, np.arange(counts.sum()) + np.repeat(begins[:-1] - before, counts), self.k)
        self._mark(new, same)
        joined = new
        for i in range(len(self.levels) - 1, -1, -1):
            level = self.levels[i]
            both, same = arrange(self.data, np.concatenate([level, joined if i == len(self.levels) - 1 else new]), self.k, first=len(level))
            self._mark(both, same)
            self.scans += 1
            if i == len(self.levels) - 1 and len(level) < 2 * len(joined):
                joined = both  # the scan has merged them
                self.levels.pop()
        self.levels.append(joined)
        return begins


def by_suffixes(rows: Iterator[tuple], k: int) -> Iterator[tuple]:
    """Rows come by bucket (a family) and batch."""
    for _, of in groupby(rows, key=lambda row: row[0]):
        family, parts = Family(k), []
        for _, batch in groupby(of, key=lambda row: row[1]):
            mz, pk, copies, packs = columns(list(batch))
            parts.append((mz, pk, copies, family.add(packs)))
        for mz, pk, copies, begins in parts:
            flags = family.flags[begins[0] : begins[-1]]
            begins = begins - begins[0]
            flags = flags | np.repeat(copies > 1, np.diff(begins))
            flags[(begins[1:, None] - np.arange(1, k)).ravel()] = False  # no string of k bytes begins there
            at, first, end = ranges(flags, begins)
            yield mz[at], pk[at], first, end


def _applied(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(b.num_columns - 2))
        out: list[tuple] = []
        for i, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            cut = merged(spans)
            left = b"".join(raw[s:e] for (_, s), (e, _) in zip([(0, 0), *cut], [*cut, (len(raw), 0)]))
            out.append((len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest() if digest else left))
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()))]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), *columns], names=[str(i) for i in range(b.num_columns + 2)])


def _with_spans(df: DataFrame, text: str, carry: list[str], k: int, names: list[str], digest: bool) -> DataFrame:
    found = repeated(df, text, k, M, False, partial(by_suffixes, k=k), FAMILY)
    keyed = with_key(df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text), F.lit("")).alias("text")))
    joined = keyed.join(found, ["k1", "k2"], "left").select(*[f"c{i}" for i in range(len(carry))], "text", "spans")
    types = dict(df.dtypes)
    schema = ", ".join([*(f"c{i} {types[c]}" for i, c in enumerate(carry)), "n long, removed long, spans long", "kept " + ("string" if digest else "binary")])
    return joined.mapInArrow(partial(_applied, digest=digest), schema).toDF(*carry, *names)


def suffix_dedup(df: DataFrame, text: str = "text", k: int = 200) -> DataFrame:
    """Removes each byte of a text (UTF-8) under a string of k bytes that also starts anywhere else in the table, itself included.

    All columns stay but for the text, which becomes binary `kept` (a cut may split a character); n_bytes, n_removed and
    n_spans (maximal removed stretches) are added, all under names that df doesn't have. Strings never cross texts and are
    judged on the input. A null text counts as empty; texts of fewer than k bytes stay whole; copies of a row lose all
    their strings; an empty table gives an empty one.
    """
    names = fresh(df, "n_bytes", "n_removed", "n_spans", "kept")
    return _with_spans(df, text, [c for c in df.columns if c != text], k, names, False)


def suffix_digests(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 200) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    return _with_spans(df, text, [id_col], k, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], True)
