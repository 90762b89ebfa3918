"""Lets equal windows of k units meet, exactly and without sending the corpus.

A text's windows are cut into runs of consecutive windows with the same minimiser (the least hash of m units in a window,
the leftmost of equals). Equal windows have equal minimisers, so a run whose minimiser is nowhere else holds no repeat and
goes no further. The others travel as one packed string per different run to the bucket of their minimiser, where
`judge` says which of their windows repeat; the answers go back to all texts that have the run.

Texts are known by 128 bits (with_key) and runs by their minimiser and 64 bits of their bytes, so copies are counted but
sent once. In a bucket bytes are compared. Only windows of crowded minimisers meet by digests of 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEEDS, RangeHash, byte_codes, digests, materialise, short_batches, slices, text_bytes, with_key, word_hashes

#: Bytes of text that one step of numpy takes.
STEP = 1 << 20
#: Different runs with one minimiser beyond which their windows are dealt out by their own digests instead.
CROWD = 4096
PACKED = "bucket long, batch int, f int, mz long, pk long, copies long, pack binary, d1 long"
FOUND = "mz long, pk long, f int, t int"
KEYS = ["k1", "k2"]
#: Bytes of strings that a task judges, about, where the session's number of partitions would make them larger.
TASK = 32 << 20
#: Batches that texts are dealt into, by their keys.
BATCHES = 4


def runs(hashed: RangeHash, begins: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (begins: where each starts, and the end): text, place among all units, windows and minimiser of each run."""
    n = len(hashed.sums) - 1
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none, none, none.astype(np.uint64)
    grams = hashed.grams(m)
    least, have, want = grams, 1, k - m + 1
    while 2 * have <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if want > have:
        least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    until = np.maximum(begins[1:] - k + 1, begins[:-1])  # where the windows of a text end
    full = until > begins[:-1]
    new[begins[:-1][full]] = True
    change = np.zeros(len(least) + 1, np.int8)
    np.add.at(change, begins[:-1][full], 1)
    np.add.at(change, until[full], -1)
    at = np.flatnonzero(new & (np.cumsum(change[:-1], dtype=np.int8) > 0))
    text = np.searchsorted(begins, at, "right") - 1
    end = np.minimum(np.append(at[1:], n), until[text])
    return text, at, end - at, least[at]


class Units:
    """The bytes or words of texts: a hash of their ranges, where each text's units begin, and their spans in `raw`, in which words are joined by one byte."""

    def __init__(self, texts: list[bytes], words: bool):
        if not words:
            self.raw = b"".join(texts)
            self.begins = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=self.begins[1:])
            self.hashed = RangeHash(byte_codes(SEEDS[0])[np.frombuffer(self.raw, np.uint8)])
            self.starts = np.arange(len(self.raw))
            self.ends = self.starts + 1
            return
        split = [t.split() for t in texts]
        self.begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in split], out=self.begins[1:])
        flat = list(chain.from_iterable(split))
        self.raw = b" ".join(flat)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.hashed = RangeHash(word_hashes(np.frombuffer(self.raw, np.uint8), self.starts, self.ends), SEEDS[1])

    def windows(self, k: int) -> tuple[np.ndarray, ...]:
        """Where each text's windows begin in the list of windows, and the end; each window's text, first unit, and span in raw."""
        counts = np.maximum(np.diff(self.begins) - (k - 1), 0)
        wins = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=wins[1:])
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(wins[-1]) - wins[text] + self.begins[text]
        return wins, text, at, self.starts[at], self.ends[at + k - 1]


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _occurrences(batches: Iterator[pa.RecordBatch], k: int, m: int, words: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, offsets = text_bytes(b.column(2))
        k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
        for i, j in slices(offsets, STEP):
            units = Units(_texts(b.column(2).slice(i, j - i)), words)
            text, at, n, least = runs(units.hashed, units.begins, k, m)
            if len(text):
                pk = digests(units.raw, units.starts[at], units.ends[at + n + k - 2])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[i + text], k2[i + text], (at - units.begins[text]).astype(np.int32), n.astype(np.int32), least.view(np.int64), pk.view(np.int64))], names=["k1", "k2", "start", "n", "mz", "pk"])


def _window_digests(packs: list[bytes], k: int, words: bool) -> tuple[np.ndarray, ...]:
    """Each window's pack and place in it, and 128 bits of its bytes."""
    from xxhash import xxh3_128_digest as digest

    units = Units(packs, words)
    wins, pack, _, first, end = units.windows(k)
    raw = units.raw
    both = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(first.tolist(), end.tolist())]), np.int64).reshape(-1, 2)
    return pack, np.arange(len(pack)) - wins[pack], both[:, 0], both[:, 1]


def _packs(batches: Iterator[pa.RecordBatch], k: int, words: bool, families: int) -> Iterator[pa.RecordBatch]:
    """The runs asked for as packed strings, or if their minimiser is crowded, their windows' digests. Copies come one after the other; the first answers."""
    last = None
    names = ["bucket", "batch", "f", "mz", "pk", "copies", "pack", "d1"]
    for b in batches:
        k1, k2 = (b.column(i).to_pylist() for i in (0, 1))
        for i in range(b.num_rows):
            if (k1[i], k2[i]) == last:
                continue
            last = k1[i], k2[i]
            units = Units(_texts(b.column(2).slice(i, 1)), words)
            whole, batch = units.raw, k1[i] % BATCHES
            asked = b.column(3).slice(i, 1).flatten()
            mz, pk, start, n, copies, crowded = (asked.field(f).to_numpy(zero_copy_only=False) for f in range(6))
            s, e = units.starts[start], units.ends[start + n.astype(np.int64) + (k - 2)]
            calm, hot = np.flatnonzero(~crowded), np.flatnonzero(crowded)
            for lo in range(0, len(calm), 2048):
                j = calm[lo : lo + 2048]
                packs = [whole[x:y] for x, y in zip(s[j].tolist(), e[j].tolist())]
                bucket = mz[j] % families if families else mz[j]
                fixed = (np.full(len(j), x, np.int32) for x in (batch, -1))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *map(pa.array, fixed), pa.array(mz[j]), pa.array(pk[j]), pa.array(copies[j]), pa.array(packs, pa.binary()), pa.array(pk[j])], names=names)
            for lo in range(0, len(hot), 256):
                j = hot[lo : lo + 256]
                pack, f, d0, d1 = _window_digests([whole[x:y] for x, y in zip(s[j].tolist(), e[j].tolist())], k, words)
                j = j[pack]
                yield pa.RecordBatch.from_arrays([pa.array(d0), pa.array(np.zeros(len(j), np.int32)), pa.array(f.astype(np.int32)), pa.array(mz[j]), pa.array(pk[j]), pa.array(copies[j]), pa.nulls(len(j), pa.binary()), pa.array(d1)], names=names)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """bucket, batch, minimiser, digest, copies, pack; a run that two tasks sent comes once."""
    last = None
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))):
            if (row[2], row[3], len(row[5])) != last:
                last = row[2], row[3], len(row[5])
                yield row


def columns(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Minimisers, digests, copies and packs of rows."""
    _, _, mz, pk, copies, packs = zip(*held)
    return np.array(mz, np.int64), np.array(pk, np.int64), np.array(copies, np.int64), list(packs)


def ranges(hit: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flags laid end to end: the text, first and end of each stretch of set ones."""
    hit = np.concatenate([[False], hit, [False]])
    edge = hit[1:] != hit[:-1]
    cut = begins[1:-1]
    cut = cut[hit[1:][cut] & hit[:-1][cut]]
    first, end = np.sort(np.append(np.flatnonzero(edge & hit[1:]), cut)), np.sort(np.append(np.flatnonzero(edge & hit[:-1]), cut))
    text = np.searchsorted(begins, first, "right") - 1
    return text, first - begins[text], end - begins[text]


def _judged(batches: Iterator[pa.RecordBatch], judge: Callable) -> Iterator[pa.RecordBatch]:
    """Packs come first, sorted by bucket and batch, then single windows, sorted by digest."""
    names = ["mz", "pk", "f", "t"]
    rest: list[pa.RecordBatch] = []

    def packs():
        for b in batches:
            single = np.flatnonzero(b.column(2).to_numpy() >= 0)
            if not len(single):
                yield b
                continue
            if single[0]:
                yield b.slice(0, single[0])
            rest.append(b.slice(single[0]))
            return

    for mz, pk, first, end in judge(rows_of(packs())):
        yield pa.RecordBatch.from_arrays([pa.array(mz), pa.array(pk), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], names=names)
    held = told = None
    for b in chain(rest, batches):
        d0, f, mz, pk, copies, d1 = (b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 7))
        out = []
        for key, row, many in zip(zip(d0, d1), zip(mz, pk, f), copies):
            if held is None or key != held[0]:
                held, told = (key, row), many > 1
                if told:
                    out.append(row)
            elif row != held[1]:  # not the same run from two tasks
                if not told:
                    out.append(held[1])
                    told = True
                out.append(row)
        if out:
            m, p, f = (np.array(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(p), pa.array(f.astype(np.int32)), pa.array((f + 1).astype(np.int32))], names=names)


def repeated(docs: DataFrame, text: str, k: int, m: int, words: bool, judge: Callable, family: int | None = None) -> DataFrame:
    """k1, k2, spans: for each text with repeats, the stretches [s, e) of units under windows that start more than once, sorted, maybe overlapping.

    judge takes rows (see rows_of), sorted by bucket and batch, and yields arrays (mz, pk, f, t): windows f to
    t - 1 of a run repeat. A bucket is a minimiser, or with `family` as many minimisers as have about so many bytes.
    Texts without repeats have no row. The text itself is read twice and only shuffled for the runs that are asked for.
    """
    short_batches(docs.sparkSession)
    keyed = with_key(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")))
    long_enough = keyed.filter(F.length("text") >= (2 * k - 1 if words else k // 4)).select("k1", "k2", "text")
    occ = materialise(long_enough.mapInArrow(partial(_occurrences, k=k, m=m, words=words), "k1 long, k2 long, start int, n int, mz long, pk long"), "runs")
    often = materialise(occ.groupBy("mz").agg(F.count("*").alias("times")).filter("times > 1").select("mz"), "minimisers")
    some = materialise(occ.join(often, "mz"), "shared-runs", occ, often)
    once = materialise(some.groupBy("k1", "k2", "start", "n", "mz", "pk").agg(F.count("*").alias("copies")), "shared-runs-once", some)
    packs = materialise(once.groupBy("mz", "pk").agg(F.sum("copies").alias("copies"), F.min(F.struct("k1", "k2", "start", "n")).alias("at")), "packs")
    size = (packs.agg(F.sum(F.col("at.n") + (k - 1))).first()[0] or 0) * (8 if words else 1)  # bytes, about
    families = max(1, -(-size // family)) if family else 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
    crowd = packs.groupBy("mz").agg(F.count("*").alias("different")).filter(F.col("different") > CROWD).select(F.col("mz").alias("crowd"))
    marked = packs.join(crowd, F.col("mz") == F.col("crowd"), "left")
    asked = marked.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("mz", "pk", "at.start", "at.n", "copies", F.col("crowd").isNotNull().alias("crowded"))).alias("asked"))
    # a merge join, so that copies of a text come to _packs one after the other
    sent = long_enough.join(asked.hint("merge"), KEYS).select("k1", "k2", "text", "asked").mapInArrow(partial(_packs, k=k, words=words, families=families), PACKED)
    order = [F.col("f") >= 0, "bucket", "batch", "d1", "mz", "pk", "f"]
    found = sent.repartition(parts, "bucket").sortWithinPartitions(*order).mapInArrow(partial(_judged, judge=judge), FOUND)
    found = materialise(found, "found", packs)
    spans = once.join(found, ["mz", "pk"]).select("k1", "k2", F.struct((F.col("start") + F.col("f")).alias("s"), (F.col("start") + F.col("t") + F.lit(k - 1)).alias("e")).alias("span"))
    return materialise(spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("span")).alias("spans")), "spans", once, found)


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; those that touch become one."""
    out: list[tuple[int, int]] = []
    for x in spans or ():
        if out and x["s"] <= out[-1][1]:
            if x["e"] > out[-1][1]:
                out[-1] = (out[-1][0], x["e"])
        else:
            out.append((x["s"], x["e"]))
    return out
