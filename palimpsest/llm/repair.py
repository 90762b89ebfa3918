"""Repair of conversations by the cheapest edits, with a lazily determinised weighted automaton.

A conversation is a word over (fault, role initial). Edits make its role initials `(s?(ua)+)?`; the automaton of that
pattern has four states, and edits are its weighted arcs. What all edits of a beginning may cost is one vector of a cost
per state; less its least number it is a state of the determinised automaton, made when first met and kept in a
transition table. A scan by that table gives the cost; a trace backwards over tight arcs finds the states from which the
cheapest edits end, and the audit is read off along them, least letter first.

Texts are never gathered: the scan sees one byte a turn, packed by the partitions of a range over (conversation, turn), so
a conversation may be spread over many tasks; the repaired text streams.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, short_batches

# Costs of edits; a truncated turn that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
OK, BLANK, DUPLICATE, CUT = range(4)
INITIALS = "sua"  # 3: any other
#: Of each state of `(s?(ua)+)?` (nothing yet, after s, after u, after a): the role that may be put next, and the state after it.
PUT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: The state after an initial, where the pattern allows it.
KEPT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
ENDS = (0, 3)
SPACE = " \t\n\x0b\f\r"


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults put in by crc32(`conv:turn`) % 20: 0 drops the row, 1 empties its text, 2 removes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes it a user's. Null roles and texts become one space, as do null numbers in what is hashed; rows of
    the same conversation and turn share their fault; other columns are carried."""
    told = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    fault = F.crc32(told.cast("binary")) % 20
    whole = F.coalesce(F.col(text), F.lit(" "))
    new = {text: F.when(fault == 1, "").when(fault == 2, F.translate(whole, ".!?", "")).otherwise(whole), role: F.when(fault == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" ")))}
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.filter(fault != 0).select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], copies.alias("\x00copy")).drop("\x00copy")


class Lazy:
    """The determinised automaton. State i stands for vectors[i]; only what some conversation has needed is in the tables."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.live: dict[tuple[int, int, int], int] = {}
        self.walk: dict[tuple[int, int, int, int], tuple[str, int]] = {}
        self.start = self._state([0, NEVER, NEVER, NEVER])[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """Insertions made, the least cost taken off: the state's number and what was taken off."""
        for _ in PUT:
            for p, (_, q) in enumerate(PUT):
                costs[q] = min(costs[q], costs[p] + INSERT)
        least = min(costs)
        vector = tuple(c - least if c < NEVER else NEVER for c in costs)
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.known[vector], least

    @staticmethod
    def arcs(p: int, symbol: int) -> list[tuple[str, int, int]]:
        """letter, cost, next state of each edit of a turn in state p, by letter."""
        fault, initial = divmod(symbol, 4)
        out = [("D", DELETE, p)]
        if fault in (OK, CUT):
            more = TRUNCATED if fault == CUT else 0
            if initial in KEPT[p]:
                out.append(("K", more, KEPT[p][initial]))
            out.append(("R", REROLE + more, PUT[p][1]))
        return out

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        if (state, symbol) not in self.table:
            costs = [NEVER] * 4
            for p, c in enumerate(self.vectors[state]):
                for _, w, q in self.arcs(p, symbol) if c < NEVER else ():
                    costs[q] = min(costs[q], c + w)
            self.table[state, symbol] = self._state(costs)
        return self.table[state, symbol]

    def _inserts(self, state: int, mask: int) -> int:
        """The states (as bits) that reach those of the mask by insertions on tight arcs, with them."""
        v = self.vectors[state]
        for _ in PUT:
            for p, (_, q) in enumerate(PUT):
                if mask >> q & 1 and v[p] < NEVER and v[p] + INSERT == v[q]:
                    mask |= 1 << p
        return mask

    def _before(self, state: int, symbol: int, mask: int) -> int:
        """The states before a turn from which tight arcs lead to those of the mask after it."""
        if (state, symbol, mask) not in self.live:
            after, least = self.step(state, symbol)
            v, w = self.vectors[state], self.vectors[after]
            found = sum(1 << p for p in range(4) if v[p] < NEVER and any(mask >> q & 1 and v[p] + c == w[q] + least for _, c, q in self.arcs(p, symbol)))
            self.live[state, symbol, mask] = self._inserts(state, found)
        return self.live[state, symbol, mask]

    def _letters(self, state: int, symbol: int, mask: int, p: int) -> tuple[str, int]:
        """From state p before a turn: the least letters over tight arcs up to that turn's edit, and the state after it."""
        if (state, symbol, mask, p) not in self.walk:
            after, least = self.step(state, symbol)
            v, w, live = self.vectors[state], self.vectors[after], self._before(state, symbol, mask)
            out, at = "", p
            while True:
                edits = {letter: q for letter, c, q in self.arcs(at, symbol) if mask >> q & 1 and v[at] + c == w[q] + least}
                if "D" not in edits and live >> PUT[at][1] & 1 and v[at] + INSERT == v[PUT[at][1]]:
                    out, at = out + "I", PUT[at][1]
                    continue
                letter = min(edits)
                self.walk[state, symbol, mask, p] = out + letter, edits[letter]
                break
        return self.walk[state, symbol, mask, p]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The cost of the cheapest edits and, of all that cost as much, the least letters."""
        states, total, state = array("i", [self.start]), 0, self.start
        for symbol in symbols:
            state, least = self.step(state, symbol)
            total += least
            states.append(state)
        v = self.vectors[state]
        end = min(v[q] for q in ENDS)
        last = self._inserts(state, sum(1 << q for q in ENDS if v[q] == end))
        masks, mask = bytearray(len(states)), last
        for i in range(len(symbols) - 1, -1, -1):
            masks[i + 1] = mask
            mask = self._before(states[i], symbols[i], mask)
        out, p = [], 0
        for i, symbol in enumerate(symbols):
            letters, p = self._letters(states[i], symbol, masks[i + 1], p)
            out.append(letters)
        while p not in ENDS or v[p] != end:
            out.append("I")
            p = PUT[p][1]
        return total + end, "".join(out)


def _packed(batches: Iterator[pa.RecordBatch], kind, turn_kind) -> Iterator[pa.RecordBatch]:
    """Turns by number -> one row per conversation and stretch of numbers: its symbols, its turns' least, greatest and how many differ."""
    held: list[tuple] = []
    conv, first, codes, low, high, different, size = None, None, [], None, None, 0, 0

    def row():
        return conv, first, b"".join(codes), low, high, different

    def send():
        columns = [pa.array(x, t) for x, t in zip(zip(*held), (kind, pa.int64(), pa.binary(), turn_kind, turn_kind, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "first", "codes", "low", "high", "different"])

    for b in batches:
        n = b.num_rows
        convs, uids, turns = (b.column(j).to_pylist() for j in range(3))
        symbols = b.column(3).to_numpy(zero_copy_only=False).astype(np.uint8)
        i = 0
        while i < n:
            j = i
            while j < n and convs[j] == convs[i]:
                j += 1
            if first is None or convs[i] != conv:
                if first is not None:
                    held.append(row())
                conv, first, codes, low, high, different = convs[i], uids[i], [], None, None, 0
            codes.append(symbols[i:j].tobytes())
            for t in turns[i:j]:
                if t is not None and t != high:
                    low, high, different = t if low is None else low, t, different + 1
            i = j
        if len(held) > 5000:
            yield send()
            held.clear()
    if first is not None:
        held.append(row())
    if held:
        yield send()


_LAWFUL = np.zeros(16, bool)
_LAWFUL[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True


def _scanned(batches: Iterator[pa.RecordBatch], kind) -> Iterator[pa.RecordBatch]:
    """Stretches by conversation and number -> one row per conversation."""
    lazy = Lazy()
    conv, parts = None, []

    def row():
        symbols = b"".join(p[0] for p in parts)
        codes = np.frombuffer(symbols, np.uint8)
        faults, initials = np.bincount(codes >> 2, minlength=4), codes & 3
        illegal = int((~_LAWFUL[initials[:-1] * 4 + initials[1:]]).sum())
        told = [p for p in parts if p[1] is not None]
        different = sum(p[3] for p in told) - sum(a[2] == b[1] for a, b in zip(told, told[1:]))
        gaps = int(told[-1][2] - told[0][1] + 1 - different) if told else 0
        cost, audit = lazy.repair(symbols)
        return conv, gaps, int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[CUT]), illegal, cost, audit

    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for b in batches:
        out = []
        for c, *part in zip(*(b.column(j).to_pylist() for j in (0, 2, 3, 4, 5))):
            if parts and c != conv:
                out.append(row())
                parts = []
            conv = c
            parts.append(part)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind if i == 0 else pa.string() if i == 7 else pa.int64()) for i, x in enumerate(zip(*out))], names=names)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind if i == 0 else pa.string() if i == 7 else pa.int64()) for i, x in enumerate(row())], names=names)


def _repaired(batches: Iterator[pa.RecordBatch], kind, digest: bool) -> Iterator[pa.RecordBatch]:
    """(conv, number, role, text, audit) by conversation and number, the audit first -> repaired turns, or one digest per conversation."""
    out: list[tuple] = []
    conv, audit, at, state, place, told = None, None, 0, 0, 0, hashlib.sha256()

    def put(role, text, letter):
        nonlocal place
        if digest:
            told.update((("\n" if place else "") + role + ":" + text).encode())
        else:
            out.append((conv, place, role, text, letter))
        place += 1

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = PUT[state]
            put(role, "", "I")
            at += 1

    def end():
        inserts()
        if digest:
            out.append((conv, told.hexdigest()))

    def send():
        types = (kind, pa.string()) if digest else (kind, pa.int64(), pa.string(), pa.string(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[str(i) for i in range(len(types))])
        out.clear()
        return batch

    for b in batches:
        for c, uid, role, text, letters in zip(*(b.column(j).to_pylist() for j in range(5))):
            if uid < 0:
                if audit is not None:
                    end()
                conv, audit, at, state, place, told = c, letters, 0, 0, 0, hashlib.sha256()
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = KEPT[state][INITIALS.index(role[:1])]
                put(role, text, "K")
            elif letter == "R":
                role, state = PUT[state]
                put(role, text, "R")
        if out:
            yield send()
    if audit is not None:
        end()
        if out:
            yield send()


class Repaired:
    """What repair() found: `report`, one row per conversation, and on demand the repaired turns or their digests."""

    def __init__(self, turns: DataFrame, report: DataFrame, conv: str, kind):
        self.turns, self._report, self.conv, self.kind = turns, report, conv, kind

    @property
    def report(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit."""
        return self._report.withColumnRenamed("conv", self.conv)

    def _stream(self, digest: bool, schema: str) -> DataFrame:
        short_batches(self.turns.sparkSession)
        heads = self._report.select("conv", F.lit(-1).cast("long").alias("uid"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
        rows = heads.unionByName(self.turns.select("conv", "uid", "role", "text", F.lit(None).cast("string").alias("audit")))
        told = rows.repartition("conv").sortWithinPartitions("conv", "uid").mapInArrow(partial(_repaired, kind=self.kind, digest=digest), f"conv {self._report.schema['conv'].dataType.simpleString()}, {schema}")
        return told.withColumnRenamed("conv", self.conv)

    def rows(self) -> DataFrame:
        """conv, place (long, from 0), role, text, edit (K, R or I): the repaired turns."""
        return self._stream(False, "place long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """conv, repaired_sha256 of the repaired `role:text`, joined by newlines. One digest reads its conversation from end to end, so a conversation's texts stream through one task, a batch at a time."""
        return self._stream(True, "repaired_sha256 string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest edits of each conversation that give its role initials `(s?(ua)+)?`.

    Turns are ordered by turn (nulls first), then role, then the SHA-256 of their text; null roles and texts count as one
    space; repeated rows stay and are duplicates; rows with a null id form one conversation; other columns are ignored. A turn's first
    fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated (the last character
    that isn't white space is none of `.!?`). Keep costs 0, rerole 3, delete 4 (blank and duplicate turns must go), insert 3,
    a truncated turn that stays 3 more. A role whose first letter is none of s, u, a, or an empty one, can't be kept. An
    empty table gives an empty report.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, turn_kind = (to_arrow_type(df.schema[c].dataType) for c in (conv, turn))
    read = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.coalesce(F.expr(f"nullif(locate(substring(role, 1, 1), '{INITIALS}'), 0)"), F.lit(4)) - 1
    marked = read.withColumns(
        {
            "same": F.unhex(F.sha2("text", 256)),
            "initial": F.when(F.col("role") == "", 3).otherwise(initial).cast("int"),
            "fault": F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(OK),
        }
    )
    order = ["conv", "turn", "role", "same"]
    turns = materialise(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id()), "turns")
    again = turns.groupBy("conv", "role", "same").agg(F.min("uid").alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("same").alias("same_"), "earliest")
    seen = turns.join(again, turns.conv.eqNullSafe(F.col("conv_")) & (turns.role == F.col("role_")) & (turns.same == F.col("same_")), "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("uid") > F.col("earliest"), DUPLICATE).otherwise(F.col("fault"))
    coded = seen.select("conv", "uid", "turn", (fault * 4 + F.col("initial")).cast("int").alias("symbol"), F.shiftright("uid", 33).alias("part"))
    names = (df.schema[c].dataType.simpleString() for c in (conv, turn, turn))
    packed = coded.repartition("part").sortWithinPartitions("uid").drop("part").mapInArrow(partial(_packed, kind=kind, turn_kind=turn_kind), "conv {}, first long, codes binary, low {}, high {}, different long".format(*names))
    scanned = packed.repartition("conv").sortWithinPartitions("conv", "first").mapInArrow(partial(_scanned, kind=kind), f"conv {df.schema[conv].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return Repaired(turns, materialise(scanned, "repairs"), conv, kind)


def repair_report(df: DataFrame, whole: DataFrame, conv: str = "conv_id") -> DataFrame:
    """repair(df)'s report and digest for every conversation of `whole`; one without rows in df has zeros, an empty audit and the digest of nothing."""
    found = repair(df, conv=conv)
    ids = whole.select(F.col(conv).alias("id")).distinct()
    report, digests = found.report.withColumnRenamed(conv, "told"), found.digests().withColumnRenamed(conv, "of")
    out = ids.join(report, ids.id.eqNullSafe(report.told), "left").join(digests, ids.id.eqNullSafe(digests.of), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("id").alias(conv), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
