"""SimHash near-dedup: fingerprints compared by bit planes with carry-save counters.

Different fingerprints (copies count once) are dealt into buckets so that any two within the radius meet: their 64 bits
are cut into blocks, and with `radius` differing bits all but `radius` blocks are equal, so each choice of that many
blocks is a table of buckets. In a bucket the fingerprints are kept as 64 vertical bit planes; one bitwise step updates
64 distances at once in carry-save counters, and a block of 64 comparisons ends as soon as all exceed the radius.
A bucket passes on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, short_batches, small
from .components import components

#: Fingerprints in a bucket; a larger one is cut by further bits, and what is still larger into tiles, each pair of which becomes a bucket of its own.
TILE = 16_384
#: Small buckets are compared in batches of about so many fingerprints, queries so many at a time.
BATCH, QUERIES = 1024, 256
FULL = np.uint64(2**64 - 1)


# Fingerprints -------------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int) -> int:
    """Of lower-cased (A-Z) words: bit i is set if it is in over half of the shingles' XXH64 (seed 42)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        first = [0, *ends[: n - 1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(first, (ends[shingle - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        block = np.array(hashes[lo : lo + 65536], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, keep: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.num_columns - 1).cast(pa.binary())
        out = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep)), pa.array(out)], names=[str(i) for i in range(keep + 1)])


# Comparison ---------------------------------------------------------------------------------------


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of the fingerprints (rows of one or more 64-bit words), 64 of them to a word."""
    bits = np.unpackbits(prints.astype(">u8").reshape(len(prints), -1).view(np.uint8), axis=1)
    wide = np.zeros((bits.shape[1], -(-len(prints) // 64) * 64), np.uint8)
    wide[:, : len(prints)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def near(queries: np.ndarray, vertical: np.ndarray, n: int, radius: int, compared: list[int] | None = None) -> np.ndarray:
    """For each query a row of words whose bits tell which of the n fingerprints are within the radius.

    queries: bit planes of the queries; vertical: those of the fingerprints. A cell is one query against 64 fingerprints;
    it is abandoned as soon as all 64 exceed the radius. compared gets the number of cells that each plane still met.
    """
    count, words = queries.shape[1] * 64, vertical.shape[1]
    bits = np.unpackbits(queries.view(np.uint8), axis=1, bitorder="little").astype(bool)
    rows, columns = np.divmod(np.arange(count * words), words)
    out = np.zeros((count, words), np.uint64)
    counters = np.zeros(((radius + 1).bit_length() + 1, len(rows)), np.uint64)  # the last: beyond what the others count
    whole = True
    for p in range(len(vertical)):
        if compared is not None:
            compared.append(len(rows))
        if whole:
            carry = (vertical[p][None, :] ^ np.where(bits[p], FULL, np.uint64(0))[:, None]).ravel()
        else:
            carry = vertical[p][columns] ^ np.where(bits[p][rows], FULL, np.uint64(0))
        for counter in counters[:-1]:
            both = counter & carry
            counter ^= carry
            carry = both
        counters[-1] |= carry
        if p % 8 == 7 and p > 2 * radius and p + 1 < len(vertical):
            going = beyond(counters, radius) != FULL
            if np.count_nonzero(going) < 0.75 * len(rows):
                rows, columns, counters, whole = rows[going], columns[going], np.ascontiguousarray(counters[:, going]), False
                if not len(rows):
                    break
    out[rows, columns] = ~beyond(counters, radius)
    if n % 64:
        out[:, -1] &= np.uint64((1 << n % 64) - 1)
    return out


def beyond(counters: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the counts that exceed the radius."""
    out = np.full_like(counters[0], FULL)
    for i, counter in enumerate(counters[:-1]):  # count >= radius + 1, from the low bit up
        out = (counter & out) if (radius + 1) >> i & 1 else (counter | out)
    return counters[-1] | out


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius among the left, or between left and right: each to the least of its component here."""
    all_of = left if right is None else np.concatenate([left, right])
    label = np.arange(len(all_of))
    order = np.argsort(all_of.view(np.int64), kind="stable")
    label[order] = np.arange(len(all_of))  # the least fingerprint (as a signed number) has the least label
    rank = label.copy()
    other, shift = (left, 0) if right is None else (right, len(left))
    vertical = planes(other)
    for lo in range(0, len(left), QUERIES):
        hits = near(planes(left[lo : lo + QUERIES]), vertical, len(other), radius)[: len(left) - lo]
        if right is None:
            own = np.arange(lo, min(lo + QUERIES, len(left)))
            hits[np.arange(len(own)), own // 64] &= ~(np.uint64(1) << (own % 64).astype(np.uint64))
        for i in np.flatnonzero(hits.any(axis=1)):
            js = np.flatnonzero(np.unpackbits(hits[i].view(np.uint8), bitorder="little")) + shift
            if np.any(label[js] != label[lo + i]):
                found = np.unique(np.append(label[js], label[lo + i]))
                label[np.isin(label, found)] = found[0]
    moved = label != rank
    return all_of[moved], all_of[order][label[moved]]


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket (table, value, cut, its value, tile pair). Small buckets are compared together: what they link is within the radius anyhow."""
    held: list[np.ndarray] = []
    size = 0

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def bucket(prints: np.ndarray, side: np.ndarray):
        left, right = prints[side == 0], prints[side == 1]
        return out(*linked(left, right if len(right) else None, radius))

    last, rows = None, []
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(8)]
        keys = np.stack(cols[:6], axis=1)
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for s, e in zip(cut, cut[1:]):
            if s == e:
                continue
            key = tuple(keys[s])
            if key != last and rows:
                prints, side = (np.concatenate(x) for x in zip(*rows))
                if len(prints) >= BATCH or side.any():
                    yield bucket(prints, side)
                elif len(prints) > 1:
                    held.append(prints)
                    size += len(prints)
                    if size >= BATCH:
                        yield out(*linked(np.unique(np.concatenate(held)), None, radius))
                        held, size = [], 0
                rows = []
            last = key
            rows.append((cols[6][s:e].view(np.uint64), cols[7][s:e]))
    if rows:
        prints, side = (np.concatenate(x) for x in zip(*rows))
        if side.any() or len(prints) >= BATCH:
            yield bucket(prints, side)
        else:
            held.append(prints)
    if held:
        yield out(*linked(np.unique(np.concatenate(held)), None, radius))


def _blocks(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of so many blocks of 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def choices(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """The tables for n fingerprints: with more blocks a bucket's key has more bits, so that a bucket of unrelated ones stays below BATCH."""
    for count in range(radius + 1, 2 * radius + 1):
        blocks = _blocks(count)
        tables = [list(c) for c in combinations(blocks, count - radius)]
        if n >> min(sum(bits for _, bits in t) for t in tables) <= BATCH:
            break
    return tables


def _mask(blocks: list[tuple[int, int]]) -> int:
    """The blocks' bits as a signed long."""
    mask = sum(((1 << n) - 1) << s for s, n in blocks)
    return mask - (1 << 64) if mask >> 63 else mask


def finer(table: list[tuple[int, int]], radius: int) -> list[int]:
    """Masks that cut a bucket of the table: of the bits that it leaves free, radius + 2 groups, two of which are equal in any two within the radius."""
    held = {s + i for s, n in table for i in range(n)}
    free = [i for i in range(64) if i not in held]
    groups = [[(i, 1) for i in free[len(free) * g // (radius + 2) : len(free) * (g + 1) // (radius + 2)]] for g in range(radius + 2)]
    return [_mask(a + b) for a, b in combinations(groups, 2)]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """fp (different longs) -> a, b: links whose components are those of all pairs within the radius.

    A bucket beyond TILE is cut by further bits; what is still beyond it, into pairs of tiles.
    """
    tables = choices(prints.count(), radius)
    zero = F.lit(0).cast("long")
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("v")) for i, b in enumerate(tables)])
    dealt = prints.select("fp", F.explode(keys).alias("x")).select("x.t", "x.v", zero.alias("s"), zero.alias("w"), "fp")

    def split(rows: DataFrame, by: list[str], name: str) -> tuple[DataFrame, DataFrame | None]:
        """The rows of buckets up to TILE, and those of larger ones with their `rows`."""
        crowd = materialise(rows.groupBy(*by).agg(F.count("*").alias("rows")).filter(F.col("rows") > TILE), name)
        crowded = crowd.count()
        if not crowded:
            return rows, None
        marked = rows.join(small(crowd, crowded, 48), by, "left")
        return marked.filter("rows is null").drop("rows"), marked.filter("rows is not null")

    calm, hot = split(dealt, ["t", "v"], "crowded-buckets")
    whole = ["t", "v", "s", "w", zero.alias("i"), zero.alias("j"), "fp", zero.alias("side")]
    out = calm.select(*whole)
    if hot is not None:
        cuts = F.array(*[F.array(*[F.lit(m).cast("long") for m in finer(t, radius)]) for t in tables])
        cut = hot.select("t", "v", "fp", F.posexplode(F.get(cuts, F.col("t").cast("int"))).alias("s", "mask"))
        cut = cut.select("t", "v", (F.col("s") + 1).cast("long").alias("s"), F.col("fp").bitwiseAND(F.col("mask")).alias("w"), "fp")
        calm, hot = split(cut, ["t", "v", "s", "w"], "crowded-cuts")
        out = out.unionByName(calm.select(*whole))
        if hot is not None:
            tiles = F.ceil(F.col("rows") / F.lit(TILE / 2))
            own = F.pmod(F.xxhash64("fp"), tiles)
            pairs = F.transform(F.sequence(zero, tiles - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"), (F.col("own") > o).cast("long").alias("side")))
            out = out.unionByName(hot.withColumn("own", own).select("t", "v", "s", "w", "fp", F.explode(pairs).alias("p")).select("t", "v", "s", "w", "p.i", "p.j", "fp", "p.side"))
    key = ["t", "v", "s", "w", "i", "j"]
    return out.repartition(*key).sortWithinPartitions(*key).mapInArrow(partial(_forest, radius=radius), "a long, b long")


def _labelled(marked: DataFrame, radius: int) -> DataFrame:
    """fp -> root of its component, for linked fingerprints."""
    return components(links(marked.select("fp").distinct(), radius))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of df: id_col, fingerprint (16 hex digits), component_id: the smallest id reachable over links, itself included.

    Null and empty texts have the fingerprint zero, which links like any other; fewer words than a shingle count as one
    shingle. Rows with a null id take part, but a null is nobody's component_id unless all ids in the component are null.
    Repeated rows stay. An empty table gives an empty one.
    """
    short_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    read = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = read.mapInArrow(partial(_fingerprints, shingle=shingle, keep=1), f"id {kind}, fp long")
    marked = materialise(marked, "fingerprints")
    roots = _labelled(marked, radius)
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))
    joined = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialise(joined, "fingerprint-roots")
    firsts = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(firsts, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """The rows of df that stay: of each component, one row with its smallest id (rows with null ids come last; of rows that are alike in id, any one).

    Links are fingerprints within the radius, or with `similarity` texts whose shingle sets have that Jaccard similarity
    or more, found through wider fingerprints (see near_copies).
    """
    if similarity is not None:
        from .near_copies import near_dedup

        return near_dedup(df, id_col, text, shingle, similarity)
    short_batches(df.sparkSession)
    (fp, rid) = fresh(df, "fp", "rid")
    read = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(df.dtypes)), "fp long"])
    marked = read.mapInArrow(partial(_fingerprints, shingle=shingle, keep=len(df.columns)), schema).toDF(*df.columns, fp)
    marked = materialise(marked.withColumn(rid, F.monotonically_increasing_id()), "marked")
    keys = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(rid).alias("rid"))
    roots = _labelled(keys, radius)
    order = F.struct(F.col("id").isNull().alias("n"), "id", "rid")
    least = keys.groupBy("fp").agg(F.min(order).alias("least"))
    firsts = least.join(roots, least.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    keep = firsts.select(F.col("least.rid").alias(rid))
    return marked.join(keep, rid, "left_semi").select(*df.columns)
