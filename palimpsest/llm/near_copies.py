"""SimHash near-dedup at a threshold of similarity: what simhash_dedup does if it is given one.

Fingerprints of 256 bits over the texts' different word shingles are compared by bit planes, as in simhash; a pair within
RADIUS is a candidate, and a link if the Jaccard similarity of the whole shingle sets reaches the threshold. At a
similarity of 0.8 some 39 of 256 bits differ, so no blocks of equal bits can bring such pairs together; texts meet in one
bucket per band of MinHash values instead. Different texts (exact copies meet on the map side) are dealt, buckets with the
same members count once. A task holds the shingle sets of one bucket and passes on a spanning forest of its links, never
all pairs. A bucket beyond TILE is cut into pairs of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEEDS, RangeHash, fresh, materialise, mix, short_batches, small, text_bytes, with_key, word_hashes, word_spans
from .components import components
from .simhash import QUERIES, near, planes

#: Bands and MinHash values in each: of pairs with similarity s, 1 - (1 - s**WIDTH)**BANDS share a band (0.8: 0.99993).
BANDS, WIDTH = 24, 5
#: 64-bit words in a fingerprint.
WORDS = 4
#: Different texts in a tile pair; a larger bucket is cut.
TILE = 1024
#: Texts, and shingles, of buckets that are compared together.
BATCH, SHINGLES = 512, 1 << 22
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.Array, length: int) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its different shingles of lower-cased (A-Z) words; fewer words than a shingle, or none, are one."""
    data, at = text_bytes(texts)
    if not len(texts):
        return []
    starts, ends, first = word_spans(data, at)
    words = word_hashes(_LOWER[data], starts, ends)
    runs = RangeHash(words, SEEDS[1])
    grams = runs.grams(length)
    out = []
    for s, e in zip(first.tolist(), first[1:].tolist()):
        if e - s >= length:
            out.append(np.unique(grams[s : e - length + 1]))
        else:
            out.append(runs(np.array([s]), np.array([e])) ^ np.uint64(e - s) if e > s else np.zeros(1, np.uint64))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set."""
    joined = np.concatenate(sets)
    begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
    seeds = mix(np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64) * np.uint64(SEEDS[0]))
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for seed in seeds[b * WIDTH : (b + 1) * WIDTH]:
            key = mix(key * np.uint64(SEEDS[1]) + np.minimum.reduceat((joined ^ seed) * (seed | np.uint64(1)), begin))
        out[:, b] = key
    return out


def _signed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes the keys of its bands."""
    for b in batches:
        texts = b.column(b.num_columns - 1)
        at = text_bytes(texts)[1]
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, "right")) - 1)
            hi = min(hi, b.num_rows)
            keys = bands(shingles(texts.slice(lo, hi - lo), length)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)), lists], names=[*b.schema.names[:-1], "keys"])
            lo = hi


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is `least` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= least * (len(both) - shared) - 1e-9


def wide_print(shingled: np.ndarray) -> np.ndarray:
    """64 * WORDS bits: bit i is set if it is in over half of the shingles' mixed hashes."""
    salts = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(SEEDS[1]))
    counts = np.zeros(64 * WORDS, np.int64)
    for lo in range(0, len(shingled), 16_384):
        mixed = mix(shingled[lo : lo + 16_384, None] ^ salts[None, :]).astype(">u8").view(np.uint8)
        counts += np.unpackbits(mixed, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingled)).view(">u8").astype(np.uint64)


def radius(least: float) -> int:
    """Bits in which fingerprints of texts with that similarity differ, and six standard deviations more.

    The share of differing bits is the angle of the sets over pi; of sets with similarity s its cosine is 2s / (1 + s) at
    least. About one pair in a billion is beyond.
    """
    share = math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(64 * WORDS * share + 6 * (64 * WORDS * share * (1 - share)) ** 0.5)


def forest(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links among the alike whose components are those of all alike pairs within the radius."""
    vertical = planes(np.stack([wide_print(s) for s in sets]))
    root = list(range(len(ids)))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for lo in range(0, len(ids), QUERIES):
        hits = near(np.ascontiguousarray(vertical[:, lo // 64 : (lo + QUERIES) // 64]), vertical, len(ids), radius(least))
        for x in range(lo, min(lo + QUERIES, len(ids))):
            for y in np.flatnonzero(np.unpackbits(hits[x - lo].view(np.uint8), bitorder="little")[:x]).tolist():
                a, b = find(x), find(y)
                if a != b and alike(sets[x], sets[y], least):
                    root[max(a, b)] = min(a, b)
                    out.append((ids[x], ids[y]))
    return out


def _links(batches: Iterator[pa.RecordBatch], length: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tile, tile, id, text) come sorted by bucket and tiles. Whole buckets are compared together, up to BATCH texts or so: what they link is alike anyhow."""
    last, held, size = None, {}, 0

    def out() -> pa.RecordBatch:
        found = forest(list(held), list(held.values()), least)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
        of = b.column(3).to_pylist()
        for n in range(b.num_rows):
            if keys[n] != last and (len(held) >= BATCH or size >= SHINGLES):
                yield out()
                held, size = {}, 0
            last = keys[n]
            if of[n] not in held:
                held[of[n]] = shingles(b.column(4).slice(n, 1), length)[0]
                size += len(held[of[n]])
    if len(held) > 1:
        yield out()


def near_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of df that stay: of each component of texts with similarity `least` or more, one row with its smallest id (rows with null ids come last; of rows alike in id, any one).

    Null and empty texts and texts without words are alike; fewer words than a shingle are one shingle; repeated rows are
    copies; texts of any length are hashed whole; extra columns stay. Every link is exact; a pair of texts is missed if it
    shares no band (see BANDS) or is beyond the radius, and no path of other links joins it. An empty table gives an empty one.
    """
    short_batches(df.sparkSession)
    (rid,) = fresh(df, "rid")
    marked = materialise(df.withColumn(rid, F.monotonically_increasing_id()), "marked")
    read = with_key(marked.select(F.col(id_col).alias("id"), F.col(rid).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = dict(read.dtypes)["id"]
    keyed = read.select("k1", "k2", "id", "rid", "text").mapInArrow(partial(_signed, length=shingle), f"k1 long, k2 long, id {kind}, rid long, keys array<long>")
    order = F.struct(F.col("id").isNull().alias("n"), "id", "rid")
    texts = keyed.groupBy("k1", "k2").agg(F.min(order).alias("least"), F.first("keys").alias("keys"))
    texts = materialise(texts.select("least", F.col("least.rid").alias("node"), "keys"), "signed")
    dealt = texts.select(F.explode("keys").alias("v"), "node")
    buckets = dealt.groupBy("v").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("first")).filter("rows > 1")
    buckets = buckets.groupBy("rows", "members", "first").agg(F.min("v").alias("bucket"))  # the same members in several bands
    buckets = materialise(buckets.select("bucket", "rows"), "buckets")
    met = dealt.join(small(buckets, buckets.count(), 16), F.col("v") == F.col("bucket")).select("bucket", "rows", "node")
    met = materialise(met, "met", buckets)
    needed = met.select("node").distinct()
    theirs = read.select("rid", "text").join(small(needed, needed.count(), 16), F.col("rid") == F.col("node")).select("rid", "text")
    zero = F.lit(0).cast("long")
    tiles = F.when(F.col("rows") > TILE, F.ceil(F.col("rows") / F.lit(TILE / 2))).otherwise(F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    others = F.when(F.col("tiles") == 1, F.array(zero)).otherwise(F.filter(F.sequence(zero, F.col("tiles") - 1), lambda o: o != F.col("own")))
    spread = met.withColumn("tiles", tiles).withColumn("own", own).select("bucket", "node", "own", F.explode(others).alias("o"))
    spread = spread.select("bucket", F.least("o", "own").alias("i"), F.greatest("o", "own").alias("j"), "node")
    pairs = spread.join(theirs, F.col("node") == F.col("rid")).select("bucket", "i", "j", "node", "text")
    links = pairs.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(partial(_links, length=shingle, least=least), "a long, b long")
    roots = components(links)
    firsts = texts.select("least", F.col("node").alias("of")).join(roots, F.col("of") == F.col("node"), "left").groupBy(F.coalesce("root", "of").alias("root")).agg(F.min("least").alias("least"))
    keep = firsts.select(F.col("least.rid").alias(rid))
    return marked.join(keep, rid, "left_semi").select(*df.columns)
