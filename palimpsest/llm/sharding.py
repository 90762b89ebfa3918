"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, the rows in DataFrame functions.

How many rows each partition sends to each shard is drawn before any row moves: a multivariate hypergeometric draw with
the partitions' row counts and the shards' sizes as margins. Each partition permutes its rows and deals them out by its
row of the matrix; each shard then permutes what came. Partitions and the parts of shards that are permuted together are
made by hashes of a row number, so none holds more than about ROWS rows, whatever the keys are. Only the matrix, bounded by
CELLS, is made on the driver; rows are only touched by DataFrame functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, plain, small

#: Rows of a partition, and of a part of a shard, that are permuted together, about.
ROWS = 500_000
#: Partitions: a power of two, at least LEAST, with at most CELLS cells of the matrix (beyond, partitions grow and are sorted with spilling).
LEAST, CELLS = 64, 1 << 20


def hypergeometric(u: float, good: int, bad: int, drawn: int) -> int:
    """How many good ones there are among `drawn` without replacement, for a uniform u, by inversion.

    The chances come from the ratios of neighbours, from the mode outwards, and are divided by their own sum, so they
    add up to one at any size; beyond 15 standard deviations of the mode they are below the smallest step of u.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    reach = int(15 * (drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1))) ** 0.5) + 60
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    more = np.cumprod((good - up) / (up + 1) * ((drawn - up) / (bad - drawn + up + 1)))
    less = np.cumprod(down / (good - down + 1) * ((bad - drawn + down) / (drawn - down + 1)))
    heap = np.cumsum(np.concatenate([less[::-1], [1.0], more]))
    return mode - len(down) + int(np.searchsorted(heap, u * heap[-1], "right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition (of a power of two) sends to each shard; the margins are `rows` and the shards' sizes.

    Drawn by halving: a node's rows for each shard are dealt to its two halves, until each node is a partition.
    It is made on the driver: partitions x shards numbers, whatever the number of rows (see CELLS).
    """
    chance = np.random.default_rng(seed)
    out = np.zeros((len(rows), shards), np.int64)
    total = sum(rows)
    nodes = [(0, len(rows), [total // shards + (s < total % shards) for s in range(shards)])]
    while nodes:
        first, end, sends = nodes.pop()
        if end - first == 1:
            out[first] = sends
            continue
        half = (first + end) // 2
        drawn, rest, left = sum(rows[first:half]), sum(sends), []
        for n in sends:  # each shard in turn: how many of its rows are in the left half, given what the shards before took of it
            rest -= n
            left.append(hypergeometric(chance.random(), n, rest, drawn))
            drawn -= left[-1]
        nodes += [(first, half, left), (half, end, [n - m for n, m in zip(sends, left)])]
    return out


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (0 upwards without gaps in each shard), under names that df doesn't have.

    Every order of the rows is equally likely, up to the hash that stands in for chance; shard sizes differ by one at
    most, the first shards being the larger. Rows are told apart by a number given as they are first written, so nulls,
    ties and repeated rows need no care; the same seed over the same files in the same splits gives the same shards.
    An empty table gives an empty one.
    """
    named = [*df.columns, *fresh(df, "shard", "slot")]
    df, _ = plain(df)
    rid, part, shard, slot = "rid", "part", "shard", "slot"
    rows = materialise(df.withColumn(rid, F.monotonically_increasing_id()), "rows")
    n = rows.count()
    parts = LEAST
    while n > parts * ROWS and 2 * parts * shards <= CELLS:
        parts *= 2
    rows = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), F.col(rid)), F.lit(parts)))
    sizes = {r[0]: r[1] for r in rows.groupBy(part).agg(F.count("*")).collect()}  # one row a partition
    drawn = communication_matrix([sizes.get(p, 0) for p in range(parts)], shards, seed)
    matrix = df.sparkSession.createDataFrame([(p, x) for p, x in enumerate(np.cumsum(drawn, axis=1).tolist())], "of long, until array<long>")
    # permute in each partition and deal out
    order = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + 101), F.col(rid)), rid)
    dealt = rows.withColumn("place", F.row_number().over(order)).join(small(matrix, parts, 8 * shards + 32), F.col(part) == F.col("of"))
    dealt = dealt.withColumn(shard, F.size(F.filter("until", lambda u: u < F.col("place")))).drop("of", "until", "place", part)
    # permute in each shard: by a random number whose leading bits name the part
    many = max(1, -(-n // (shards * ROWS)))
    key = F.xxhash64(F.lit(seed + 202), F.col(rid))
    dealt = materialise(dealt.withColumn(part, F.pmod(F.shiftrightunsigned(key, 20), F.lit(many))), "dealt")
    offsets = dealt.groupBy(shard, part).agg(F.count("*").alias("n"))
    offsets = offsets.select(F.col(shard).alias("of"), F.col(part).alias("in"), (F.sum("n").over(Window.partitionBy(shard).orderBy(part)) - F.col("n")).alias("before"))
    inner = Window.partitionBy(shard, part).orderBy(key, rid)
    placed = dealt.withColumn("place", F.row_number().over(inner)).join(small(offsets, shards * many, 32), (F.col(shard) == F.col("of")) & (F.col(part) == F.col("in")))
    return placed.select(*df.columns, shard, (F.col("before") + F.col("place") - 1).cast("long").alias(slot)).toDF(*named)


def shards_of(spark: SparkSession, docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; the law is `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text")).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(sized, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
