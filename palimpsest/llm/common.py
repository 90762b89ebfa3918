"""What the operators share: shared storage, text keys, hashing of many byte ranges at once."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a table may have to be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_LOCAL: list[str] = []
_WRITTEN: list[tuple[SparkSession, str, DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    return _LOCAL[0]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release() -> None:
    """Removes the tables that materialise() wrote and nobody removed."""
    while _WRITTEN:
        spark, path, _ = _WRITTEN.pop()
        try:
            remove(spark, path)
        except Exception:  # the session may have ended first
            continue


def materialise(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and outlives lost executors.

    done: tables from here that nothing needs any more; they are removed. So are the shuffle files of what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN.append((spark, path, out))
    for x in done:
        for entry in [w for w in _WRITTEN if w[2] is x]:
            _WRITTEN.remove(entry)
            remove(spark, entry[1])
    tidy(spark)
    return out


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of plans that the driver has let go; those of the last job stay until another has run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes are within BROADCAST_BYTES, else df, which is then joined by a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def with_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds k1 and k2, 128 bits that stand for the text (null: empty). Rows with equal texts share them, whatever their ids."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit(0x5DEECE66D), t)})


def short_batches(spark: SparkSession) -> None:
    """At most 512 rows go to Python at once, so that very long texts don't meet by thousands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 512:
        spark.conf.set(key, "512")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., which clash with none that an operator adds, and the new names by the old."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Hashing ------------------------------------------------------------------------------------------

SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(8)
def _powers(bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number that is 5 modulo 8, and of its inverse, modulo 2**64."""
    base = int(mix(np.array([seed], np.uint64))[0]) & ~7 | 5
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(2)
def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))


class RangeHash:
    """Hashes of any ranges [start, end) of a sequence of 64-bit units, from one pass of prefix sums.

    Equal ranges have equal hashes. Long ranges that differ can be made to collide (a polynomial modulo 2**64), so hashes
    only choose, sort and deal out; what counts as equal is settled by digests() or by the bytes themselves.
    """

    def __init__(self, units: np.ndarray, seed: int = SEEDS[0]):
        up, self.down = _powers(max(16, int(len(units)).bit_length()), seed)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, m: int) -> np.ndarray:
        """Of each m units in a row."""
        n = len(self.sums) - m
        return mix((self.sums[m:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests (XXH3) of ranges of bytes."""
    from xxhash import xxh3_64_intdigest as digest

    return np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words in data: short ones by RangeHash, which tells them apart, long ones by digests()."""
    out = RangeHash(byte_codes(SEEDS[0])[data])(starts, ends)
    long = np.flatnonzero(ends - starts > 32)
    if len(long):
        out[long] = digests(data.tobytes(), starts[long], ends[long])
    return out


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column end to end, and where each row begins, and the end."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows with at most `most` bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in rows laid end to end, and where each row's words begin, and the end."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = inside[1:][cuts] & inside[:-1][cuts]  # a word on either side of a row's end
    first[cuts[both]] = True
    last[cuts[both]] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)
