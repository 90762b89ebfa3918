"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Blocks of vectors hold, for each component, postings (row, value) in order of value, cut into LEVELS quantised levels. A
query shifts each component by the block's least (or, where its own number is negative, greatest) value, so that no
contribution is negative, and takes the postings of a block by descending quantised impact, whatever the component.
What a row may still gain is bounded by the greatest contributions not yet taken. The query leaves the block when this
proves that all but a few rows are below the k-th best score known; those few are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small
from .vectors import buffered, exact, longs, pack, unpack

#: Rows of a block (at most 65,536), levels of a component's values, steps of a query's impacts.
BLOCK, LEVELS, STEPS = 8192, 64, 16
#: Possible members of a block's top k that may be scored: this share of the rows, or 4 k if that is more.
FEW = 1 / 32
#: Queries of a group, which meet all blocks together; more queries make more groups.
GROUP = 1 << 16
#: Pairs of a query and a row that a task scores, about.
PAIRS = 1 << 28


def _indexed(batches: Iterator[pa.RecordBatch], kind) -> Iterator[pa.RecordBatch]:
    for ids, numbers in buffered(batches, None, BLOCK):
        n, dims = numbers.shape
        order = numbers.argsort(0, kind="stable")
        low, high = (numbers.min(0), numbers.max(0)) if dims else (np.zeros(0), np.zeros(0))
        step = np.maximum((high - low) / LEVELS, 1e-300)
        ordered = np.take_along_axis(numbers, order, 0)
        level = np.minimum(((ordered - low) / step).astype(np.int64), LEVELS - 1)
        begins = np.stack([np.searchsorted(level[:, d], np.arange(LEVELS + 1)) for d in range(dims)]) if dims else np.zeros((0, LEVELS + 1))
        width, raw = pack(numbers)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(kind)), pa.array([dims], pa.int32()), pa.array([width]), pa.array([raw], pa.binary()), pa.array([order.T.astype("<u2").tobytes()], pa.binary()), pa.array([begins.astype("<i4").tobytes()], pa.binary())],
            names=["ids", "dims", "width", "numbers", "postings", "levels"],
        )


class Block:
    def __init__(self, dims: int, width: str, numbers: bytes, postings: bytes, levels: bytes, rows: int):
        self.numbers = unpack(width, numbers, dims) if dims else np.zeros((rows, 0))
        self.rows, self.dims = self.numbers.shape
        self.postings = np.frombuffer(postings, "<u2").reshape(dims, -1).astype(np.int64) if dims else np.zeros((0, rows), np.int64)
        self.begins = np.frombuffer(levels, "<i4").reshape(dims, LEVELS + 1)
        self.values = np.take_along_axis(self.numbers.T, self.postings, 1)

    def scores(self, query: np.ndarray, rows) -> np.ndarray:
        ours, q = exact(self.numbers[rows], query[None, : self.dims])
        return (ours * q).sum(1) if ours.dtype == object else ours @ q[0]

    def search(self, query: np.ndarray, k: int, least: float, own: int | None) -> np.ndarray:
        """The rows that may be among the k best of all, where `least` is a score that the k-th best is known to reach. Rows beyond the query's components count as zero there."""
        query = np.pad(query, (0, max(0, self.dims - len(query))))[: self.dims]
        n, dims = self.rows, self.dims
        weight, forward = np.abs(query), query < 0
        edge = np.where(forward, self.values[:, -1], self.values[:, 0]) if dims else np.zeros(0)
        base = float((query * edge).sum())
        reach = weight * np.abs(self.values[:, -1] - self.values[:, 0]) if dims else np.zeros(0)
        # what doubles may lose in all these sums; the exact scores decide in the end
        slack = 1e-12 * float((weight * (np.abs(self.values[:, 0]) + np.abs(self.values[:, -1]))).sum()) * (dims + 1) if dims else 0.0
        if base + reach.sum() + slack < least:
            return np.zeros(0, np.int64)
        gained = np.full(n, base)
        taken = np.where(forward, 0, n)  # postings [0, taken) or [taken, n) are done
        top = reach.max(initial=0.0)
        every = np.arange(dims)
        few = max(4 * k, int(n * FEW))
        possible = None
        for step in range(STEPS - 1, -1, -1):
            if top == 0:
                break
            # levels whose quantised impact is at least this step's
            level = np.where(reach > 0, np.ceil(np.minimum(LEVELS, LEVELS * (top * step / STEPS) / np.maximum(reach, 1e-300))), LEVELS).astype(np.int64)
            until = np.where(forward, self.begins[every, LEVELS - level], self.begins[every, level])
            until = np.where(forward, np.maximum(until, taken), np.minimum(until, taken)) if step else np.where(forward, n, 0)
            which = np.flatnonzero((until != taken) & (weight > 0))
            if len(which):
                rows, value, size = [], [], []
                for d in which.tolist():
                    a, b = (taken[d], until[d]) if forward[d] else (until[d], taken[d])
                    rows.append(self.postings[d, a:b])
                    value.append(self.values[d, a:b])
                    size.append(b - a)
                gain = np.abs(np.concatenate(value) - np.repeat(edge[which], size)) * np.repeat(weight[which], size)
                gained += np.bincount(np.concatenate(rows), gain, n)
                taken = until
            if step > STEPS // 2:
                continue
            # the greatest value of each component that no posting taken so far holds
            left = np.where(forward, taken < n, taken > 0)
            next_ = self.values[every, np.clip(np.where(forward, taken, taken - 1), 0, n - 1)]
            rest = float(np.where(left, weight * np.abs(next_ - edge), 0).sum()) + slack
            if n > k:
                sure = gained if own is None else np.delete(gained, own)
                if len(sure) >= k:
                    least = max(least, float(np.partition(sure, len(sure) - k)[len(sure) - k]) - slack)
            possible = np.flatnonzero(gained + rest >= least)
            if len(possible) <= few:
                break
        if possible is None:
            possible = np.flatnonzero(gained + slack >= least)
        return possible if own is None else possible[possible != own]


def _asked(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """One row per block with queries: their places, ids and numbers."""
    for b in batches:
        for i in range(b.num_rows):
            block, ids, dims, width, raw = (b.column(j)[i].as_py() for j in range(5))
            at = [j for j, x in enumerate(ids) if x is not None and x % every == 0]
            if at:
                numbers = unpack(width, raw, dims)[at] if dims else np.zeros((len(at), 0))
                width, raw = pack(numbers)
                columns = [pa.array([block]), pa.array([at], pa.list_(pa.int32())), pa.array([[ids[j] for j in at]], b.column(1).type), pa.array([dims], pa.int32()), pa.array([width]), pa.array([raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["asking", "places", "query_ids", "query_dims", "query_width", "queries"])


def _found(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(group, block, query block) rows -> each query's best k rows of this task, sent when the group ends."""
    best: dict[int, list] = {}
    ids_of: dict[int, tuple] = {}
    group = block_id = block = None
    kind = pa.int64()

    def send():
        rows = [(asking, place, q, r[1], r[0], r[2], r[3]) for asking, (places, ids) in ids_of.items() for place, q, held in zip(places, ids, best[asking]) for r in held]
        for i in range(0, len(rows), 50_000):
            a, p, q, v, s, rb, rp = zip(*rows[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(q, kind), pa.array(v, kind), pa.array(s, pa.int64()), pa.array(rb, pa.int64()), pa.array(rp, pa.int32())], names=["asking", "place", "query_id", "vec_id", "score", "block", "row"])
        best.clear()
        ids_of.clear()

    names = ["part", "block", "ids", "dims", "width", "numbers", "postings", "levels", "asking", "places", "query_ids", "query_dims", "query_width", "queries"]
    for b in batches:
        get = {n: b.column(j) for j, n in enumerate(names)}
        kind = b.schema.field(names.index("ids")).type.value_type
        for i in range(b.num_rows):
            if get["part"][i].as_py() != group:
                yield from send()
                group = get["part"][i].as_py()
            if get["block"][i].as_py() != block_id:
                block_id = get["block"][i].as_py()
                ids = get["ids"][i].as_py()
                block = Block(*(get[n][i].as_py() for n in ("dims", "width", "numbers", "postings", "levels")), len(ids))
            asking, places, dims = (get[n][i].as_py() for n in ("asking", "places", "query_dims"))
            if asking not in best:
                best[asking] = [[] for _ in places]
                ids_of[asking] = (places, get["query_ids"][i].as_py())
            held = best[asking]
            queries = unpack(get["query_width"][i].as_py(), get["queries"][i].as_py(), dims) if dims else np.zeros((len(places), 0))
            for j, place in enumerate(places):
                query = np.pad(queries[j], (0, max(0, block.dims - dims)))
                least = float(held[j][-1][0]) if len(held[j]) == k else -np.inf
                rows = block.search(query, k, least, place if asking == block_id else None)
                if len(rows):
                    scored = longs(block.scores(query, rows)).to_pylist()
                    more = [(s, ids[r], block_id, r) for s, r in zip(scored, rows.tolist()) if s >= least]
                    held[j] = sorted([*held[j], *more], key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2], x[3]))[:k]
    yield from send()


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank int (from 1), vec_id, score long: for each row whose id is divisible by `every` the k rows with the highest inner products.

    Components are floor(1024 * x); ties go to the smaller id, null ids last. The query's own row is no candidate; other rows
    with its id are, and each repeated row asks for itself and is found for itself. Vectors that are null or hold null or
    non-finite components take no part; components that a shorter vector lacks are zero, an empty vector scores zero.
    Rows with null ids are candidates only. Fewer candidates than k give fewer rows; an empty table gives an empty result;
    other columns are ignored. A score that doesn't fit a long raises OverflowError.

    Work grows as queries times rows, since a proof needs the greater part of the postings where vectors point
    everywhere; each query leaves a block as soon as it may. Queries go to every block, in groups of GROUP: broadcast
    while they are few, else both sides are dealt over the tasks by a shuffle join.
    """
    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    name = kind.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    index = rows.mapInArrow(partial(_indexed, kind=to_arrow_type(kind)), f"ids array<{name}>, dims int, width string, numbers binary, postings binary, levels binary")
    index = materialise(index.withColumn("block", F.monotonically_increasing_id()), "impact-index")
    asked = index.select("block", "ids", "dims", "width", "numbers").mapInArrow(partial(_asked, every=every), f"asking long, places array<int>, query_ids array<{name}>, query_dims int, query_width string, queries binary")
    asked = materialise(asked, "queries")
    queries, size = asked.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)), F.coalesce(F.sum(F.octet_length("queries") + F.size("places") * 12), F.lit(0))).first()
    blocks, total = index.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    groups = max(1, -(-queries // GROUP))
    parts = max(1, min(blocks, queries * total // PAIRS + 1))
    told = asked.withColumn("g", F.pmod(F.xxhash64("asking"), F.lit(groups)))
    if groups == 1:
        index = index.repartition(max(parts, min(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "block").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(1)))
        met = index.join(small(told.withColumnRenamed("g", "part"), 1, size), "part")
    else:
        part = lambda g: F.col("p") * groups + g
        index = index.withColumn("p", F.pmod(F.xxhash64("block"), F.lit(parts))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", part(F.col("g"))).drop("p", "g")
        told = told.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", part(F.col("g"))).drop("p", "g")
        met = index.join(told.hint("shuffle_merge"), "part")
    met = met.select("part", "block", "ids", "dims", "width", "numbers", "postings", "levels", "asking", "places", "query_ids", "query_dims", "query_width", "queries")
    found = met.mapInArrow(partial(_found, k=k), f"asking long, place int, query_id {name}, vec_id {name}, score long, block long, row int")
    order = Window.partitionBy("asking", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "block", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
