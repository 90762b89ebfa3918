"""Record linkage: exact keys first, scored candidates for the rest, one-to-one assignment, sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import lcs_lengths

#: New and old keys that one row of a whole-pool comparison holds, and such rows that a task has.
NEW_BLOCK, OLD_CHUNK, ROWS = 256, 1024, 8
#: Old keys, those with the highest bounds, that are scored before the others.
FIRST = 32
#: Exact hits that a new row may have.
EXACT_HITS = 25


def tiered_match(new: DataFrame, old: DataFrame, key: str, block: str | None, new_id: str, old_id: str, score, threshold: float, rank: list, cap: int | None = EXACT_HITS) -> DataFrame:
    """new_id, old_id, tier (exact, similar or none), score, rank.

    Rows with equal keys match exactly, the first `cap` (None: all) by `rank` (columns over both sides: n_* and o_*). The others meet
    old rows that share the blocking column, so no pair outside a block is ever made, and keep their best above the
    threshold; a new id without any has one row of tier none. The blocking column must bound its groups (SURVEY: a volume).
    Without a blocking column they meet the whole pool, and the score is the indel ratio of the keys (see pool_best).
    """
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    nid, oid = F.col(f"n_{new_id}"), F.col(f"o_{old_id}")
    exact = n.join(o, (F.col(f"n_{key}") == F.col(f"o_{key}")) & (F.col(f"n_{key}") != ""))
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy(nid).orderBy(*rank, oid))).filter(F.lit(True) if cap is None else F.col("rank") <= cap)
    exact = exact.select(nid.alias(new_id), oid.alias(old_id), F.lit("exact").alias("tier"), F.lit(1.0).alias("score"), "rank")
    rest = n.join(o.select(F.col(f"o_{key}").alias("k")).distinct(), F.col(f"n_{key}") == F.col("k"), "left_anti")
    if block is None:
        pairs = pool_best(rest.select(nid, F.col(f"n_{key}").alias("n")), o.select(oid, F.col(f"o_{key}").alias("o")), threshold, new.count())
    else:
        pairs = rest.join(o, F.col(f"n_{block}") == F.col(f"o_{block}")).withColumn("score", score).filter(F.col("score") >= threshold)
    similar = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(nid).orderBy(F.desc("score"), oid))).filter("rank = 1")
    similar = similar.select(nid.alias(new_id), oid.alias(old_id), F.lit("similar").alias("tier"), "score", "rank")
    hits = exact.unionByName(similar)
    # every new id once, with its hits or with none
    out = new.select(new_id).distinct().join(hits, new_id, "left")
    return out.select(new_id, old_id, F.coalesce("tier", F.lit("none")).alias("tier"), "score", F.coalesce("rank", F.lit(1)).alias("rank"))


def _coded(news: list[str], olds: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Characters as numbers from 0: the new keys, how often each character is in each old key, the old keys side by side (a row for each place) and their lengths."""
    letters = np.frombuffer("".join(news + olds).encode("utf-32-le"), np.uint32)
    seen = np.bincount(letters) > 0
    codes = (np.cumsum(seen) - 1)[letters]
    lengths = np.array([len(x) for x in olds])
    *mine, rest = np.split(codes, np.cumsum([len(x) for x in news]))
    filled = np.arange(lengths.max()) < lengths[:, None]
    kinds = int(seen.sum())
    text = np.zeros(filled.shape, np.min_scalar_type(kinds))
    text[filled] = rest
    theirs = np.bincount(np.repeat(np.arange(len(olds)), lengths) + len(olds) * rest, minlength=kinds * len(olds)).reshape(kinds, len(olds))
    return mine, theirs.astype(np.int32), np.ascontiguousarray(text.T), lengths


def _best(batches: Iterator[pa.RecordBatch], threshold: float, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (block, its new rows, old rows) come sorted by block. An old key is scored unless the characters it shares with the new one can't reach the best so far."""
    last, best = None, {}

    def out() -> pa.RecordBatch:
        rows = [(n, o, s) for n, (s, o) in best.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], names=names)

    for b in batches:
        for block, news, olds in zip(*(c.to_pylist() for c in b.columns)):
            if block != last and best:
                yield out()
                best = {}
            last = block
            longest = max(len(new["k"]) for new in news) * (2 / threshold - 1)  # a longer one reaches the threshold with none
            olds = [old for old in olds if len(old["k"]) <= longest]
            if not olds:
                continue
            mine, theirs, columns, lengths = _coded([new["k"] for new in news], [old["k"] for old in olds])
            bounds = np.empty((len(news), len(olds)))
            for bound, own in zip(bounds, mine):
                common = np.zeros(len(olds), np.int32)
                for ch, times in zip(*np.unique(own, return_counts=True)):
                    common += np.minimum(theirs[ch], times)
                bound[:] = 2 * common / (lengths + len(own))
            highest = np.zeros(bounds.shape, bool)
            np.put_along_axis(highest, np.argpartition(-bounds, min(FIRST, len(olds)) - 1, axis=1)[:, :FIRST], True, axis=1)
            for some in (highest, ~highest):
                least = np.array([best.get(new["id"], (threshold, None))[0] for new in news])
                first, other = np.nonzero(some & (bounds >= least[:, None]))
                scores = 2 * lcs_lengths(mine, columns, lengths, first, other) / (lengths[other] + np.array([len(own) for own in mine])[first])
                ends = np.searchsorted(first, np.arange(len(news) + 1))
                for new, low, high in zip(news, ends, ends[1:]):
                    least, whose = best.get(new["id"], (threshold, None))
                    top = scores[low:high].max(initial=0)
                    if top >= least:
                        old = min(olds[i]["id"] for i in other[low:high][scores[low:high] == top].tolist())
                        if top > least or whose is None or old < whose:
                            best[new["id"]] = float(top), old
    if best:
        yield out()


def pool_best(new: DataFrame, old: DataFrame, threshold: float, rows: int | None = None) -> DataFrame:
    """new (id, key) and old (id, key), under any different names -> new id, old id, score: candidates among which is the old row with the best indel ratio of the whole pool (of equals the smallest id), if it reaches the threshold.

    The new rows (`rows` at most, if that is known) are a query set against the whole pool: every pair is scored or excluded by a bound
    on its score; empty keys match nothing. Old keys are grouped into chunks and met with blocks of new rows by an equi-join on the
    block, so neither side is gathered in one place and no row stands for a single pair. Old rows are counted before their keys are made.
    """
    (nid, nk), (oid, ok) = new.columns, old.columns
    spark = new.sparkSession
    kinds = dict(new.dtypes)[nid], dict(old.dtypes)[oid]
    pool = old.filter(F.col(ok) != "").groupBy(F.col(ok).alias("k")).agg(F.min(oid).alias("id"))
    wanted = new.filter(F.col(nk) != "").select(F.col(nid).alias("id"), F.col(nk).alias("k"))
    at = lambda many, by: F.pmod(F.xxhash64(by), F.lit(many))
    some, many = max(1, -(-(new.count() if rows is None else rows) // NEW_BLOCK)), max(1, -(-old.count() // OLD_CHUNK))
    blocks = wanted.groupBy(at(some, "id").alias("block")).agg(F.collect_list(F.struct("id", "k")).alias("news"))
    tasks = min(many, max(4 * spark.sparkContext.defaultParallelism, many * some // ROWS))
    chunks = pool.withColumn("chunk", at(many, "k")).repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("id", "k")).alias("olds"))
    met = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(some - 1).cast("long")))).join(blocks, "block").sortWithinPartitions("block").select("block", "news", "olds")
    names, shape = [nid, oid, "score"], spark.createDataFrame([], f"a {kinds[0]}, b {kinds[1]}, c double")
    return met.mapInArrow(partial(_best, threshold=threshold, names=names, schema=_arrow(shape)), f"`{nid}` {kinds[0]}, `{oid}` {kinds[1]}, score double")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def by_group(df: DataFrame, group: str, order: list, choose: Callable[[list[tuple]], list[tuple]], columns: list[str] | None = None) -> DataFrame:
    """df's rows that `choose` keeps of each group's rows in order, or rows that it makes of them (columns: those of df that these have, in order). Groups stream through their task one at a time; a group must fit in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = None
        for b in batches:
            place = b.schema.names.index(group)
            names = columns or b.schema.names
            schema = [b.schema.field(k) for k in names]
            kept: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][place] != row[place]:
                    kept += choose(held)
                    held = []
                held.append(row)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*kept), schema)], names=names)
        if held and (kept := choose(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*kept), schema)], names=names)

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, df.select(*columns).schema if columns else df.schema)


def greedy_assignment(scored: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one pairs per group: the best score first, of equals the smaller left, then right; used rows are out."""

    def choose(rows: list[tuple]) -> list[tuple]:
        taken_left, taken_right, keep = set(), set(), []
        for row in rows:
            if row[1] not in taken_left and row[2] not in taken_right:
                taken_left.add(row[1])
                taken_right.add(row[2])
                keep.append(row)
        return keep

    return by_group(scored.select(group, left, right, score).filter(F.col(score) >= least), group, [F.desc(score), left, right], choose)


def drop_overlapping(boxes: DataFrame, group: str, limit: float = 0.38, contained: float = 0.7) -> DataFrame:
    """Text boxes (group, id, x0, y0, x1, y1) that stay: larger first, those that overlap one that stays by more than the limits go."""

    def choose(rows: list[tuple]) -> list[tuple]:
        stay: list[tuple] = []
        for row in rows:
            _, _, x0, y0, x1, y1 = row
            mine = max(x1 - x0, 0) * max(y1 - y0, 0)
            for _, _, a0, b0, a1, b1 in stay:
                both = max(min(x1, a1) - max(x0, a0), 0) * max(min(y1, b1) - max(y0, b0), 0)
                union = mine + max(a1 - a0, 0) * max(b1 - b0, 0) - both
                if (union > 0 and both / union >= limit) or (mine > 0 and both / mine > contained):
                    break
            else:
                stay.append(row)
        return stay

    size = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    return by_group(boxes.select(group, "id", "x0", "y0", "x1", "y1"), group, [size.desc(), "id", "x0", "y0", "x1", "y1"], choose)


def interval_lookup(points: DataFrame, ranges: DataFrame, key: str, point: str, start: str, end: str, order: str) -> DataFrame:
    """Each point with the first range (by order) of its key that contains it."""
    r = ranges.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in ranges.columns if c != key])
    hit = points.join(r, (F.col(key) == F.col("r_key")) & F.col(point).between(F.col(f"r_{start}"), F.col(f"r_{end}")))
    first = F.row_number().over(Window.partitionBy(key, point).orderBy(f"r_{order}"))
    return hit.withColumn("rn", first).filter("rn = 1").drop("rn", "r_key")


def merge_by_key(first: DataFrame, second: DataFrame, keys: list[str], place: str, best: list[Column]) -> DataFrame:
    """The union with one row per key: the best by the order, at the place of the key's first row."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    w = Window.partitionBy(*keys)
    out = both.withColumn("at", F.min(F.struct("side", place)).over(w)).withColumn("rn", F.row_number().over(w.orderBy(*best, "side", place))).filter("rn = 1")
    return out.withColumn(place, F.row_number().over(Window.partitionBy(keys[0]).orderBy("at"))).drop("at", "rn", "side")


def multiset_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of both with `how`: kept (in both, by count), deleted or added."""
    label = lambda df, how: df.withColumn("how", F.lit(how))
    return label(old.intersectAll(new), "kept").unionByName(label(old.exceptAll(new), "deleted")).unionByName(label(new.exceptAll(old), "added"))


def overlay(base: DataFrame, over: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer join in which the second table's values go before the first's."""
    o = over.select(*keys, *[F.col(c).alias(f"over_{c}") for c in columns])
    return base.join(o, keys, "full_outer").select(*keys, *[F.coalesce(f"over_{c}", c).alias(c) for c in columns])


def content_store(blobs: DataFrame, stored: DataFrame, content: str) -> DataFrame:
    """New blobs by SHA-256, each once, that the store doesn't have."""
    return blobs.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti")


def unmatched(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return rows.join(matches.select(key).filter(F.col(key).isNotNull()), key, "left_anti")
