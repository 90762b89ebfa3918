"""Centroid clustering (Lloyd's rounds) by filtering kd-trees, exact in whole numbers.

Each partition cuts its vectors into trees once (Kanungo et al., 2002): a node holds its vectors' count, sum, sum of squares
and box. In a round the centroids go down each tree: those that another centroid strictly beats everywhere in a node's
box are dropped, a node with one centroid left is assigned whole, and leaves are resolved vector by vector. A task sends
one sum per centroid and component, whatever its rows; the driver sees only sums over all rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import SCALE, buffered, exact, fits, longs, pack, unpack

#: Vectors of a tree, and of a leaf.
TREE, LEAF = 8192, 32
#: Numbers that all centroids may hold together: they are sent to every task.
SENT = 1 << 20
# Rows of a task's sums that are not sums of a component.
COUNT, SQUARES = -1, -2


@dataclass
class Tree:
    """Nodes in the order in which they were cut; node i has children left[i] and left[i] + 1 (0: a leaf) and the points first[i] to last[i] - 1."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    squares: np.ndarray


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points -> their order in the tree, and first, last, left of each node. A node is cut at the median of its widest component; equal points stay together."""
    order = np.arange(len(points))
    nodes = [[0, len(points), 0]]
    i = 0
    while i < len(nodes):
        first, last, _ = nodes[i]
        if last - first > LEAF:
            mine = points[order[first:last]]
            spread = mine.max(0) - mine.min(0)
            wide = int(spread.argmax())
            if spread[wide] > 0:
                half = (last - first) // 2
                order[first:last] = order[first:last][np.argpartition(mine[:, wide], half)]
                nodes[i][2] = len(nodes)
                nodes += [[first, first + half, 0], [first + half, last, 0]]
        i += 1
    return order, np.array(nodes, np.int32)


def measured(points: np.ndarray, nodes: np.ndarray) -> Tree:
    """The tree over points in its order: boxes and sums, from the leaves up."""
    (points,) = exact(points)
    first, last, left = nodes.T
    low, high, sums = (np.zeros((len(nodes), points.shape[1]), points.dtype) for _ in range(3))
    squares = np.zeros(len(nodes), points.dtype)
    for i in range(len(nodes) - 1, -1, -1):
        if left[i]:
            a, b = left[i], left[i] + 1
            low[i], high[i] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
            sums[i], squares[i] = sums[a] + sums[b], squares[a] + squares[b]
        else:
            mine = points[first[i] : last[i]]
            low[i], high[i] = mine.min(0), mine.max(0)
            sums[i], squares[i] = mine.sum(0), (mine * mine).sum()
    return Tree(points, first, last, left, low, high, sums, squares)


def descend(tree: Tree, centroids: np.ndarray, settle) -> None:
    """Takes the centroids down the tree. settle(nodes, centroid of each) is told of whole nodes, settle(None, rows, centroid of each) of single points."""
    points, low, high, c = exact(tree.points, tree.low, tree.high, centroids)
    norms = (c * c).sum(1)
    never = 2 * (np.abs(norms).max() + (abs(points).max() + abs(c).max() + 1) ** 2 * 8 * c.shape[1])
    at = np.zeros(1, np.int64)
    alive = np.ones((1, len(c)), bool)
    while len(at):
        middle = low[at] + high[at]  # twice the box's middle
        near = np.where(alive, 2 * norms - 2 * (middle @ c.T), 2 * never).argmin(1)
        for z in np.unique(near):
            mine = np.flatnonzero(near == z)
            away = c - c[z]
            reach = high[at[mine]] @ np.maximum(away, 0).T + low[at[mine]] @ np.minimum(away, 0).T
            beaten = (norms - norms[z]) - 2 * reach > 0  # farther than z even at the box's corner that suits it best
            alive[mine] &= ~beaten.astype(bool)
        one = alive.sum(1) == 1
        if one.any():
            settle(at[one], alive[one].argmax(1))
        leaf = ~one & (tree.left[at] == 0)
        if leaf.any():
            nodes, open_ = at[leaf], alive[leaf]
            size = (tree.last - tree.first)[nodes].astype(np.int64)
            rows = np.arange(size.sum()) + np.repeat(tree.first[nodes] - (np.cumsum(size) - size), size)
            far = np.where(np.repeat(open_, size, axis=0), norms - 2 * (points[rows] @ c.T), never)
            settle(None, rows, far.argmin(1))  # the first of equals: the smaller number
        more = ~one & ~leaf
        at = (tree.left[at[more]][:, None] + np.arange(2)).ravel().astype(np.int64)
        alive = np.repeat(alive[more], 2, axis=0)


def _planted(batches: Iterator[pa.RecordBatch], dims: int, kind) -> Iterator[pa.RecordBatch]:
    for ids, numbers in buffered(batches, dims, TREE):
        order, nodes = grow(numbers)
        width, raw = pack(numbers[order])
        yield pa.RecordBatch.from_arrays(
            [pa.array([[ids[i] for i in order.tolist()]], pa.list_(kind)), pa.array([width]), pa.array([raw], pa.binary()), pa.array([nodes.tobytes()], pa.binary())],
            names=["ids", "width", "points", "nodes"],
        )


def _trees(batches: Iterator[pa.RecordBatch], dims: int):
    for b in batches:
        for i in range(b.num_rows):
            _, width, raw, nodes = (b.column(j)[i] for j in range(4))
            yield b.column(0).slice(i, 1).flatten(), measured(unpack(width.as_py(), raw.as_py(), dims), np.frombuffer(nodes.as_py(), np.int32).reshape(-1, 3))


def _summed(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """One row per centroid with vectors in this task and component: what its vectors add up to."""
    k, dims = len(centroids), len(centroids[0])
    c = np.array(centroids, object)
    totals = [[0] * (dims + 2) for _ in range(k)]

    for _, tree in _trees(batches, dims):

        def settle(nodes, *told):
            if nodes is None:
                rows, to = told
                n, s, q = np.ones(len(rows), np.int64), tree.points[rows], (tree.points[rows] ** 2).sum(1)
            else:
                (to,) = told
                n, s, q = (tree.last - tree.first)[nodes], tree.sums[nodes], tree.squares[nodes]
            for z in np.unique(to).tolist():
                mine = to == z
                row = totals[z]
                for j, x in enumerate(s[mine].sum(0).tolist()):
                    row[j] += int(x)
                row[dims] += int(n[mine].sum())
                row[dims + 1] += int(q[mine].sum())

        descend(tree, c, settle)
    if any(abs(x) >= 10**38 for row in totals for x in row):
        raise OverflowError("a sum of these vectors does not fit a long")
    rows = [(z, j, Decimal(x)) for z, row in enumerate(totals) if row[dims] for j, x in zip([*range(dims), COUNT, SQUARES], row)]
    if rows:
        z, j, x = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(j, pa.int32()), pa.array(x, pa.decimal128(38, 0))], names=["cluster", "part", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], told: list[tuple]) -> Iterator[pa.RecordBatch]:
    c0 = np.array(centroids, object)
    inertia, digest = pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told])
    every = sum(x[0] for x in told)
    for ids, tree in _trees(batches, c0.shape[1]):
        to = np.zeros(len(tree.points), np.int64)

        def settle(nodes, *found):
            if nodes is None:
                to[found[0]] = found[1]
                return
            for node, z in zip(nodes.tolist(), found[0].tolist()):
                to[tree.first[node] : tree.last[node]] = z

        descend(tree, c0, settle)
        points, c = exact(tree.points, c0)
        away = points - c[to]
        pick = pa.array(to)
        columns = [ids, pa.array(to.astype(np.int32)), longs((away * away).sum(1)), inertia.take(pick), pa.array(np.full(len(to), every, np.int64)), digest.take(pick)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])


def seeds(df: DataFrame, k: int, dims: int, salt: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest SHA-256 of `salt:id`, in that order; of equal ids the lesser vectors first. Null ids give none."""
    finite = F.forall(F.col("v").cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    named = df.filter(F.col("id").isNotNull() & (F.size("v") == dims) & finite)
    found = named.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[math.floor(SCALE * x) for x in r.v] for r in found]


def kmeans(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, id_col: str = "vec_id", vector: str = "embedding", salt: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """The rows' clusters after `rounds` rounds from seeds(), and the final centroids.

    id_col, cluster int, distance long (squared), cluster_inertia, inertia long, centroid_sha256: one row per row of df whose
    vector has exactly `dims` components, none null or non-finite; other rows give none. Components are floor(1024 * x).
    Ties go to the smaller number; a centroid without vectors stays where it is; fewer vectors with an id than k give
    fewer centroids, and none give an empty result. Repeated rows and ids stay and count each; null ids take part but are no
    seeds; other columns are ignored. Sums are exact whole numbers; a distance or an inertia that doesn't fit a long
    raises OverflowError. Rounds that would change nothing are not run.
    """
    if k * dims > SENT:
        raise ValueError(f"{k} centroids of {dims} components are more than {SENT} numbers")
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    now = seeds(rows, k, dims, salt)
    out = f"{kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not now:
        return df.sparkSession.createDataFrame([], f"id {out}").withColumnRenamed("id", id_col), now
    from pyspark.sql.pandas.types import to_arrow_type

    planted = rows.mapInArrow(partial(_planted, dims=dims, kind=to_arrow_type(kind)), f"ids array<{kind.simpleString()}>, width string, points binary, nodes binary")
    trees = materialise(planted, "kd-trees")

    def totals(centroids: list[list[int]]) -> dict[int, dict[int, int]]:
        """What each centroid's vectors add up to: k times (dims + 2) numbers."""
        parts = trees.mapInArrow(partial(_summed, centroids=centroids), "cluster int, part int, total decimal(38,0)")
        found: dict[int, dict[int, int]] = {}
        for z, j, x in parts.groupBy("cluster", "part").agg(F.sum("total")).collect():
            found.setdefault(z, {})[j] = int(x)
        return found

    for _ in range(rounds):
        sums = totals(now)
        moved = [[sums[z][j] // sums[z][COUNT] for j in range(dims)] if z in sums else c for z, c in enumerate(now)]
        if moved == now:
            break
        now = moved
    sums = totals(now)
    told = []
    for z, c in enumerate(now):
        s = sums.get(z, {})
        spread = s.get(SQUARES, 0) - 2 * sum(x * s.get(j, 0) for j, x in enumerate(c)) + s.get(COUNT, 0) * sum(x * x for x in c)
        told.append((fits(spread), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()))
    fits(sum(x[0] for x in told))
    return trees.mapInArrow(partial(_assigned, centroids=now, told=told), f"id {out}").withColumnRenamed("id", id_col), now
