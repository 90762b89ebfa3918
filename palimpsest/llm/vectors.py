"""Vectors as whole numbers: read from Arrow lists, kept as packed blocks, with arithmetic that is exact at any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Components are floor(SCALE * x), x as a double; multiplying by a power of two is exact.
SCALE = 1024.0


def read_vectors(column, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector (not null, no null or non-finite component, `dims` components where given), and their whole numbers.

    The numbers are doubles without a fraction; shorter vectors are filled with zeros up to the longest.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    ends = np.cumsum(length)
    broken = np.append(0, np.cumsum(~np.isfinite(flat)))
    good = np.asarray(column.is_valid()) & (broken[ends] == broken[ends - length])
    if dims is not None:
        good &= length == dims
    width = dims if dims is not None else int(length[good].max(initial=0))
    out = np.zeros((int(good.sum()), width))
    kept = length[good]
    row = np.repeat(np.arange(len(kept)), kept)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)] = flat[np.repeat(good, length)]
    with np.errstate(over="ignore"):
        out = np.floor(out * SCALE)
    if not np.isfinite(out).all():
        raise OverflowError(f"a component is beyond the doubles when multiplied by {SCALE:.0f}")
    return good, out


def pack(numbers: np.ndarray) -> tuple[str, bytes]:
    """The narrowest type that holds the whole numbers, and their bytes."""
    most = np.abs(numbers).max(initial=0)
    kind = "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"
    return kind, np.ascontiguousarray(numbers, "<" + kind).tobytes()


def unpack(kind: str, raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<" + kind).astype(np.float64).reshape(-1, width) if width else np.zeros((0, 0))


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The same numbers as doubles if all sums of products of two of them stay whole numbers below 2**53, else as Python integers."""
    most = max([1.0, *(float(np.abs(p).max(initial=0)) for p in parts)])
    width = max([1, *(p.shape[-1] for p in parts)])
    if 32 * width * most * most < 2.0**53:
        return [np.asarray(p, np.float64) for p in parts]
    return [np.frompyfunc(int, 1, 1)(p) if p.size else p.astype(object) for p in parts]


def fits(n: int) -> int:
    if not -(2**63) <= n < 2**63:
        raise OverflowError("a sum of products of these vectors does not fit a long")
    return n


def longs(numbers) -> pa.Array:
    """Exact whole numbers (doubles or Python integers) as Arrow longs."""
    numbers = np.asarray(numbers)
    if numbers.dtype == object:
        return pa.array([fits(int(x)) for x in numbers.tolist()], pa.int64())
    return pa.array(numbers.astype(np.int64))


def buffered(batches: Iterator[pa.RecordBatch], dims: int | None, rows: int) -> Iterator[tuple[list, np.ndarray]]:
    """(id, vector) batches -> ids and whole numbers of the rows that hold a vector, `rows` at a time (the last ones fewer)."""
    ids: list = []
    held: list[np.ndarray] = []

    def cut(n: int):
        nonlocal ids, held
        width = max(h.shape[1] for h in held)
        held = [np.pad(h, ((0, 0), (0, width - h.shape[1]))) for h in held]
        whole = np.concatenate(held)
        out = ids[:n], whole[:n]
        ids, held = ids[n:], [whole[n:]]
        return out

    for b in batches:
        good, numbers = read_vectors(b.column(1), dims)
        ids += b.column(0).filter(pa.array(good)).to_pylist()
        held.append(numbers)
        while len(ids) >= rows:
            yield cut(rows)
    if ids:
        yield cut(len(ids))
