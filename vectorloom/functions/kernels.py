"""NumPy kernels that run on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column's row number and place of every element, and the elements as doubles, nulls as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    return row, place, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def whole(batch: pa.RecordBatch | pa.Table, name: str, dims: int):
    """The batch without the rows whose vector is null, of another length, or holds nulls: they take no part."""
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not column.null_count and len(column.flatten()) == dims * len(column) and not column.flatten().null_count:
        length = pc.list_value_length(column)
        if not len(column) or pc.all(pc.equal(length, dims)).as_py():
            return batch
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    row, _, _ = flat_rows(column)
    holes = column.flatten().is_null().to_numpy(zero_copy_only=False)
    good = good & (np.bincount(row[holes], minlength=len(column)) == 0)
    return batch.filter(pa.array(good))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of `whole` rows as rows x dims doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def ragged(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows x width doubles; nulls and missing elements are NaN."""
    out = np.full((len(column), width), np.nan)
    row, place, x = flat_rows(column)
    some = place < width
    out[row[some], place[some]] = x[some]
    return out


def bytes_matrix(column: pa.Array) -> np.ndarray:
    """A binary column of values of one length as rows x bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """rows x n numbers as a list column."""
    n = rows.shape[1] if rows.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n, pa.int32()), pa.array(rows.ravel(), kind))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def holds(op: str, value: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """An attribute predicate on doubles; NaN fails."""
    if op == "B":
        lo, hi = min(lo, hi), max(lo, hi)
        return (value > lo) & (value <= hi)
    return {"<": np.less, "<=": np.less_equal, "=": np.equal, ">": np.greater, ">=": np.greater_equal}[op](value, lo)


def cells(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """Cell of each element; bounds of each dimension rise. Values outside go to the nearest cell."""
    out = np.empty(x.shape, np.int16)
    for j, b in enumerate(bounds):
        out[:, j] = np.clip(np.searchsorted(b, x[:, j], "right") - 1, 0, len(b) - 2)
    return out


def query_cells(q: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """First cell whose upper bound isn't below the query; the number of cells if it lies above all."""
    return np.array([min(int(np.searchsorted(b[1:], x, "left")), len(b) - 1) for x, b in zip(q, bounds)])


def bound_tables(q: np.ndarray, bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared least and greatest distance from the query to each cell (cells x dims, zero beyond a dimension's cells)."""
    own = query_cells(q, bounds)
    most = max(len(b) for b in bounds) - 1
    low, high = np.zeros((most, len(q))), np.zeros((most, len(q)))
    for j, b in enumerate(bounds):
        left, right = (b[:-1] - q[j]) ** 2, (b[1:] - q[j]) ** 2
        low[: len(b) - 1, j], high[: len(b) - 1, j] = np.minimum(left, right), np.maximum(left, right)
        if own[j] < len(b) - 1:
            low[own[j], j] = 0
    return low, high


def all_bound_tables(q: np.ndarray, bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """bound_tables of every row of q (rows x cells x dims), a dimension at a time."""
    most = max(len(b) for b in bounds) - 1
    low, high = np.zeros((len(q), most, len(bounds))), np.zeros((len(q), most, len(bounds)))
    for j, b in enumerate(bounds):
        left, right = (b[:-1] - q[:, j, None]) ** 2, (b[1:] - q[:, j, None]) ** 2
        low[:, : len(b) - 1, j], high[:, : len(b) - 1, j] = np.minimum(left, right), np.maximum(left, right)
        own = np.searchsorted(b[1:], q[:, j], "left")
        inside = np.flatnonzero(own < len(b) - 1)
        low[inside, own[inside], j] = 0
    return low, high


def symmetric_tables(q: np.ndarray, bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As bound_tables, from the query's cell alone: between two cells the gap, and the distance of the far sides."""
    most = max(len(b) for b in bounds) - 1
    low, high = np.zeros((most, len(q))), np.zeros((most, len(q)))
    for j, b in enumerate(bounds):
        i = int(np.clip(np.searchsorted(b, q[j], "right") - 1, 0, len(b) - 2))
        left, right = b[:-1], b[1:]
        gap = np.maximum(0, np.maximum(left - b[i + 1], b[i] - right))
        low[: len(b) - 1, j], high[: len(b) - 1, j] = gap**2, np.maximum(np.abs(right - b[i]), np.abs(b[i + 1] - left)) ** 2
    return low, high


def bounds_of(codes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(codes.shape[1])
    return tuple(np.sqrt(t[codes, at].sum(1)) for t in tables)


def pack_codes(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """rows x bytes: each row's codes as one bit string, `bits` bits a dimension, most significant bit first."""
    spread = [((codes[:, j, None] >> np.arange(b - 1, -1, -1)) & 1).astype(np.uint8) for j, b in enumerate(bits) if b]
    return np.packbits(np.hstack(spread), axis=1) if spread else np.zeros((len(codes), 0), np.uint8)


def unpack_codes(packed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    flat = np.unpackbits(packed, axis=1)
    out, at = np.zeros((len(packed), len(bits)), np.int16), 0
    for j, b in enumerate(bits):
        if b:
            out[:, j] = flat[:, at : at + b] @ (1 << np.arange(b - 1, -1, -1))
            at += b
    return out


def top(values: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest values, ties by id, in order."""
    if len(values) > n:
        cut = np.partition(values, n - 1)[n - 1]
        some = np.flatnonzero(values <= cut)
    else:
        some = np.arange(len(values))
    return some[np.lexsort((ids[some], values[some]))][:n]


def kmeans(x: np.ndarray, n: int, seed: int = 0, rounds: int = 30, tolerance: float = 1e-4) -> np.ndarray:
    """Centres by Lloyd's algorithm from k-means++ seeds."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(n, len(x)):
        share = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
        centres = np.vstack([centres, x[rng.choice(len(x), p=share)]])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = squared(x, centres).argmin(1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        moved = ((new - centres) ** 2).sum()
        centres = new
        if moved <= tolerance * max(1e-12, x.var(0).sum()):
            break
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)
