"""Vectorised byte kernels shared by the text operators: Arrow access, word boundaries, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, _SEGMENT + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 row offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if values is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(values, np.uint8)[at[0] : at[-1]], at - at[0]


def row_groups(offsets: np.ndarray, limit: int = _SEGMENT) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `limit` bytes each (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of non-separators [^\\x20\\x09-\\x0D]+, and the row offsets into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = _SEPARATOR[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans in rising order: a polynomial over random byte values, then mixed with the length.

    Spans are handled in segments, so the power tables stay at about a megabyte of text whatever the row length."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        first = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, first + _SEGMENT, "right")))
        last = int(end[j - 1])
        up, down = _power_tables(last - first + 1)
        sums = np.zeros(last - first + 1, U64)
        np.cumsum(_BYTE[data[first:last]] * up[: last - first], out=sums[1:])
        a, b = start[i:j] - first, end[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out ^ U64(salt)) if salt else mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the row offsets into them."""
    start, end, rows = words(data, offsets)
    return span_hashes(_LOWER[data], start, end), rows


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position, over the whole array (len - n + 1 of them)."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(hashes) - n + 1, U64)
    for i in range(n):
        out = (out ^ hashes[i : len(hashes) - n + 1 + i]) * U64(0x9FB21C651E98DF25) + U64(0x632BE59BD9B4E019 + i)
        out ^= out >> U64(29)
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct n-word shingle hashes; with fewer words the whole sequence is one, without words none."""
    hashes, rows = word_hashes(data, offsets)
    grams = chain(hashes, n)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(chain(hashes[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out
