"""Bit allocation, cell refinement, and the codes of vectors."""

from __future__ import annotations

import numpy as np

from vectorloom.config import MAX_CELLS


def uniform_cells(budget: int, dims: int) -> list[int]:
    return [min(MAX_CELLS, 1 << budget // dims)] * dims


def greedy_cells(energies: list[float], budget: int, rows: int) -> list[int]:
    """Cells a dimension: the most energetic one gets a bit, which quarters its energy, until the budget is spent.

    A dimension stops at MAX_CELLS cells or when it would have more cells than rows; its bit goes to another one."""
    energy, cells = np.array(energies, float), np.ones(len(energies), int)
    live = energy > 0
    while budget > 0 and live.any():
        at = int(np.where(live, energy, -np.inf).argmax())
        more = min(MAX_CELLS, cells[at] * 2)
        if more == cells[at] or more > rows:
            live[at] = False
            continue
        cells[at], energy[at], budget = more, energy[at] / 4, budget - 1
    return cells.tolist()


def bits_of(cells: list[int]) -> np.ndarray:
    return np.array([int(np.ceil(np.log2(c))) if c > 1 else 0 for c in cells])


def lloyd(x: np.ndarray, bounds: np.ndarray, rounds: int = 250, change: float = 0.005) -> np.ndarray:
    """Bounds midway between the means of the cells, repeated until the squared error falls by less than `change`.

    An empty cell's mean is its middle. The outer bounds stay. The best bounds seen are returned."""
    x, best, least, last = np.sort(x), bounds, np.inf, np.inf
    sums, squares = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    b = bounds.astype(float)
    for _ in range(rounds):
        at = np.searchsorted(x, b, "left")
        at[0], at[-1] = 0, len(x)
        n, s = np.diff(at), sums[at[1:]] - sums[at[:-1]]
        centre = np.where(n > 0, s / np.maximum(n, 1), (b[:-1] + b[1:]) / 2)
        error = float((squares[at[1:]] - squares[at[:-1]] - np.where(n > 0, s * s / np.maximum(n, 1), 0)).sum())
        if error < least:
            least, best = error, b.copy()
        if last < np.inf and last - error <= change * max(last, 1e-300):
            break
        last = error
        centre = np.sort(centre)
        b = np.concatenate([b[:1], (centre[:-1] + centre[1:]) / 2, b[-1:]])
    return best


def squared_error(x: np.ndarray, bounds: np.ndarray) -> float:
    """Sum of squared distances to the cells' means."""
    own = np.clip(np.searchsorted(bounds, x, "right") - 1, 0, len(bounds) - 2)
    n = np.bincount(own, minlength=len(bounds) - 1)
    mean = np.bincount(own, x, len(bounds) - 1) / np.maximum(n, 1)
    return float(((x - mean[own]) ** 2).sum())
