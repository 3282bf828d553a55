"""Validated settings of an index and of a search."""

from __future__ import annotations

from dataclasses import dataclass

OPERATORS = ("<", "<=", "=", ">", ">=", "B")
MODES = ("exact", "approx", "approx_nocut")
BOUNDS = ("adc", "sdc")
#: Most cells of a dimension, so that a cell number fits a byte.
MAX_CELLS = 255


@dataclass(frozen=True)
class IndexConfig:
    """How vectors are partitioned and quantised.

    bits: the budget over all dimensions. uniform: the same cells everywhere instead of the greedy allocation.
    sample_rows: bound of the sample on which rotations, centroids and cell refinement are fitted."""

    partitions: int = 4
    bits: int = 256
    uniform: bool = False
    rotate: bool = True
    lloyd_rounds: int = 20
    lloyd_change: float = 0.005
    balance: float = 0.1
    sample_rows: int = 20_000
    seed: int = 0

    def __post_init__(self):
        if self.partitions < 1 or self.bits < 0 or not 0 < self.balance < 1 or self.sample_rows < 1:
            raise ValueError(f"invalid index settings: {self}")


@dataclass(frozen=True)
class SearchConfig:
    """k results; partitions within centroid_factor of the nearest are visited; `percent` of the candidates pass the sign
    cut (k * refine * percent at least); k * refine candidates of each partition are ranked exactly."""

    k: int = 10
    mode: str = "approx"
    bound: str = "adc"
    centroid_factor: float = 1.15
    percent: float = 10
    refine: float = 2
    strict: bool = True

    def __post_init__(self):
        if self.k < 1 or self.mode not in MODES or self.bound not in BOUNDS or self.centroid_factor < 1 or not 0 < self.percent <= 100 or self.refine < 1:
            raise ValueError(f"invalid search settings: {self}")

    @property
    def shortlist(self) -> int:
        return int(self.k * self.refine)
