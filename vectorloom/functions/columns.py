"""Column expressions over vectors, codes and predicates; all stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def element(vector: Column | str, i: int) -> Column:
    return F.get(F.col(vector) if isinstance(vector, str) else vector, F.lit(i)).cast("double")


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def l2(a: str, b: str, dims: int) -> Column:
    """Euclidean distance as one generated sum."""
    return F.sqrt(total([(element(a, i) - element(b, i)) * (element(a, i) - element(b, i)) for i in range(dims)]))


def sign_word(bits: list[Column]) -> Column:
    """Up to 63 booleans as one BIGINT, the first in the lowest bit."""
    return total([F.when(b, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, b in enumerate(bits)])


def hamming(a: list[Column], b: list[Column]) -> Column:
    return total([F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)]).cast("long")


def cell(value: Column, bounds: Column) -> Column:
    """The cell i with bounds[i] <= value < bounds[i + 1]; values outside go to the nearest cell."""
    below = F.size(F.filter(bounds, lambda b: b <= value)) - 1
    return F.greatest(F.lit(0), F.least(below, F.size(bounds) - 2))


def holds(op: str, value: Column, lo: Column, hi: Column | None = None) -> Column:
    """An attribute predicate; null attributes fail. B: above lo and up to hi, in either order of the operands."""
    tests = {"<": lambda: value < lo, "<=": lambda: value <= lo, "=": lambda: value == lo, ">": lambda: value > lo, ">=": lambda: value >= lo, "B": lambda: (value > F.least(lo, hi)) & (value <= F.greatest(lo, hi))}
    if op not in tests:
        raise ValueError(f"unknown predicate operator {op!r}")
    return F.coalesce(tests[op](), F.lit(False))


def standardised(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std; 0 where std is 0."""
    return F.when(std > 0, (value - mean) / std).when(value.isNotNull(), F.lit(0.0))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def recall(hits: Column, k: int, true_matches: Column) -> Column:
    """hits over min(k, true matches); 1 where there is nothing to find."""
    return F.when(true_matches > 0, hits / F.least(F.lit(k), true_matches)).otherwise(F.lit(1.0))
