"""Attribute predicates and label filters, as columns for SQL plans and as arrays for the scan kernels.

A query's predicates are an array of (attr, op, lo, hi) that must all hold; null attributes fail. Its labels must all be
in the row's labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.config import OPERATORS
from vectorloom.functions import columns as X
from vectorloom.functions import kernels as K

PREDICATES = "array<struct<attr:int,op:string,lo:double,hi:double>>"


def predicate(attr: int, op: str, lo, hi=None) -> Column:
    """One predicate as a struct; operands may be columns."""
    if op not in OPERATORS:
        raise ValueError(f"unknown predicate operator {op!r}")
    value = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(F.lit(attr).alias("attr"), F.lit(op).alias("op"), value(lo).alias("lo"), value(hi).alias("hi"))


def conjunction(tests: list[tuple[Column, str, Column, Column | None]]) -> Column:
    out = F.lit(True)
    for value, op, lo, hi in tests:
        out = out & X.holds(op, value, lo, hi)
    return out


def passing(attrs: np.ndarray, predicates: list | None) -> np.ndarray:
    ok = np.ones(len(attrs), bool)
    for p in predicates or []:
        lo, hi = (np.nan if p[x] is None else p[x] for x in ("lo", "hi"))
        ok &= K.holds(p["op"], attrs[:, p["attr"]], lo, hi)
    return ok


class Labels:
    """The label lists of a block's rows, flattened once for all queries."""

    def __init__(self, column=None, rows: int = 0):
        self.rows = rows
        self.row, _, self.label = K.flat_rows(column) if column is not None else (np.zeros(0, np.int64),) * 3

    def having(self, wanted: list | None) -> np.ndarray:
        """Which rows have all wanted labels."""
        ok = np.ones(self.rows, bool)
        for label in set(wanted or ()):
            has = np.zeros(self.rows, bool)
            has[self.row[self.label == label]] = True
            ok &= has
        return ok


def inverted(vectors: DataFrame) -> DataFrame:
    """(label, vec_id): posting rows; a list per label would not be bounded."""
    return vectors.select(F.explode(F.array_distinct("labels")).alias("label"), "vec_id")


def with_labels(vectors: DataFrame, wanted: list[int]) -> DataFrame:
    return vectors.where(F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), F.col("labels"))) == 0)


def may_hold(op: str, left: Column, right: Column, lo: Column, hi: Column | None = None) -> Column:
    """Whether a cell [left, right) can hold a value that passes: a superset of the predicate's rows."""
    low, high = (F.least(lo, hi), F.greatest(lo, hi)) if op == "B" else (lo, lo)
    return {"<": left < low, "<=": left <= low, "=": (left <= low) & (right > low), ">": right > low, ">=": right > low, "B": (right > low) & (left <= high)}[op]


def signatures(vectors: DataFrame, seed: int = 123, share: float = 0.1) -> DataFrame:
    """(vec_id, signature): each label owns about `share` of 63 hash-chosen bits; a vector has the bits of its labels.

    A prefilter: a vector with all wanted labels has all of their bits."""
    bits = X.total([F.when(F.pmod(F.xxhash64("label", F.lit(seed + i)), F.lit(1000)) < int(share * 1000), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(63)])
    return inverted(vectors).select("vec_id", bits.alias("b")).groupBy("vec_id").agg(F.bit_or("b").alias("signature"))
