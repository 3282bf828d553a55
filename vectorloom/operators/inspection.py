"""Looking into an index: one vector's row for each dimension, visits by partition, and boundary comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import columns as X
from vectorloom.functions import kernels as K
from vectorloom.operators.index import Model

FIELDS = "vec_id long, part_id int, dim int, raw double, turned double, cell int, lo double, hi double, lower double, upper double"


def inspect(index: DataFrame, model: Model, query: list[float], which: Column) -> DataFrame:
    """For each vector that `which` picks and each dimension: the value as it was and turned, its cell and the cell's
    bounds, and the least and greatest distance from the query in that dimension."""
    shared = index.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            batch = K.whole(batch, "embedding", m.dims)
            x = K.matrix(batch.column(2), m.dims)
            for v, p, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), x):
                one = m.parts[p]
                z, q = one.turn(row[None, :])[0], one.turn(np.array([query]))[0]
                cell = one.codes(z[None, :])[0].astype(int)
                low, high = K.bound_tables(q, one.bounds)
                at = np.arange(m.dims)
                columns = [np.full(m.dims, v), np.full(m.dims, p, np.int32), at.astype(np.int32), row, z, cell.astype(np.int32), np.array([b[c] for b, c in zip(one.bounds, cell)]), np.array([b[c + 1] for b, c in zip(one.bounds, cell)]), np.sqrt(low[cell, at]), np.sqrt(high[cell, at])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "part_id", "dim", "raw", "turned", "cell", "lo", "hi", "lower", "upper"])

    return index.where(which).select("vec_id", "part_id", "embedding").mapInArrow(run, FIELDS)


def visits(chosen: DataFrame) -> DataFrame:
    """(part_id, visits, candidates): how many queries visit each partition, and how many candidates they find there."""
    return chosen.groupBy("part_id").agg(F.count("*").alias("visits"), F.sum("n").alias("candidates"))


def unequal(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two tables of bounds whose values differ by more than the tolerance."""
    both = a.join(b.withColumnRenamed(value, "other"), keys)
    return both.where(~X.close(F.col(value), F.col("other")))
