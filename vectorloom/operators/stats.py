"""Per-dimension and per-attribute statistics: partial sums in Arrow batches, then one small aggregate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import kernels as K


def vector_length(vectors: DataFrame, vector: str = "embedding") -> int:
    """The vectors' common number of dimensions (0 without vectors); ValueError if it is not common."""
    row = vectors.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if row.lo != row.hi:
        raise ValueError(f"vectors of {row.lo} to {row.hi} dimensions")
    return row.lo or 0


def moments(vectors: DataFrame, dims: int, group: Column | None = None) -> DataFrame:
    """(grp, dim, n, total, squares) of a vector column named embedding; grp is 0 without a group.

    A task keeps a row per group and dimension, so the shuffle holds tasks x groups x dims rows at most."""
    df = vectors.select((group if group is not None else F.lit(0)).cast("int").alias("grp"), "embedding").where("embedding is not null")

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            batch = K.whole(batch, "embedding", dims)
            grp, x = batch.column(0).to_numpy(zero_copy_only=False), K.matrix(batch.column(1), dims)
            for g in np.unique(grp):
                own = x[grp == g]
                part = np.stack([np.full(dims, float(len(own))), own.sum(0), (own * own).sum(0)])
                held[int(g)] = held[int(g)] + part if int(g) in held else part
        for g, (n, total, squares) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, g), pa.int32()), pa.array(np.arange(dims), pa.int32()), pa.array(n.astype(np.int64)), pa.array(total), pa.array(squares)], ["grp", "dim", "n", "total", "squares"])

    parts = df.mapInArrow(run, "grp int, dim int, n long, total double, squares double")
    return parts.groupBy("grp", "dim").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def dimension_means(vectors: DataFrame, dims: int, group: Column | None = None) -> DataFrame:
    return moments(vectors, dims, group).select("grp", "dim", "n", (F.col("total") / F.col("n")).alias("mean"))


def dimension_energies(vectors: DataFrame, dims: int, group: Column | None = None) -> DataFrame:
    """Population variance of each dimension."""
    mean = F.col("total") / F.col("n")
    return moments(vectors, dims, group).select("grp", "dim", F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean).alias("energy"))


def covariance(vectors: DataFrame, dims: int, group: Column | None = None) -> DataFrame:
    """(grp, i, j, cov) for i <= j: population covariance from partial Gram matrices (dims x dims a task and group)."""
    df = vectors.select((group if group is not None else F.lit(0)).cast("int").alias("grp"), "embedding").where("embedding is not null")
    i, j = np.triu_indices(dims + 1)  # the added column of ones gives counts and sums

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            batch = K.whole(batch, "embedding", dims)
            grp, x = batch.column(0).to_numpy(zero_copy_only=False), K.matrix(batch.column(1), dims)
            x = np.hstack([x, np.ones((len(x), 1))])
            for g in np.unique(grp):
                own = x[grp == g]
                held[int(g)] = held.get(int(g), 0) + own.T @ own
        for g, gram in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(gram[i, j])], ["grp", "i", "j", "s"])

    gram = df.mapInArrow(run, "grp int, i int, j int, s double").groupBy("grp", "i", "j").agg(F.sum("s").alias("s"))
    ones = gram.where(f"j = {dims}")
    count = ones.where(f"i = {dims}").select("grp", F.col("s").alias("n"))
    sums = ones.where(f"i < {dims}").select("grp", F.col("i").alias("d"), F.col("s").alias("t"))
    out = gram.where(f"j < {dims}").join(count, "grp").join(sums.toDF("grp", "i", "ti"), ["grp", "i"]).join(sums.toDF("grp", "j", "tj"), ["grp", "j"])
    return out.select("grp", "i", "j", (F.col("s") / F.col("n") - F.col("ti") / F.col("n") * F.col("tj") / F.col("n")).alias("cov"))


def attribute_stats(table: DataFrame, names: list[str]) -> DataFrame:
    """(attr, n, mean, std): population statistics of numeric columns, nulls left out."""
    aggs = [f(n).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))]
    row = F.array(*[F.struct(F.lit(n).alias("attr"), F.col(f"n_{i}").alias("n"), F.col(f"mean_{i}").alias("mean"), F.col(f"std_{i}").alias("std")) for i, n in enumerate(names)])
    return table.agg(*aggs).select(F.explode(row).alias("x")).select("x.*")


def histogram(table: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins between the least and the largest value; the last bin is closed."""
    lo, hi = table.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        return table.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (hi - lo) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(lo)) / width)) if width > 0 else F.lit(0)
    counted = table.where(F.col(column).isNotNull()).select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))
