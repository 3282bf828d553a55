"""Exact order statistics of many groups without sorting any group in one task.

Doubles are mapped to integers in the same order. Each of four passes counts the next 16 bits of the values that share
the wanted values' leading bits, combining counts before the shuffle, and so fixes 16 more bits of every wanted value.
A pass moves counts only; the wanted values (groups x dims x ranks) are the only state and are bounded by the index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions import kernels as K

U64 = np.uint64


def ordered(x: np.ndarray) -> np.ndarray:
    bits = (x + 0.0).view(U64)
    return np.where(bits >> U64(63) == 1, ~bits, bits | U64(1 << 63))


def value_of(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], U64).view(np.float64)[0])


def order_statistics(vectors: DataFrame, dims: int, ranks: dict[tuple[int, int], list[int]], group: Column | None = None) -> dict[tuple[int, int], list[float]]:
    """The values at 0-based `ranks[(group, dim)]` of the group's values in that dimension, in rising order."""
    df = vectors.select((group if group is not None else F.lit(0)).cast("int").alias("grp"), "embedding").where("embedding is not null")
    spark = vectors.sparkSession
    # each wanted rank: its leading bits so far and its rank among the values that share them
    want = {(g, d, r): (0, r) for (g, d), rs in ranks.items() for r in rs}
    for shift in (48, 32, 16, 0):
        prefixes: dict[tuple[int, int], set[int]] = {}
        for (g, d, _), (p, _) in want.items():
            prefixes.setdefault((g, d), set()).add(p)
        shared = {k: np.array(sorted(v), U64) for k, v in prefixes.items()}

        def run(batches, shift=shift, shared=shared):
            for batch in batches:
                batch = K.whole(batch, "embedding", dims)
                grp, x = batch.column(0).to_numpy(zero_copy_only=False), ordered(K.matrix(batch.column(1), dims))
                out: list[list] = [[], [], [], [], []]
                for g in np.unique(grp):
                    own = x[grp == g]
                    for d in range(dims):
                        known = shared.get((int(g), d))
                        if known is None:
                            continue
                        key = own[:, d]
                        if shift < 48:
                            key = key[np.isin(key >> U64(shift + 16), known)]
                        values, n = np.unique(key >> U64(shift), return_counts=True)
                        for column, part in zip(out, (np.full(len(values), g), np.full(len(values), d), (values >> U64(16)).astype(np.int64), (values & U64(0xFFFF)).astype(np.int64), n)):
                            column.append(part)
                if out[0]:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)], ["grp", "dim", "prefix", "digit", "n"])

        counts = df.mapInArrow(run, "grp int, dim int, prefix long, digit int, n long").groupBy("grp", "dim", "prefix", "digit").agg(F.sum("n").alias("n"))
        # 65,536 digits a window at most; only the wanted ranks come to the driver
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("grp", "dim", "prefix").orderBy("digit")))
        asked = spark.createDataFrame([(g, d, r, p, left) for (g, d, r), (p, left) in want.items()], "grp int, dim int, rank long, prefix long, left_over long")
        found = upto.join(asked, ["grp", "dim", "prefix"]).where("left_over < upto and left_over >= upto - n")
        for x in found.select("grp", "dim", "rank", "prefix", "digit", (F.col("left_over") - F.col("upto") + F.col("n")).alias("left_over")).collect():
            want[(x.grp, x.dim, x.rank)] = (x.prefix << 16 | x.digit, x.left_over)
    return {(g, d): [value_of(want[(g, d, r)][0]) for r in rs] for (g, d), rs in ranks.items()}


def equi_depth_bounds(vectors: DataFrame, dims: int, cells: dict[int, list[int]], group: Column | None = None, margin: float = 0.001) -> dict[int, list[np.ndarray]]:
    """Bounds of each group's and dimension's cells: the extremes widened by `margin`, and the values at ceil(j n / cells)."""
    from vectorloom.operators.stats import moments

    size = {r.grp: r.n for r in moments(vectors, dims, group).where("dim = 0").collect()}
    ranks = {}
    for g, n in size.items():
        for d in range(dims):
            c = max(1, min(cells[g][d], n))
            ranks[(g, d)] = sorted({0, n - 1, *(min(n - 1, -(-j * n // c)) for j in range(1, c))})
    found = order_statistics(vectors, dims, ranks, group)
    out: dict[int, list[np.ndarray]] = {}
    for g, n in size.items():
        out[g] = []
        for d in range(dims):
            c, at = max(1, min(cells[g][d], n)), dict(zip(ranks[(g, d)], found[(g, d)]))
            out[g].append(np.array([at[0] - margin, *(at[min(n - 1, -(-j * n // c))] for j in range(1, c)), at[n - 1] + margin]))
    return out
