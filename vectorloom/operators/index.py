"""Building an index: rotation, balanced partitions, cells, and the table of codes.

Everything learned (rotations, centroids, prices, refined cells) is fitted on a bounded sample that is chosen by hash;
means, covariances, sizes and equi-depth bounds cover all rows. The model has partitions x dims numbers (and a dims x
dims rotation a partition) and is broadcast; vectors are never gathered."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.config import IndexConfig
from vectorloom.functions import kernels as K
from vectorloom.operators import quantize, stats
from vectorloom.operators.quantiles import equi_depth_bounds


@dataclass
class Part:
    mean: np.ndarray
    rotation: np.ndarray | None  # applied to centred vectors, as rows; None: identity without centring
    cut: np.ndarray  # the value above which a sign bit is 1
    cells: list[int]
    bounds: list[np.ndarray]
    centroid: np.ndarray
    population: int

    def turn(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else (x - self.mean) @ self.rotation

    @property
    def bits(self) -> np.ndarray:
        return quantize.bits_of([len(b) - 1 for b in self.bounds])

    def codes(self, z: np.ndarray) -> np.ndarray:
        return K.cells(z, self.bounds)

    def signs(self, z: np.ndarray) -> np.ndarray:
        return np.packbits(z > self.cut, axis=1)


@dataclass
class Model:
    dims: int
    config: IndexConfig
    parts: dict[int, Part] = field(default_factory=dict)
    mean: np.ndarray | None = None
    rotation: np.ndarray | None = None
    centres: np.ndarray | None = None
    prices: np.ndarray | None = None

    def assign(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.rotation
        return (K.squared(z, self.centres) + self.prices).argmin(1).astype(np.int32)


def sampled(vectors: DataFrame, rows: int, dims: int) -> np.ndarray:
    """At most `rows` vectors, those of smallest hash of vec_id."""
    got = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows)
    return K.matrix(K.whole(got.select("embedding").toArrow(), "embedding", dims).column("embedding"), dims)


def covariance_matrix(vectors: DataFrame, dims: int, group: Column | None = None) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for r in stats.covariance(vectors, dims, group).toLocalIterator():
        c = out.setdefault(r.grp, np.zeros((dims, dims)))
        c[r.i, r.j] = c[r.j, r.i] = r["cov"]
    return out


def decorrelating(cov: np.ndarray) -> np.ndarray:
    """Eigenvectors as columns, by falling eigenvalue; the largest component of each is positive."""
    value, vector = np.linalg.eigh(cov)
    vector = vector[:, np.argsort(-value, kind="stable")]
    return vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(len(cov))])


def means_of(vectors: DataFrame, dims: int, group: Column | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per group: rows, mean and variance of each dimension."""
    out: dict = {}
    for r in stats.moments(vectors, dims, group).collect():
        n, m, v = out.setdefault(r.grp, (r.n, np.zeros(dims), np.zeros(dims)))
        m[r.dim], v[r.dim] = r.total / r.n, max(0.0, r.squares / r.n - (r.total / r.n) ** 2)
    return out


def balanced_prices(z: np.ndarray, centres: np.ndarray, balance: float, rounds: int = 300) -> np.ndarray:
    """A price for each centre such that nearest-by-price parts differ from the mean size by `balance` at most."""
    d2 = K.squared(z, centres)
    price, fair = np.zeros(len(centres)), len(z) / len(centres)
    step = d2.std() / 2 if len(centres) > 1 else 0.0
    best, spread = price.copy(), np.inf
    for _ in range(rounds):
        size = np.bincount((d2 + price).argmin(1), minlength=len(centres))
        off = np.abs(size / fair - 1).max()
        if off < spread:
            best, spread = price.copy(), off
        if off <= balance / 4:
            break
        price = price + step * np.clip(size / fair - 1, -1, 1)
        step *= 0.985
    return best


def partitioner(vectors: DataFrame, dims: int, config: IndexConfig) -> Model:
    """A model with global rotation, centres and prices. Prices from the sample are refined on the sizes of all rows."""
    (_, mean, _), cov = means_of(vectors, dims)[0], covariance_matrix(vectors, dims)[0]
    rotation = decorrelating(cov) if config.rotate else np.eye(dims)
    z = (sampled(vectors, config.sample_rows, dims) - mean) @ rotation
    centres = K.kmeans(z, config.partitions, config.seed)
    model = Model(dims, config, mean=mean, rotation=rotation, centres=centres, prices=balanced_prices(z, centres, config.balance))
    step, last = K.squared(z, centres).std() / 8, None
    best = (np.inf, model.prices)
    for _ in range(12):
        size = np.zeros(len(centres))
        for r in partition(vectors, model).groupBy("part_id").count().collect():
            size[r.part_id] = r["count"]
        off = size / (size.sum() / len(centres)) - 1
        if np.abs(off).max() < best[0]:
            best = (np.abs(off).max(), model.prices.copy())
        if best[0] <= config.balance:
            break
        if last is not None and np.abs(off).max() >= np.abs(last).max():
            step /= 2
        model.prices, last = model.prices + step * np.clip(off, -1, 1), off
    model.prices = best[1]
    return model


def partition(vectors: DataFrame, model: Model) -> DataFrame:
    """vectors with part_id, the partition of least squared distance plus price."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # partitions x dims numbers

    def run(batches):
        for batch in batches:
            batch = K.whole(batch, "embedding", shared.value.dims)
            x = K.matrix(batch.column("embedding"), shared.value.dims)
            part = shared.value.assign(x) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], [*batch.schema.names, "part_id"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.where("embedding is not null").mapInArrow(run, f"{kept}, part_id int")


def fit_parts(parted: DataFrame, model: Model, rotate: bool, uniform: bool, refine: bool) -> Model:
    """Fills model.parts from vectors with part_id."""
    dims, config, group = model.dims, model.config, F.col("part_id")
    stat = means_of(parted, dims, group)
    cov = covariance_matrix(parted, dims, group) if rotate else {}
    for p, (n, mean, _) in stat.items():
        rotation = decorrelating(cov[p]) if rotate else None
        model.parts[p] = Part(mean, rotation, mean if rotation is None else np.zeros(dims), [], [], mean, n)
    turned = rotated(parted, model) if rotate else parted
    turned_stat = means_of(turned, dims, group) if rotate else stat
    for p, (n, mean, var) in turned_stat.items():
        part = model.parts[p]
        part.cut = mean
        part.cells = quantize.uniform_cells(config.bits, dims) if uniform else quantize.greedy_cells(var.tolist(), config.bits, n)
    for p, bounds in equi_depth_bounds(turned, dims, {p: x.cells for p, x in model.parts.items()}, group).items():
        model.parts[p].bounds = bounds
    if refine:
        for r in refined_bounds(parted, model).collect():  # the model's own numbers
            model.parts[r.part_id].bounds[r.dim] = np.array(r.bounds)
    return model


def refined_bounds(parted: DataFrame, model: Model) -> DataFrame:
    """(part_id, dim, bounds): each partition's cells refined on its share of the sample, a partition a group.

    The share is what bounds a group; it is chosen by hash."""
    dims, config = model.dims, model.config
    share = max(1, config.sample_rows // max(1, len(model.parts)))
    order = Window.partitionBy("part_id").orderBy(F.xxhash64("vec_id"), "vec_id")
    usable = parted.where("embedding is not null").select("part_id", "vec_id", "embedding")
    sample = usable.withColumn("r", F.row_number().over(order)).where(F.col("r") <= share).select("part_id", "embedding")
    shared = parted.sparkSession.sparkContext.broadcast(model)  # partitions x dims numbers

    def refine(table: pa.Table) -> pa.Table:
        p = table.column("part_id")[0].as_py()
        part = shared.value.parts[p]
        x = part.turn(K.matrix(K.whole(table, "embedding", dims).column("embedding"), dims))
        some = [d for d, b in enumerate(part.bounds) if len(b) > 2]
        lloyd = [quantize.lloyd(x[:, d], part.bounds[d], config.lloyd_rounds, config.lloyd_change).tolist() for d in some]
        columns = [pa.array([p] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(lloyd, pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, ["part_id", "dim", "bounds"])

    return sample.groupBy("part_id").applyInArrow(refine, "part_id int, dim int, bounds array<double>")


def rotated(parted: DataFrame, model: Model) -> DataFrame:
    """parted with the embedding rotated by its partition's model."""
    shared = parted.sparkSession.sparkContext.broadcast(model)
    names = parted.columns

    def run(batches):
        m = shared.value
        for batch in batches:
            batch = K.whole(batch, "embedding", m.dims)
            x, part = K.matrix(batch.column("embedding"), m.dims), batch.column("part_id").to_numpy(zero_copy_only=False)
            z = np.empty_like(x)
            for p in np.unique(part):
                z[part == p] = m.parts[int(p)].turn(x[part == p])
            columns = [K.lists(z) if n == "embedding" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in parted.schema)
    return parted.mapInArrow(run, kept)


def encoded(parted: DataFrame, model: Model) -> DataFrame:
    """parted with codes (a cell number a dimension), packed (the same, bit by bit) and sign (a bit a dimension)."""
    shared = parted.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            batch = K.whole(batch, "embedding", m.dims)
            x, part = K.matrix(batch.column("embedding"), m.dims), batch.column("part_id").to_numpy(zero_copy_only=False)
            codes, packed, sign = np.zeros(x.shape, np.int16), [b""] * len(x), [b""] * len(x)
            for p in np.unique(part):
                own, one = np.flatnonzero(part == p), m.parts[int(p)]
                z = one.turn(x[own])
                codes[own] = one.codes(z)
                for i, a, b in zip(own, K.pack_codes(codes[own], one.bits), one.signs(z)):
                    packed[i], sign[i] = a.tobytes(), b.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, K.lists(codes, pa.int16()), pa.array(packed, pa.binary()), pa.array(sign, pa.binary())], [*batch.schema.names, "codes", "packed", "sign"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parted.schema)
    return parted.mapInArrow(run, f"{kept}, codes array<smallint>, packed binary, sign binary")


def standardised(parted: DataFrame, model: Model) -> DataFrame:
    """(vec_id, part_id, rotated, standardised): vectors as their partition's model turns them, and these less the mean
    and by the deviation of the partition's rotated values (0 where that is 0)."""
    dims = model.dims
    turned = rotated(parted.select("vec_id", "part_id", "embedding"), model)
    stat = {p: (mean, np.sqrt(var)) for p, (_, mean, var) in means_of(turned, dims, F.col("part_id")).items()}
    shared = parted.sparkSession.sparkContext.broadcast(stat)  # partitions x dims numbers

    def run(batches):
        for batch in batches:
            z, part = K.matrix(batch.column("embedding"), dims), batch.column("part_id").to_numpy(zero_copy_only=False)
            unit = np.zeros_like(z)
            for p in np.unique(part):
                mean, std = shared.value[int(p)]
                own = z[part == p] - mean
                unit[part == p] = np.divide(own, std, out=np.zeros_like(own), where=std > 0)
            columns = [batch.column("vec_id"), batch.column("part_id"), batch.column("embedding"), K.lists(unit)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "part_id", "rotated", "standardised"])

    return turned.mapInArrow(run, "vec_id long, part_id int, rotated array<double>, standardised array<double>")


def build(
    vectors: DataFrame, config: IndexConfig = IndexConfig(), stage: str = "all", part: Column | None = None
) -> tuple[Model, DataFrame]:
    """The model and the table of codes. part: a given partition instead of the learned one. stage: 'partition' stops
    before quantising, and returns the partitioned vectors."""
    dims = stats.vector_length(vectors)
    if part is not None:
        model, parted = Model(dims, config), vectors.withColumn("part_id", part.cast("int"))
    else:
        model = partitioner(vectors, dims, config)
        parted = partition(vectors, model)
    if stage == "partition":
        return model, parted
    return rebuild(parted, model)


def rebuild(parted: DataFrame, model: Model, rotate: bool | None = None) -> tuple[Model, DataFrame]:
    """Energies, bits, bounds and codes anew for vectors that have part_id."""
    c = model.config
    model = fit_parts(parted, model, c.rotate if rotate is None else rotate, c.uniform, c.lloyd_rounds > 0)
    return model, encoded(parted, model)
