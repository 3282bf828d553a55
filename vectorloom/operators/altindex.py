"""Alternative indexes: flat, 8-bit scalar and product quantisation, random-rotation sign codes, inverted lists.

Each coder turns vectors into bytes and estimates distances to a query from them; a search ranks by the estimate, and
re-ranks a shortlist exactly. Graph indexes have no relational counterpart: `kind='graph'` is served by the exact scan.
Coders are fitted on a bounded sample, but for the scalar coder's ranges, which cover all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import kernels as K
from vectorloom.operators import search as S
from vectorloom.operators.index import sampled
from vectorloom.operators.stats import vector_length


class Scalar8:
    """A byte a dimension: 255 equal steps between the dimension's extremes."""

    def __init__(self, vectors: DataFrame, dims: int, sample_rows: int = 0):
        def run(batches):
            lo, hi = np.full(dims, np.inf), np.full(dims, -np.inf)
            for batch in batches:
                batch = K.whole(batch, "embedding", dims)
                if batch.num_rows:
                    x = K.matrix(batch.column(0), dims)
                    lo, hi = np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(lo), pa.array(hi)], ["dim", "lo", "hi"])

        rows = vectors.select("embedding").mapInArrow(run, "dim int, lo double, hi double").groupBy("dim").agg(F.min("lo"), F.max("hi")).orderBy("dim").collect()
        self.lo, hi = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.step = np.where(hi > self.lo, (hi - self.lo) / 255, 1.0)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.lo) / self.step + 0.5), 0, 255).astype(np.uint8)

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return K.distances(self.lo + codes * self.step, q)


class Product:
    """Subspaces of equal width, a byte for each: the nearest of 256 centres."""

    def __init__(self, vectors: DataFrame, dims: int, sample_rows: int = 10_000, parts: int = 16, seed: int = 0, books=None):
        """books: given centres of each part instead of learned ones."""
        self.edges = np.linspace(0, dims, min(parts, dims) + 1).astype(int)
        if books is not None:
            self.centres = books
            return
        x = sampled(vectors, sample_rows, dims)
        spans = enumerate(zip(self.edges, self.edges[1:]))
        self.centres = [K.kmeans(x[:, a:b], 256, seed + i, rounds=10) for i, (a, b) in spans]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([K.squared(x[:, a:b], c).argmin(1) for a, b, c in zip(self.edges, self.edges[1:], self.centres)], axis=1).astype(np.uint8)

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes))
        for i, (a, b, c) in enumerate(zip(self.edges, self.edges[1:], self.centres)):
            total += ((c - q[a:b]) ** 2).sum(1)[codes[:, i]]
        return np.sqrt(total)


class RotatedSigns:
    """A bit a dimension of the randomly rotated, centred and normed vector, and what an unbiased estimate needs.

    Kept after the bits: the norm, and the dot product of the normed vector with its sign vector, as two floats."""

    def __init__(self, vectors: DataFrame, dims: int, sample_rows: int = 10_000, seed: int = 0):
        self.dims, self.centre = dims, sampled(vectors, sample_rows, dims).mean(0)
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
        self.rotation = q * np.sign(np.diag(r))

    def encode(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) @ self.rotation
        norm = np.sqrt((z * z).sum(1))
        unit = z / np.maximum(norm, 1e-12)[:, None]
        agree = np.abs(unit).sum(1) / np.sqrt(self.dims)
        return np.hstack([np.packbits(z > 0, axis=1), np.stack([norm, agree], axis=1).astype(np.float32).view(np.uint8)])

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        z = (q - self.centre) @ self.rotation
        signs = np.unpackbits(codes[:, :-8], axis=1)[:, : self.dims] * 2.0 - 1
        norm, agree = np.ascontiguousarray(codes[:, -8:]).view(np.float32).astype(float).T
        dot = norm * (signs @ z) / np.sqrt(self.dims) / np.maximum(agree, 1e-12)
        return np.sqrt(np.maximum(0, norm**2 + z @ z - 2 * dot))


class Lists:
    """Centres of inverted lists. With `tops` a vector is assigned in two steps, which many lists need: to the `BEAM`
    nearest of the tops, then to the nearest centre below these."""

    BEAM = 4

    def __init__(self, centres: np.ndarray, tops: np.ndarray | None = None, top_of: np.ndarray | None = None):
        self.centres, self.tops, self.top_of = centres, tops, top_of

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int, two_level: bool = False) -> Lists:
        if not two_level:
            return cls(K.kmeans(sample, lists, seed, rounds=10))
        tops = K.kmeans(sample, max(1, int(lists**0.5)), seed, rounds=10)
        own = K.squared(sample, tops).argmin(1)
        parts, top_of = [], []
        for t in range(len(tops)):
            some = sample[own == t] if (own == t).any() else tops[t : t + 1]
            share = max(1, round(lists * len(some) / len(sample)))
            parts.append(K.kmeans(some, share, seed + 1 + t, rounds=10))
            top_of += [t] * len(parts[-1])
        return cls(np.vstack(parts), tops, np.array(top_of))

    def assign(self, x: np.ndarray) -> np.ndarray:
        if self.tops is None:
            return K.squared(x, self.centres).argmin(1)
        near = np.argsort(K.squared(x, self.tops), axis=1, kind="stable")[:, : self.BEAM]
        best, out = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for t in range(len(self.tops)):
            rows, below = np.flatnonzero((near == t).any(1)), np.flatnonzero(self.top_of == t)
            if len(rows):
                far = K.squared(x[rows], self.centres[below])
                first, least = below[far.argmin(1)], far.min(1)
                better = least < best[rows]
                best[rows[better]], out[rows[better]] = least[better], first[better]
        return out


CODERS = {"sq8": Scalar8, "pq": Product, "rabitq": RotatedSigns}


def coded(vectors: DataFrame, dims: int, coder, lists: Lists | None = None) -> DataFrame:
    """vectors with code and, given lists, part_id, the one of the nearest centre."""
    shared = vectors.sparkSession.sparkContext.broadcast((coder, lists))  # fitted on a bounded sample

    def run(batches):
        coder, lists = shared.value
        for batch in batches:
            batch = K.whole(batch, "embedding", dims)
            if batch.num_rows:
                x = K.matrix(batch.column("embedding"), dims)
                part = lists.assign(x) if lists is not None else np.zeros(len(x))
                added = [pa.array([c.tobytes() for c in coder.encode(x)], pa.binary()), pa.array(part.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "code", "part_id"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kept}, code binary, part_id int")


class AlternativeIndex:
    """kind: flat, graph, sq8, pq, rabitq; lists > 0 puts inverted lists before the coder.

    two_level finds a vector's list in two steps, for many lists. Learned pieces can be given instead: centres, of the
    lists; books, of the product quantiser."""

    def __init__(
        self,
        vectors: DataFrame,
        kind: str = "sq8",
        lists: int = 0,
        sample_rows: int = 10_000,
        seed: int = 0,
        centres: np.ndarray | None = None,
        books: list[np.ndarray] | None = None,
        two_level: bool = False,
    ):
        if kind not in (*CODERS, "flat", "graph"):
            raise ValueError(f"unknown index kind {kind!r}")
        self.dims, self.kind, self.centres = vector_length(vectors), kind, None
        self.table = vectors
        if kind in CODERS:
            self.coder = CODERS[kind](vectors, self.dims, sample_rows, **({"books": books} if books else {}))
            own = None
            if centres is not None:
                own = Lists(centres)
            elif lists:
                own = Lists.fit(sampled(vectors, sample_rows, self.dims), lists, seed, two_level)
            self.centres = None if own is None else own.centres
            self.table = coded(vectors, self.dims, self.coder, own)

    def search(self, queries: DataFrame, k: int, probes: int = 1, refine: float = 2, exact: bool = True, attrs: int = 0) -> DataFrame:
        """(query_id, rank, vec_id, dist). exact=False ranks by the estimate. Predicates and labels filter first."""
        if self.kind not in CODERS:
            return S.exact_search(self.table, queries, k, self.dims, attrs)
        shared = self.table.sparkSession.sparkContext.broadcast((self.coder, self.centres))
        keep = int(k * refine) if exact else k

        def kernel(q, v):
            coder, centres = shared.value
            out = [[], [], []]
            for i in range(q.n):
                ok = S.allowed(q, i, v)
                if centres is not None and probes < len(centres):
                    near = np.argsort(((centres - q.x[i]) ** 2).sum(1), kind="stable")[:probes]
                    ok &= np.isin(v.part, near)
                at = np.flatnonzero(ok)
                if len(at):
                    d = coder.estimate(q.x[i], v.code[at])
                    best = K.top(d, v.ids[at], keep)
                    for column, part in zip(out, (np.full(len(best), q.ids[i]), v.ids[at][best], d[best])):
                        column.append(part)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "dist"])

        found = S.met(self.table, queries, self.dims, attrs, kernel, "query_id long, vec_id long, dist double")
        short = S.ranked(found, ["query_id"], ["dist", "vec_id"], keep)
        if exact:
            short = S.merged(S.reranked(short.select("query_id", "vec_id"), self.table, queries, self.dims), k)
        return short.select("query_id", "rank", "vec_id", "dist")
