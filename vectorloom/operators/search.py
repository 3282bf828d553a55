"""Searching: exact scans, routing, the sign cut, distance bounds, shortlists, exact re-ranking and merging.

Queries meet vectors in blocks. Up to `QUERY_BLOCK` queries (a checked count) are broadcast to the vectors' scan, which
needs no shuffle; more are dealt into blocks, and so are vectors, two blocks a task. Where queries have routes, a block of
either side belongs to one partition and meets blocks of that partition only. Only per-block shortlists leave a task;
windows with a row limit merge them.

A search of a stored index reads the packed codes of the partitions that some query visits, pruned by directory, and the
vectors of these partitions for the exact distances of the shortlist; without predicates it counts no matches.

Vectors and queries that are null, of another length, or hold null components take no part."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.config import SearchConfig
from vectorloom.functions import kernels as K
from vectorloom.operators import predicates as P
from vectorloom.operators.index import Model
from vectorloom.sources.shared import staged

QUERY_BLOCK = 1024
VECTOR_BLOCK = 65_536
#: Candidates that a task holds before it sends them on.
CANDIDATE_ROWS = 200_000


class Rows:
    """A block of vectors or queries as arrays; columns that are absent read as empty."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, key: str, dims: int, attrs: int):
        has = batch.schema.names
        if "embedding" in has:
            batch = K.whole(batch, "embedding", dims)
        table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
        self.n, col = table.num_rows, table.column
        self.ids = col(key).to_numpy()
        self.x = K.matrix(col("embedding"), dims) if "embedding" in has else None
        self.attrs = K.ragged(col("attrs"), attrs) if "attrs" in has else np.zeros((self.n, attrs))
        # a query's labels are wanted, a vector's are looked through
        self.labels = col("labels").to_pylist() if "labels" in has and key == "query_id" else [None] * self.n
        self.labelled = P.Labels(col("labels") if "labels" in has and key == "vec_id" else None, self.n)
        self.preds = col("preds").to_pylist() if "preds" in has else [None] * self.n
        routes = col("routes").to_pylist() if "routes" in has else [None] * self.n
        self.routes = [None if r is None else {y["part_id"]: y["cut"] for y in r} for r in routes]
        self.part = col("part_id").to_numpy() if "part_id" in has else np.zeros(self.n, np.int32)
        self.turned: dict = {}  # queries as each partition's rotation turns them
        self.packed = col("packed").combine_chunks() if "packed" in has else None
        self.code = K.bytes_matrix(col("code").combine_chunks()) if "code" in has and self.n else None
        self.sign = K.bytes_matrix(col("sign").combine_chunks()) if "sign" in has and self.n else None


def fetched(queries: DataFrame) -> tuple[DataFrame, pa.Table | None]:
    """The queries, and their rows if they are QUERY_BLOCK or fewer: one job, whose rows serve every later step."""
    table = queries.limit(QUERY_BLOCK + 1).toArrow()
    if table.num_rows > QUERY_BLOCK:
        return queries, None
    return queries.sparkSession.createDataFrame(table, queries.schema), table


def met(
    vectors: DataFrame,
    queries: DataFrame,
    dims: int,
    attrs: int,
    kernel: Callable[[Rows, Rows], Iterator[pa.RecordBatch]],
    schema: str,
    table: pa.Table | None = None,
) -> DataFrame:
    """kernel(queries, vectors) over every pair of blocks, or of blocks of one partition where queries have routes.

    table: the queries' rows, if they have been fetched."""
    spark = vectors.sparkSession
    if table is None:
        queries, table = fetched(queries)
    if table is not None:
        shared = spark.sparkContext.broadcast(table)  # QUERY_BLOCK rows at most

        def run(batches):
            q = Rows(shared.value, "query_id", dims, attrs)
            for batch in batches:
                if batch.num_rows and q.n:
                    yield from kernel(q, Rows(batch, "vec_id", dims, attrs))

        return vectors.mapInArrow(run, schema)
    q_names, v_names, keys_of = queries.columns, vectors.columns, ["grp", "qb", "vb", "side"]
    if "routes" in q_names and "part_id" in v_names:
        v = vectors.withColumn("grp", F.col("part_id"))
        q = queries.withColumn("route", F.explode("routes")).withColumns({"grp": F.col("route.part_id"), "routes": F.array("route")})
    else:
        v, q = vectors.withColumn("grp", F.lit(0)), queries.withColumn("grp", F.lit(0))
    blocks = lambda df, size, name: df.groupBy("grp").agg(F.ceil(F.count("*") / size).cast("long").alias(name))
    sizes = blocks(q, QUERY_BLOCK, "qbs").join(blocks(v, VECTOR_BLOCK, "vbs"), "grp")
    rows = sizes.collect()  # a row per partition
    sizes = F.broadcast(spark.createDataFrame(rows, sizes.schema))
    one_of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    v = v.join(sizes, "grp").withColumns({"side": F.lit(1), "vb": one_of("vec_id", "vbs"), "qb": all_of("qbs")})
    q = q.join(sizes, "grp").withColumns({"side": F.lit(0), "qb": one_of("query_id", "qbs"), "vb": all_of("vbs")})
    # equal columns on both sides, so that one sorted stream brings a block of queries before its vectors
    names = sorted({*v_names, *q_names, *keys_of})
    tasks = max(1, min(sum(r.qbs * r.vbs for r in rows), 100_000))
    both = q.select(*q_names, *keys_of).unionByName(v.select(*v_names, *keys_of), allowMissingColumns=True).select(*names)

    def stream(batches):
        held: Rows | None = None
        now, parts = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*(table.column(k).to_pylist() for k in keys_of)))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                piece, key = table.slice(start, i - start), keys[start]
                start = i
                if key[3] == 0:
                    if now != key[:3]:
                        now, parts = key[:3], []
                    parts.append(piece.select(q_names))
                    held = None
                elif now == key[:3]:
                    held = held or Rows(pa.concat_tables(parts).combine_chunks(), "query_id", dims, attrs)
                    yield from kernel(held, Rows(piece.select(v_names).combine_chunks(), "vec_id", dims, attrs))

    dealt = both.repartition(tasks, "grp", "qb", "vb").sortWithinPartitions(*keys_of)
    return dealt.mapInArrow(stream, schema)


def allowed(q: Rows, i: int, v: Rows) -> np.ndarray:
    """Which vectors query i may return."""
    return P.passing(v.attrs, q.preds[i]) & v.labelled.having(q.labels[i])


def ranked(df: DataFrame, by: list[str], order: list[str], limit, name: str = "rank") -> DataFrame:
    """The first `limit` rows of each group; Spark keeps no more of a group than that."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(name) <= limit)


def exact_search(vectors: DataFrame, queries: DataFrame, k: int, dims: int, attrs: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, dist): the k nearest vectors that satisfy the query; ties to the smaller vec_id."""

    def kernel(q: Rows, v: Rows):
        out: list[list] = [[], [], []]
        if not v.n:
            return
        reach = 1e-9 * (1 + float((v.x * v.x).sum(1).max()))
        for lo in range(0, q.n, 64):
            near = K.squared(q.x[lo : lo + 64], v.x)  # by a matrix product; who may be among the k is then measured exactly
            for i, row in enumerate(near, lo):
                ok = allowed(q, i, v) if q.preds[i] or q.labels[i] else None
                at = np.arange(v.n) if ok is None else np.flatnonzero(ok)
                if len(at) > k:
                    own = row[at]
                    at = at[own <= np.partition(own, k - 1)[k - 1] + 2 * (reach + 1e-9 * float(q.x[i] @ q.x[i]))]
                if len(at):
                    d = K.distances(v.x[at], q.x[i])
                    best = K.top(d, v.ids[at], k)
                    for column, part in zip(out, (np.full(len(best), q.ids[i]), v.ids[at][best], d[best])):
                        column.append(part)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "dist"])

    found = met(vectors, queries, dims, attrs, kernel, "query_id long, vec_id long, dist double")
    return ranked(found, ["query_id"], ["dist", "vec_id"], k).select("query_id", "rank", "vec_id", "dist")


def all_distances(vectors: DataFrame, queries: DataFrame, dims: int, table: pa.Table | None = None) -> DataFrame:
    """(query_id, part_id, dist) to a small table of centroids (vec_id: the partition)."""

    def kernel(q: Rows, v: Rows):
        for i in range(q.n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(v.n, q.ids[i])), pa.array(v.ids.astype(np.int32)), pa.array(K.distances(v.x, q.x[i]))], ["query_id", "part_id", "dist"])

    return met(vectors, queries, dims, 0, kernel, "query_id long, part_id int, dist double", table)


def near_distances(model: Model, table: pa.Table, spark) -> DataFrame:
    """(query_id, part_id, dist) to the model's centroids, for queries that have been fetched: QUERY_BLOCK x partitions
    numbers, for which no job is needed."""
    q = Rows(table, "query_id", model.dims, 0)
    parts = sorted(model.parts)
    far = np.array([K.distances(q.x, model.parts[p].centroid) for p in parts]).reshape(len(parts), q.n)
    ids, part = np.tile(q.ids, len(parts)), np.repeat(np.array(parts, np.int32), q.n)
    found = pa.table({"query_id": pa.array(ids, pa.int64()), "part_id": pa.array(part), "dist": pa.array(far.ravel())})
    return spark.createDataFrame(found, "query_id long, part_id int, dist double")


def matches(index: DataFrame, queries: DataFrame, dims: int, attrs: int, table: pa.Table | None = None) -> DataFrame:
    """(query_id, part_id, n): how many vectors of each partition satisfy each query."""

    def kernel(q: Rows, v: Rows):
        rows = []
        for i in range(q.n):
            part, n = np.unique(v.part[allowed(q, i, v)], return_counts=True)
            rows += [(q.ids[i], p, m) for p, m in zip(part, n)]
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64())], ["query_id", "part_id", "n"])

    looked_at = index.select(*[c for c in ("vec_id", "part_id", "attrs", "labels") if c in index.columns])
    found = met(looked_at, queries, dims, attrs, kernel, "query_id long, part_id int, n long", table)
    return found.groupBy("query_id", "part_id").agg(F.sum("n").alias("n"))


def populations(model: Model, distance: DataFrame) -> DataFrame:
    """(query_id, part_id, n) for queries that every vector satisfies: no scan is needed."""
    rows = [(int(p), int(one.population)) for p, one in sorted(model.parts.items())]
    sizes = distance.sparkSession.createDataFrame(rows, "part_id int, n long")  # a row per partition
    return distance.select("query_id", "part_id").join(F.broadcast(sizes), "part_id").select("query_id", "part_id", "n")


def routes(distance: DataFrame, count: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, part_id, dist, n, cut): the partitions a query visits.

    In order of centroid distance, a partition with matches is visited if it lies within centroid_factor of the nearest,
    or if those before it have fewer than min(k, all matches) matches; in exact mode, whenever it has matches. cut is the
    number of candidates that pass the sign cut there."""
    by = Window.partitionBy("query_id")
    before = by.orderBy("dist", "part_id").rowsBetween(Window.unboundedPreceding, -1)
    table = distance.withColumn("nearest", F.min("dist").over(by)).join(count, ["query_id", "part_id"])
    table = table.withColumns({"all": F.sum("n").over(by), "before": F.coalesce(F.sum("n").over(before), F.lit(0))})
    if config.mode != "exact":
        table = table.where((F.col("dist") <= F.col("nearest") * config.centroid_factor) | (F.col("before") < F.least(F.lit(config.k), F.col("all"))))
    cut = F.col("n") if config.mode != "approx" else F.greatest(F.floor(F.col("n") * config.percent / 100), F.lit(int(config.k * config.refine * config.percent)))
    return table.select("query_id", "part_id", "dist", "n", cut.cast("long").alias("cut"))


def routed(queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """queries with routes, an array of (part_id, cut) as long as the partitions visited."""
    lists = chosen.groupBy("query_id").agg(F.collect_list(F.struct("part_id", "cut")).alias("routes"))
    return queries.join(lists, "query_id")


def candidates(
    index: DataFrame,
    queries: DataFrame,
    model: Model,
    config: SearchConfig,
    attrs: int,
    everything: bool = False,
    table: pa.Table | None = None,
) -> DataFrame:
    """(query_id, part_id, vec_id, hamming, lower, upper) of the visited partitions' matching vectors.

    A block keeps the `cut` candidates of least Hamming distance; the window keeps them of the whole partition. In exact
    mode there is no cut; a block drops what its k-th smallest upper bound rules out."""
    shared = index.sparkSession.sparkContext.broadcast(model)
    tables_of = K.bound_tables if config.bound == "adc" else K.symmetric_tables

    def kernel(q: Rows, v: Rows):
        m, out, held = shared.value, [[] for _ in range(6)], 0
        names = ["query_id", "part_id", "vec_id", "hamming", "lower", "upper"]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)
        place = np.empty(v.n, np.int64)  # of a row among those of its partition
        for p in np.unique(v.part):
            asking = [i for i in range(q.n) if q.routes[i] is None or int(p) in q.routes[i]]
            if not asking:
                continue
            one, own = m.parts[int(p)], np.flatnonzero(v.part == p)
            place[own] = np.arange(len(own))
            codes = K.unpack_codes(K.bytes_matrix(v.packed.take(pa.array(own))), one.bits)
            turned = q.turned.get(int(p))
            if turned is None:  # the queries are turned once a task and partition
                z = one.turn(q.x)
                turned = q.turned[int(p)] = (z, one.signs(z))
            for i in asking:
                ok = own[allowed(q, i, v)[own]] if q.preds[i] or q.labels[i] else own
                if not len(ok):
                    continue
                z = turned[0][i]
                ham = np.bitwise_count(v.sign[ok] ^ turned[1][i]).sum(1).astype(np.int64)
                if not everything and q.routes[i] is not None:
                    keep = K.top(ham, v.ids[ok], q.routes[i][int(p)])
                    ok, ham = ok[keep], ham[keep]
                low, high = K.bounds_of(codes[place[ok]], tables_of(z, one.bounds))
                if not everything and config.mode == "exact" and len(ok) > config.shortlist:
                    within = np.partition(high, config.k - 1)[config.k - 1] * (1 + 1e-9)
                    keep = (low <= within) | (low <= np.partition(low, config.shortlist - 1)[config.shortlist - 1])
                    ok, ham, low, high = ok[keep], ham[keep], low[keep], high[keep]
                numbers = (np.full(len(ok), q.ids[i]), np.full(len(ok), p, np.int32))
                for column, part in zip(out, (*numbers, v.ids[ok], ham, low, high)):
                    column.append(part)
                held += len(ok)
                if held >= CANDIDATE_ROWS:
                    yield batch()
                    out, held = [[] for _ in range(6)], 0
        if out[0]:
            yield batch()

    read = index.select(*[c for c in ("vec_id", "part_id", "attrs", "labels", "packed", "sign") if c in index.columns])
    schema = "query_id long, part_id int, vec_id long, hamming long, lower double, upper double"
    found = met(read, queries, model.dims, attrs, kernel, schema, table)
    if everything or "routes" not in queries.columns:
        return found
    cuts = queries.select("query_id", F.explode("routes").alias("r")).select("query_id", "r.part_id", "r.cut")
    kept = found.join(cuts, ["query_id", "part_id"])
    return ranked(kept, ["query_id", "part_id"], ["hamming", "vec_id"], F.col("cut"), "place").drop("place", "cut")


def hamming_nearest(index: DataFrame, queries: DataFrame, model: Model, k: int) -> DataFrame:
    """(query_id, part_id, vec_id, hamming, rank): the k vectors of each partition of least Hamming distance to the query's
    signs, ties to the smaller vec_id. A block sends on no more than k of a partition for each query."""
    shared = index.sparkSession.sparkContext.broadcast(model)

    def kernel(q: Rows, v: Rows):
        for p in np.unique(v.part):
            one, own = shared.value.parts[int(p)], np.flatnonzero(v.part == p)
            own = own[np.argsort(v.ids[own], kind="stable")]
            signs, ids = v.sign[own], v.ids[own]
            if int(p) not in q.turned:  # the queries' signs are found once a task and partition
                q.turned[int(p)] = one.signs(one.turn(q.x))
            out = [[], [], []]
            for i in range(q.n):
                ham = np.bitwise_count(signs ^ q.turned[int(p)][i]).sum(1, dtype=np.int64)
                best = K.top(ham, ids, k)
                for column, part in zip(out, (np.full(len(best), q.ids[i]), ids[best], ham[best])):
                    column.append(part)
            if out[0]:
                a, b, c = (np.concatenate(x) for x in out)
                part = np.full(len(a), p, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, part, b, c)], ["query_id", "part_id", "vec_id", "hamming"])

    read = index.select("vec_id", "part_id", "sign")
    found = met(read, queries, model.dims, 0, kernel, "query_id long, part_id int, vec_id long, hamming long")
    return ranked(found, ["query_id", "part_id"], ["hamming", "vec_id"], k)


def bracketed(index: DataFrame, queries: DataFrame, model: Model, slack: float = 1e-9) -> DataFrame:
    """(pairs, outside): the pairs of a query and a vector, and how many have a distance that is not between its bounds.
    Every pair is measured where its blocks meet; what leaves a task is two numbers for two blocks."""
    shared, dims = index.sparkSession.sparkContext.broadcast(model), model.dims

    def kernel(q: Rows, v: Rows):
        pairs = outside = 0
        for p in np.unique(v.part):
            one, own = shared.value.parts[int(p)], np.flatnonzero(v.part == p)
            if int(p) not in q.turned:
                q.turned[int(p)] = one.turn(q.x)
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                codes = K.unpack_codes(K.bytes_matrix(v.packed.take(pa.array(some))), one.bits)
                x, place = v.x[some], codes.astype(np.int64) * dims + np.arange(dims)
                for lo in range(0, q.n, 32):
                    tables = K.all_bound_tables(q.turned[int(p)][lo : lo + 32], one.bounds)
                    for near, low, high in zip(q.x[lo : lo + 32], *tables):
                        dist = K.distances(x, near)
                        low, high = (np.sqrt(t.ravel().take(place).sum(1)) for t in (low, high))
                        pairs += len(some)
                        outside += int(((low > dist + slack) | (high < dist - slack)).sum())
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([outside])], ["pairs", "outside"])

    read = index.select("vec_id", "part_id", "packed", "embedding")
    found = met(read, queries, dims, 0, kernel, "pairs long, outside long")
    return found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.sum("outside").alias("outside"))


def shortlisted(found: DataFrame, n: int) -> DataFrame:
    """The n candidates of least lower bound in each visited partition."""
    return ranked(found, ["query_id", "part_id"], ["lower", "vec_id"], n, "place")


def reranked(short: DataFrame, index: DataFrame, queries: DataFrame, dims: int) -> DataFrame:
    """short with exact distances, by an equi-join on vec_id, and on part_id where both have it."""

    def run(batches):
        for batch in batches:
            a, b = (K.matrix(batch.column(name), dims) for name in ("qe", "embedding"))
            names = [n for n in batch.schema.names if n not in ("qe", "embedding")]
            dist = pa.array(np.sqrt(((a - b) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), dist], [*names, "dist"])

    keys = [c for c in ("part_id", "vec_id") if c in short.columns and c in index.columns]
    both = short.join(index.select(*keys, "embedding"), keys)
    both = both.join(queries.select("query_id", F.col("embedding").alias("qe")), "query_id")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in short.schema)
    ordered = both.select(*short.columns, "qe", "embedding")
    return ordered.mapInArrow(run, f"{kept}, dist double")


def merged(results: DataFrame, k: int) -> DataFrame:
    """The k nearest over all partitions."""
    return ranked(results, ["query_id"], ["dist", "vec_id"], k)


def centroids(model: Model, spark) -> DataFrame:
    rows = [(int(p), [float(x) for x in one.centroid]) for p, one in sorted(model.parts.items())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def pruned(table: DataFrame, parts: list[int]) -> DataFrame:
    """The rows of some partitions; a table that is stored by part_id is read in their directories only."""
    return table.where(F.col("part_id").isin(parts)) if parts else table.limit(0)


def search(
    index: DataFrame,
    model: Model,
    queries: DataFrame,
    config: SearchConfig = SearchConfig(),
    attrs: int = 0,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, dist, hamming, part_id, fails).

    index: a table of codes, with vectors, (vec_id, part_id, embedding), where it has no embeddings of its own.

    exact: every matching vector's lower bound; the k-th distance of the shortlist bounds the answer, and whatever may
    lie below it is ranked exactly. approx: sign cut, bounds, shortlist. approx_nocut: without the sign cut.
    strict=False fills up to k with the nearest rows that fail the query, after those that satisfy it."""
    dims = model.dims
    queries, table = fetched(queries)
    vectors = index if vectors is None else vectors
    spark = index.sparkSession
    if table is None:
        distance = all_distances(centroids(model, spark), queries, dims)
    else:
        distance = near_distances(model, table, spark)
    free = not {"preds", "labels"} & set(queries.columns)
    count = populations(model, distance) if free else matches(index, queries, dims, attrs, table)
    ask, asked = fetched(routed(queries, routes(distance, count, config)))
    if asked is None:
        ask = staged(ask, "search-routes")
        parts = [r[0] for r in ask.select(F.explode("routes.part_id")).distinct().collect()]  # the partitions at most
    else:
        parts = sorted({x["part_id"] for r in asked.column("routes").to_pylist() for x in r})
    own = pruned(vectors, parts)
    found = candidates(pruned(index, parts), ask, model, config, attrs, table=asked)
    short = shortlisted(found, config.shortlist)
    first = reranked(short, own, queries, dims)
    if config.mode == "exact":
        limit = ranked(first, ["query_id"], ["dist", "vec_id"], config.k, "r").groupBy("query_id").agg(F.when(F.count("*") >= config.k, F.max("dist")).alias("limit"))
        more = found.join(limit, "query_id").where(F.col("limit").isNull() | (F.col("lower") <= F.col("limit") * (1 + 1e-9) + 1e-9)).drop("limit")
        first = reranked(more, own, queries, dims)
    out = merged(first, config.k).withColumn("fails", F.lit(0))
    if not config.strict:
        plain = queries.drop("preds", "labels")
        near = exact_search(vectors, plain, config.k, dims).select("query_id", "vec_id", "dist")
        rest = near.join(out.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
        rest = rest.join(vectors.select("vec_id", "part_id"), "vec_id")
        rest = rest.select("query_id", "part_id", "vec_id", F.lit(None).cast("long").alias("hamming"), "dist", F.lit(1).alias("fails"))
        both = out.select(*rest.columns).unionByName(rest)
        out = ranked(both, ["query_id"], ["fails", "dist", "vec_id"], config.k)
    return out.select("query_id", "rank", "vec_id", "dist", "hamming", "part_id", "fails")
