"""The registry: every operator as a query over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.config import SearchConfig
from vectorloom.functions import columns as X
from vectorloom.functions import kernels as K
from vectorloom.operators import altindex, inspection, metrics, quantize, stats
from vectorloom.operators import index as I
from vectorloom.operators import predicates as P
from vectorloom.operators import search as S
from vectorloom.operators import workload as W
from vectorloom.operators.cache import ResultCache
from vectorloom.operators.quantiles import equi_depth_bounds
from vectorloom.plans import fixtures as Z
from vectorloom.sources import binary
from vectorloom.sources.shared import shared_dir, write_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(function):
        key = name or function.__name__
        QUERIES[key] = lambda spark, sf: Z.rounded(function(spark, sf))
        if sql:
            SQL[key] = sql
        return function

    return add


# ---- SQL building blocks ------------------------------------------------------------------------------------------

V = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(vec_id % 4 AS INTEGER) AS part FROM embeddings)"""
AV = """v AS (SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS e, x.label, o.o_totalprice AS a0, CAST(o.o_custkey AS DOUBLE) AS a1,
  t.value AS a2, CAST(t.user_id AS DOUBLE) AS a3, [x.label, CAST(10 + t.user_id % 7 AS INTEGER)] AS labels, CAST(x.vec_id % 4 AS INTEGER) AS part
  FROM embeddings x JOIN orders o ON o.o_orderkey = x.vec_id JOIN events t ON t.event_id = x.vec_id)"""
Q = "q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0)"
AQ = "q AS (SELECT vec_id AS query_id, e AS qe, a0 AS q0, a1 AS q1, a2 AS q2, a3 AS q3, labels AS ql, label AS qlabel FROM v WHERE vec_id % 20 = 0)"
XD = "x AS (SELECT vec_id, part, unnest(range(64)) AS d, unnest(e) AS x FROM v)"
BOUNDS = """r AS (SELECT part, d, x, row_number() OVER (PARTITION BY part, d ORDER BY x, vec_id) - 1 AS rk, count(*) OVER (PARTITION BY part, d) AS n FROM x),
bl AS (SELECT part, d, j, CASE WHEN j = 0 THEN min(x) - 0.001::DOUBLE WHEN j = 4 THEN max(x) + 0.001::DOUBLE
  ELSE max(CASE WHEN rk = least(n - 1, CAST(ceil(j * n / 4.0) AS BIGINT)) THEN x END) END AS b
  FROM r, (SELECT unnest(range(5)) AS j) GROUP BY part, d, j),
bb AS (SELECT part, d, list(b ORDER BY j) AS b FROM bl GROUP BY part, d),
c AS (SELECT vec_id, part, d, x, b, greatest(0, least(3, len(list_filter(b, lambda y: y <= x)) - 1)) AS c FROM x JOIN bb USING (part, d))"""
QX = "qx AS (SELECT query_id, unnest(range(64)) AS d, unnest(qe) AS qx FROM q)"
ADC = """bd AS (SELECT query_id, vec_id, part,
  sqrt(sum(CASE WHEN least(4, len(list_filter(b[2:5], lambda y: y < qx))) = c THEN 0.0 ELSE least((b[c + 1] - qx) * (b[c + 1] - qx), (b[c + 2] - qx) * (b[c + 2] - qx)) END)) AS lower,
  sqrt(sum(greatest((b[c + 1] - qx) * (b[c + 1] - qx), (b[c + 2] - qx) * (b[c + 2] - qx)))) AS upper
  FROM c JOIN qx USING (d) GROUP BY query_id, vec_id, part)"""
MEANS = "m AS (SELECT part, d, avg(x) AS mean, count(*) AS n FROM x GROUP BY part, d)"
HAM = """hm AS (SELECT query_id, vec_id, part, CAST(sum(CASE WHEN (x > mean) <> (qx > mean) THEN 1 ELSE 0 END) AS BIGINT) AS hamming
  FROM x JOIN m USING (part, d) JOIN qx USING (d) GROUP BY query_id, vec_id, part)"""
CD = "cd AS (SELECT query_id, part, sqrt(sum((qx - mean) * (qx - mean))) AS dist FROM m JOIN qx USING (d) GROUP BY query_id, part)"
ROUTE = """ct AS (SELECT query_id, part, count(*) AS n FROM v, q WHERE {where} GROUP BY query_id, part),
rt AS (SELECT *, min(dist) OVER (PARTITION BY query_id) AS nearest FROM cd),
ru AS (SELECT query_id, part, dist, nearest, n, sum(n) OVER (PARTITION BY query_id) AS total,
  coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY dist, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM rt JOIN ct USING (query_id, part)),
ro AS (SELECT query_id, part, dist, CAST(n AS BIGINT) AS n, CAST(greatest(floor(n * 2 / 100.0), 40) AS BIGINT) AS cut FROM ru WHERE dist <= nearest * 1.01 OR bef < least(10, total))"""


def knn_sql(where: str = "true", k: int = 10, base: str = f"{AV}, {AQ}") -> str:
    return f"""WITH {base}, d AS (SELECT query_id, vec_id, list_distance(qe, e) AS dist FROM v, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(dist, 6) AS dist FROM r WHERE rank <= {k}"""


# ---- exact search and filters -------------------------------------------------------------------------------------


@query(knn_sql(base=f"{V}, {Q}"))
def knn_l2_topk(spark, sf):
    v = Z.plain_vectors(spark, sf)
    return S.exact_search(v, Z.queries(v), Z.K, Z.DIMS)


@query(knn_sql(k=100, base=f"{V}, {Q}"))
def ground_truth_top100(spark, sf):
    v = Z.plain_vectors(spark, sf)
    return W.ground_truth(v, Z.queries(v), 100)


def filtered(name: str, where: str, *preds: tuple, labels: str | None = None):
    """A filtered search whose operands are SQL expressions over the query's own row."""

    def run(spark, sf):
        v = Z.vectors(spark, sf)
        return S.exact_search(v, Z.queries(v, *[as_predicate(p) for p in preds], labels=None if labels is None else F.expr(labels)), Z.K, Z.DIMS, Z.ATTRS)

    query(knn_sql(where), name)(run)


def as_predicate(p: tuple):
    """A predicate from (attr, op, operand expressions)."""
    attr, op, *operands = p
    return P.predicate(attr, op, *[F.expr(x) for x in operands])


filtered("knn_filter_lt", "a0 < q0", (0, "<", "a0"))
filtered("knn_filter_le", "a0 <= q0", (0, "<=", "a0"))
filtered("knn_filter_eq", "a3 = q3", (3, "=", "a3"))
filtered("knn_filter_gt", "a2 > q2", (2, ">", "a2"))
filtered("knn_filter_ge", "a2 >= q2", (2, ">=", "a2"))
filtered("knn_filter_between", "a1 > q1 - 300 AND a1 <= q1 + 300", (1, "B", "a1 + 300", "a1 - 300"))
filtered("knn_filter_conjunction", "a0 < q0 AND a1 > 100 AND a2 >= q2 - 20 AND a3 <= q3 + 200", (0, "<", "a0"), (1, ">", "100"), (2, ">=", "a2 - 20"), (3, "<=", "a3 + 200"))
filtered("knn_filter_none_match", "a0 < q0 AND a0 > q0", (0, "<", "a0"), (0, ">", "a0"))
filtered("knn_filter_fewer_than_k", "a1 > q1 - 20 AND a1 <= q1 + 20", (1, "B", "a1 - 20", "a1 + 20"))
filtered("label_filter_single", "list_contains(labels, qlabel)", labels="array(label)")
filtered("label_filter_pair", "list_contains(labels, ql[1]) AND list_contains(labels, ql[2])", labels="labels")


@query(f"WITH {AV} SELECT DISTINCT CAST(unnest(labels) AS BIGINT) AS label, vec_id FROM v")
def label_inverted_index(spark, sf):
    return P.inverted(Z.vectors(spark, sf))


@query(f"WITH {AV} SELECT vec_id FROM v WHERE list_contains(labels, 3) AND list_contains(labels, 12)")
def label_posting_intersection(spark, sf):
    return P.with_labels(Z.vectors(spark, sf), [3, 12]).select("vec_id")


@query(f"WITH {AV} SELECT count(*) AS n, CAST(0 AS BIGINT) AS missed FROM v WHERE list_contains(labels, 3)")
def label_signature_prefilter(spark, sf):
    """Vectors with a label all pass the label's signature."""
    v = Z.vectors(spark, sf).select("vec_id", "labels")
    sig = P.signatures(v)
    want = F.lit(P.signatures(spark.createDataFrame([(0, [3])], "vec_id long, labels array<int>")).first().signature)
    both = v.where(F.array_contains("labels", 3)).join(sig, "vec_id")
    return both.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("signature").bitwiseAND(want) != want).cast("long")), F.lit(0)).alias("missed"))


@query(f"WITH {AV} SELECT vec_id, round(a0, 6) AS a0, round(a1, 6) AS a1, round(a2, 6) AS a2, round(a3, 6) AS a3, round(e[1], 6) AS first FROM v WHERE vec_id % 20 = 0")
def point_reads(spark, sf):
    """Vectors and attributes by id, as an equi-join."""
    v = Z.vectors(spark, sf)
    return Z.queries(v).select(F.col("query_id").alias("vec_id")).join(v, "vec_id").select("vec_id", *Z.NAMES, X.element("embedding", 0).alias("first"))


# ---- attributes ---------------------------------------------------------------------------------------------------

LONG = " UNION ALL ".join(f"SELECT vec_id, 'a{i}' AS attr, a{i} AS x FROM v" for i in range(4))


@query(f"WITH {AV}, l AS ({LONG}) SELECT attr, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM l GROUP BY attr")
def attr_stats(spark, sf):
    return stats.attribute_stats(Z.vectors(spark, sf), Z.NAMES)


@query(f"WITH {AV}, l AS ({LONG}), s AS (SELECT attr, avg(x) AS mean, stddev_pop(x) AS std FROM l GROUP BY attr) SELECT vec_id, attr, round((x - mean) / std, 6) AS z FROM l JOIN s USING (attr)")
def attr_standardize(spark, sf):
    v = Z.vectors(spark, sf)
    long = v.select("vec_id", F.explode(F.array(*[F.struct(F.lit(n).alias("attr"), F.col(n).alias("x")) for n in Z.NAMES])).alias("y")).select("vec_id", "y.attr", "y.x")
    s = F.broadcast(stats.attribute_stats(v, Z.NAMES))  # a row per attribute
    return long.join(s, "attr").select("vec_id", "attr", X.standardised(F.col("x"), F.col("mean"), F.col("std")).alias("z"))


ATTR_BOUNDS = f"""l AS ({LONG}), r AS (SELECT attr, x, row_number() OVER (PARTITION BY attr ORDER BY x, vec_id) - 1 AS rk, count(*) OVER (PARTITION BY attr) AS n FROM l),
bl AS (SELECT attr, j, CASE WHEN j = 0 THEN min(x) - 0.001::DOUBLE WHEN j = 8 THEN max(x) + 0.001::DOUBLE ELSE max(CASE WHEN rk = least(n - 1, CAST(ceil(j * n / 8.0) AS BIGINT)) THEN x END) END AS b
  FROM r, (SELECT unnest(range(9)) AS j) GROUP BY attr, j)"""


def attribute_bounds(spark, sf):
    v = Z.vectors(spark, sf).select(F.col("attrs").alias("embedding"))
    return equi_depth_bounds(v, Z.ATTRS, {0: [8] * Z.ATTRS})[0]


def bounds_rows(spark, bounds):
    return spark.createDataFrame([(f"a{i}", j, float(x)) for i, b in enumerate(bounds) for j, x in enumerate(b)], "attr string, j int, bound double")


@query(f"WITH {AV}, {ATTR_BOUNDS} SELECT attr, CAST(j AS BIGINT) AS j, round(b, 6) AS bound FROM bl")
def attr_equi_depth_bounds(spark, sf):
    return bounds_rows(spark, attribute_bounds(spark, sf))


def literal(values):
    return F.array(*[F.lit(float(x)) for x in values])


@query(f"WITH {AV}, {ATTR_BOUNDS}, bb AS (SELECT attr, list(b ORDER BY j) AS b FROM bl GROUP BY attr) SELECT vec_id, attr, CAST(greatest(0, least(7, len(list_filter(b, lambda y: y <= x)) - 1)) AS BIGINT) AS cell FROM l JOIN bb USING (attr)")
def attr_cells(spark, sf):
    v, bounds = Z.vectors(spark, sf), attribute_bounds(spark, sf)
    rows = F.array(*[F.struct(F.lit(n).alias("attr"), X.cell(F.col(n), literal(b)).alias("cell")) for n, b in zip(Z.NAMES, bounds)])
    return v.select("vec_id", F.explode(rows).alias("y")).select("vec_id", "y.attr", "y.cell")


@query("SELECT * FROM (VALUES ('<', CAST(0 AS BIGINT)), ('<=', 0), ('=', 0), ('>', 0), ('>=', 0), ('B', 0)) t(op, missed)")
def attr_cell_filter_superset(spark, sf):
    """For every operator: rows that pass the predicate but whose cell is ruled out. There are none."""
    v, b = Z.vectors(spark, sf), attribute_bounds(spark, sf)[0]
    place = X.cell(F.col("a0"), literal(b))
    left, right = F.get(literal(b), place), F.get(literal(b), place + 1)
    lo, hi = F.lit(float(b[2])), F.lit(float(b[5]))
    missed = [F.sum((X.holds(op, F.col("a0"), lo, hi) & ~P.may_hold(op, left, right, lo, hi)).cast("long")) for op in ("<", "<=", "=", ">", ">=", "B")]
    row = v.agg(*[m.alias(f"m{i}") for i, m in enumerate(missed)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"m{i}").alias("missed")) for i, op in enumerate(("<", "<=", "=", ">", ">=", "B"))])).alias("y")).select("y.*")


@query(f"""WITH {AV}, e AS (SELECT min(a2) AS lo, (max(a2) - min(a2)) / 40 AS w FROM v), h AS (SELECT CAST(least(39, floor((a2 - lo) / w)) AS BIGINT) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, coalesce(n, 0) AS n FROM (SELECT unnest(range(40)) AS bin) CROSS JOIN e LEFT JOIN h USING (bin)""")
def histogram40(spark, sf):
    return stats.histogram(Z.vectors(spark, sf), "a2")


def _walk(i: int, table: str) -> str:
    up = i % 2 == 0
    return f"""e{i} AS (SELECT min(a{i}) AS lo, (max(a{i}) - min(a{i})) / 40 AS w, count(*) AS n FROM {table}),
h{i} AS (SELECT CAST(least(39, floor((a{i} - lo) / w)) AS BIGINT) AS bin, count(*) AS c FROM {table}, e{i} GROUP BY 1),
g{i} AS (SELECT bin, coalesce(c, 0) AS c, lo, w, n FROM (SELECT unnest(range(40)) AS bin) CROSS JOIN e{i} LEFT JOIN h{i} USING (bin)),
p{i} AS (SELECT lo + (bin + {1 if up else 0}) * w AS edge FROM (SELECT *, sum(c) OVER (ORDER BY bin {"" if up else "DESC"}) AS s FROM g{i}) WHERE s >= n * pow(0.08, 0.25) ORDER BY bin {"" if up else "DESC"} LIMIT 1),
t{i} AS (SELECT * FROM {table} WHERE a{i} {"<" if up else ">"} (SELECT edge FROM p{i}))"""


@query(f"WITH {AV}, {_walk(0, 'v')}, {_walk(1, 't0')}, {_walk(2, 't1')}, {_walk(3, 't2')} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS attr, '{'<' if i % 2 == 0 else '>'}' AS op, round(edge, 6) AS operand FROM p{i}" for i in range(4)))
def selectivity_predicates(spark, sf):
    return spark.createDataFrame(W.selective_predicates(Z.vectors(spark, sf), Z.NAMES, 0.08), "attr int, op string, operand double")


@query("SELECT vec_id, " + ", ".join(f"round(CAST(CAST('0x' || substr(md5('{i}/' || vec_id), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0, 6) AS r{i}" for i in range(4)) + " FROM embeddings")
def random_attributes(spark, sf):
    return W.random_attributes(Z.plain_vectors(spark, sf), 4)


@query("SELECT vec_id FROM (SELECT vec_id FROM embeddings ORDER BY CAST(CAST('0x' || substr(md5('7/' || vec_id), 1, 8) AS UBIGINT) AS DOUBLE), vec_id LIMIT 50)")
def query_sample(spark, sf):
    return W.sample_queries(Z.plain_vectors(spark, sf), 50, 7).select("vec_id")


# ---- dimensions ---------------------------------------------------------------------------------------------------


@query(f"WITH {V}, {XD} SELECT CAST(d AS BIGINT) AS dim, round(avg(x), 6) AS mean FROM x GROUP BY d")
def dim_means(spark, sf):
    return stats.dimension_means(Z.plain_vectors(spark, sf), Z.DIMS).select("dim", "mean")


@query(f"WITH {V}, {XD} SELECT CAST(d AS BIGINT) AS dim, round(var_pop(x), 6) AS energy FROM x GROUP BY d")
def dim_energies(spark, sf):
    return stats.dimension_energies(Z.plain_vectors(spark, sf), Z.DIMS).select("dim", "energy")


@query(f"WITH {V}, {XD} SELECT CAST(d AS BIGINT) AS dim, round(sum(x * x), 6) AS squares FROM x GROUP BY d")
def dim_sumsq_energies(spark, sf):
    return stats.moments(Z.plain_vectors(spark, sf), Z.DIMS).select("dim", "squares")


@query(f"WITH {V}, {XD} SELECT CAST(a.d AS BIGINT) AS i, CAST(b.d AS BIGINT) AS j, round(covar_pop(a.x, b.x), 6) + 0.0 AS \"cov\" FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.d <= b.d GROUP BY a.d, b.d")
def covariance_upper(spark, sf):
    return stats.covariance(Z.plain_vectors(spark, sf), Z.DIMS).select("i", "j", "cov")


@query(f"WITH {V}, {XD}, {BOUNDS} SELECT CAST(part AS BIGINT) AS part_id, CAST(d AS BIGINT) AS dim, CAST(j AS BIGINT) AS j, round(b, 6) AS bound FROM bl")
def dim_equi_depth_bounds(spark, sf):
    bounds = equi_depth_bounds(Z.plain_vectors(spark, sf), Z.DIMS, {p: [4] * Z.DIMS for p in range(4)}, F.col("vec_id") % 4)
    return spark.createDataFrame([(p, d, j, float(x)) for p, own in bounds.items() for d, b in enumerate(own) for j, x in enumerate(b)], "part_id int, dim int, j int, bound double")


@query(f"WITH {V}, {XD}, {BOUNDS} SELECT vec_id, CAST(d AS BIGINT) AS dim, CAST(c AS BIGINT) AS cell FROM c")
def vector_cells(spark, sf):
    return Z.plain_index(spark, sf)[1].select("vec_id", F.posexplode("codes").alias("dim", "cell"))


@query(f"WITH {V}, {XD} SELECT CAST(d AS BIGINT) AS dim, vec_id, round(x, 6) AS x FROM x")
def dimension_major_scan(spark, sf):
    from vectorloom.sources.binary import dimension_major

    return dimension_major(Z.plain_vectors(spark, sf))


@query("SELECT CAST(unnest(range(64)) AS BIGINT) AS dim, CAST(16 AS BIGINT) AS cells")
def uniform_bit_alloc(spark, sf):
    return spark.createDataFrame(list(enumerate(quantize.uniform_cells(256, Z.DIMS))), "dim int, cells int")


@query("SELECT true AS within_budget, true AS within_byte, true AS follows_energy")
def greedy_bit_alloc(spark, sf):
    v = Z.plain_vectors(spark, sf)
    energy = [r.energy for r in stats.dimension_energies(v, Z.DIMS).orderBy("dim").collect()]
    cells = quantize.greedy_cells(energy, 160, v.count())
    order = [c for _, c in sorted(zip(energy, cells), reverse=True)]
    return spark.createDataFrame([(sum(int(np.log2(c)) for c in cells) == 160, max(cells) <= 255, all(a >= b for a, b in zip(order, order[1:])))], "within_budget boolean, within_byte boolean, follows_energy boolean")


@query(f"WITH {V}, {XD}, {MEANS} SELECT vec_id, CAST(d AS BIGINT) AS dim, CAST(CASE WHEN x > mean THEN 1 ELSE 0 END AS BIGINT) AS bit FROM x JOIN m USING (part, d)")
def sign_codes(spark, sf):
    index = Z.plain_index(spark, sf)[1]
    bit = lambda i: F.pmod(F.shiftright(F.conv(F.hex(F.substring("sign", i // 8 + 1, 1)), 16, 10).cast("int"), 7 - i % 8), F.lit(2))
    return index.select("vec_id", F.posexplode(F.array(*[bit(i) for i in range(Z.DIMS)])).alias("dim", "bit"))


@query("SELECT count(*) AS vectors, CAST(0 AS BIGINT) AS changed FROM embeddings")
def pack_roundtrip(spark, sf):
    model, index = Z.plain_index(spark, sf)
    bits = {p: one.bits for p, one in model.parts.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p in set(batch.column(0).to_pylist()):
                own = [i for i, x in enumerate(batch.column(0).to_pylist()) if x == p]
                packed = np.frombuffer(b"".join(batch.column(1).take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
                codes = K.matrix(batch.column(2).take(pa.array(own)), Z.DIMS)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(own)], pa.int64()), "bad": pa.array([int((K.unpack_codes(packed, bits[p]) != codes).any(1).sum())], pa.int64())})

    return index.select("part_id", "packed", "codes").mapInArrow(run, "n long, bad long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.coalesce(F.sum("bad"), F.lit(0)).alias("changed"))


# ---- partitions and routing ---------------------------------------------------------------------------------------


@query(f"WITH {V}, {XD}, {MEANS} SELECT CAST(part AS BIGINT) AS part_id, CAST(d AS BIGINT) AS dim, round(mean, 6) AS mean FROM m")
def partition_centroids(spark, sf):
    v = Z.plain_vectors(spark, sf)
    return stats.dimension_means(v, Z.DIMS, F.col("vec_id") % 4).select(F.col("grp").alias("part_id"), "dim", "mean")


@query("SELECT CAST(vec_id % 4 AS BIGINT) AS part_id, count(*) AS n FROM embeddings GROUP BY 1")
def partition_pops(spark, sf):
    return Z.plain_index(spark, sf)[1].groupBy("part_id").agg(F.count("*").alias("n"))


@query("SELECT vec_id, CAST(vec_id % 4 AS BIGINT) AS part_id, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS local_id FROM embeddings")
def local_ids(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("part_id").orderBy("vec_id")) - 1
    return Z.plain_index(spark, sf)[1].select("vec_id", "part_id").withColumn("local_id", place)


def distances_to_centroids(spark, sf, table=None):
    model, _ = Z.plain_index(spark, sf)
    v = table if table is not None else Z.plain_vectors(spark, sf)
    return S.all_distances(S.centroids(model, spark), Z.queries(v), Z.DIMS)


@query(f"WITH {V}, {Q}, {XD}, {MEANS}, {QX}, {CD} SELECT query_id, CAST(part AS BIGINT) AS part_id, round(dist, 6) AS dist FROM cd")
def centroid_distances(spark, sf):
    return distances_to_centroids(spark, sf)


def routes_of(spark, sf, config=Z.APPROX, *predicates):
    v = Z.vectors(spark, sf) if predicates else Z.plain_vectors(spark, sf)
    q = Z.queries(v, *predicates)
    model, index = Z.plain_index(spark, sf, v)
    chosen = S.routes(distances_to_centroids(spark, sf, v), S.matches(index, q, Z.DIMS, Z.ATTRS), config)
    return model, index, q, chosen


@query(f"WITH {V}, {Q}, {XD}, {MEANS}, {QX}, {CD}, {ROUTE.format(where='true')} SELECT query_id, CAST(part AS BIGINT) AS part_id, round(dist, 6) AS dist, n, cut FROM ro")
def route_partitions(spark, sf):
    return routes_of(spark, sf)[3]


BETWEEN = (1, "B", "a1 - 300", "a1 + 300")
NARROW = "a1 > q1 - 300 AND a1 <= q1 + 300"


@query(f"WITH {AV}, {AQ}, {XD}, {MEANS}, {QX}, {CD}, {ROUTE.format(where=NARROW)} SELECT query_id, CAST(part AS BIGINT) AS part_id, round(dist, 6) AS dist, n, cut FROM ro")
def route_partitions_filtered(spark, sf):
    return routes_of(spark, sf, Z.APPROX, as_predicate(BETWEEN))[3]


@query(f"WITH {V}, {Q}, {XD}, {MEANS}, {QX}, {CD}, {ROUTE.format(where='true')} SELECT CAST(part AS BIGINT) AS part_id, count(*) AS visits, CAST(sum(n) AS BIGINT) AS candidates FROM ro GROUP BY part")
def partition_visit_metrics(spark, sf):
    return inspection.visits(routes_of(spark, sf)[3])


# ---- codes against queries ----------------------------------------------------------------------------------------


def every_candidate(spark, sf, bound="adc"):
    v = Z.plain_vectors(spark, sf)
    model, index = Z.plain_index(spark, sf)
    return S.candidates(index, Z.queries(v), model, SearchConfig(k=Z.K, bound=bound), 0, everything=True)


CODES = f"WITH {V}, {Q}, {XD}, {BOUNDS}, {QX}"
SIGNS = f"WITH {V}, {Q}, {XD}, {MEANS}, {QX}, {HAM}"


@query(f"{SIGNS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY hamming, vec_id) AS rank FROM hm) SELECT query_id, CAST(part AS BIGINT) AS part_id, vec_id, hamming, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10")
def hamming_topk(spark, sf):
    v = Z.plain_vectors(spark, sf)
    model, index = Z.plain_index(spark, sf, v)
    return S.hamming_nearest(index, Z.queries(v), model, 10)


CUT = "hc AS (SELECT query_id, part, vec_id, hamming FROM (SELECT hm.*, cut, row_number() OVER (PARTITION BY query_id, part ORDER BY hamming, vec_id) AS place FROM hm JOIN ro USING (query_id, part)) WHERE place <= cut)"


def cut_candidates(spark, sf, config=Z.APPROX, *predicates):
    model, index, q, chosen = routes_of(spark, sf, config, *predicates)
    return model, index, q, S.candidates(index, S.routed(q, chosen), model, config, Z.ATTRS)


@query(f"{SIGNS}, {CD}, {ROUTE.format(where='true')}, {CUT} SELECT query_id, CAST(part AS BIGINT) AS part_id, vec_id, hamming FROM hc")
def hamming_cut(spark, sf):
    return cut_candidates(spark, sf)[3].select("query_id", "part_id", "vec_id", "hamming")


@query(f"{CODES}, {ADC} SELECT query_id, vec_id, round(lower, 6) AS lower FROM bd")
def adc_lower_bounds(spark, sf):
    return every_candidate(spark, sf).select("query_id", "vec_id", "lower")


@query(f"{CODES}, {ADC} SELECT query_id, vec_id, round(upper, 6) AS upper FROM bd")
def adc_upper_bounds(spark, sf):
    return every_candidate(spark, sf).select("query_id", "vec_id", "upper")


SDC = """qc AS (SELECT query_id, part, d, b, greatest(0, least(3, len(list_filter(b, lambda y: y <= qx)) - 1)) AS i FROM qx JOIN bb USING (d)),
sd AS (SELECT query_id, vec_id, sqrt(sum(pow(greatest(0.0, c.b[c + 1] - c.b[i + 2], c.b[i + 1] - c.b[c + 2]), 2))) AS lower,
  sqrt(sum(pow(greatest(abs(c.b[c + 2] - c.b[i + 1]), abs(c.b[i + 2] - c.b[c + 1])), 2))) AS upper FROM c JOIN qc USING (part, d) GROUP BY query_id, vec_id)"""


@query(f"{CODES}, {SDC} SELECT query_id, vec_id, round(lower, 6) AS lower, round(upper, 6) AS upper FROM sd")
def sdc_bounds(spark, sf):
    return every_candidate(spark, sf, "sdc").select("query_id", "vec_id", "lower", "upper")


FULL = f"WITH {V}, {Q}, {XD}, {BOUNDS}, {QX}, {ADC}, {MEANS}, {HAM}, {CD}, {ROUTE.format(where='true')}"
SHORT = "sh AS (SELECT * FROM (SELECT query_id, part, vec_id, lower, hamming, row_number() OVER (PARTITION BY query_id, part ORDER BY lower, vec_id) AS place FROM {0} JOIN bd USING (query_id, vec_id, part)) WHERE place <= 20)"
RERANK = "rr AS (SELECT sh.*, list_distance(qe, e) AS dist FROM sh JOIN v USING (vec_id) JOIN q USING (query_id))"
MERGE = "mg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM rr) WHERE rank <= 10)"
RESULT = "SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(dist, 6) AS dist, hamming, CAST(part AS BIGINT) AS part_id FROM mg"


def short_candidates(spark, sf):
    model, index, q, found = cut_candidates(spark, sf)
    return model, index, q, S.shortlisted(found, Z.APPROX.shortlist)


@query(f"{FULL}, {CUT}, {SHORT.format('hc')} SELECT query_id, CAST(part AS BIGINT) AS part_id, vec_id, round(lower, 6) AS lower, CAST(place AS BIGINT) AS place FROM sh")
def bound_shortlist(spark, sf):
    return short_candidates(spark, sf)[3].select("query_id", "part_id", "vec_id", "lower", "place")


@query(f"{FULL}, {CUT}, {SHORT.format('hc')}, {RERANK} SELECT query_id, vec_id, round(dist, 6) AS dist FROM rr")
def rerank_topk(spark, sf):
    _, index, q, short = short_candidates(spark, sf)
    return S.reranked(short, index, q, Z.DIMS).select("query_id", "vec_id", "dist")


@query(f"{FULL}, {CUT}, {SHORT.format('hc')}, {RERANK}, {MERGE} SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(dist, 6) AS dist FROM mg")
def merge_partitions(spark, sf):
    _, index, q, short = short_candidates(spark, sf)
    return S.merged(S.reranked(short, index, q, Z.DIMS), Z.K).select("query_id", "rank", "vec_id", "dist")


def searched(spark, sf, config, *predicates, learned=False, labels=None):
    v = Z.vectors(spark, sf) if predicates or labels is not None else Z.plain_vectors(spark, sf)
    model, codes, vectors = Z.stored_index(spark, sf, "learned" if learned else "plain")
    return S.search(codes, model, Z.queries(v, *predicates, labels=labels), config, Z.ATTRS, vectors)


@query(f"{FULL}, {CUT}, {SHORT.format('hc')}, {RERANK}, {MERGE} {RESULT}")
def search_approx(spark, sf):
    return searched(spark, sf, Z.APPROX).drop("fails")


@query(f"{FULL}, hr AS (SELECT hm.* FROM hm JOIN ro USING (query_id, part)), {SHORT.format('hr')}, {RERANK}, {MERGE} {RESULT}")
def search_approx_nocut(spark, sf):
    return searched(spark, sf, SearchConfig(k=Z.K, mode="approx_nocut", centroid_factor=1.01)).drop("fails")


FEW = "a1 > q1 - 20 AND a1 <= q1 + 20"


@query(f"""WITH {AV}, {AQ}, d AS (SELECT query_id, vec_id, part, list_distance(qe, e) AS dist, CASE WHEN {FEW} THEN 0 ELSE 1 END AS fails FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fails, dist, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(dist, 6) AS dist, CAST(part AS BIGINT) AS part_id, CAST(fails AS BIGINT) AS fails FROM r WHERE rank <= 10""")
def search_lenient_backfill(spark, sf):
    return searched(spark, sf, SearchConfig(k=Z.K, mode="exact", strict=False), as_predicate((1, "B", "a1 - 20", "a1 + 20"))).drop("hamming")


@query(knn_sql(base=f"{V}, {Q}"))
def search_exact_learned(spark, sf):
    return searched(spark, sf, SearchConfig(k=Z.K, mode="exact"), learned=True).select("query_id", "rank", "vec_id", "dist")


@query(knn_sql(NARROW))
def search_exact_learned_filtered(spark, sf):
    return searched(spark, sf, SearchConfig(k=Z.K, mode="exact", bound="sdc"), as_predicate(BETWEEN), learned=True).select("query_id", "rank", "vec_id", "dist")


@query(knn_sql("list_contains(labels, qlabel)"))
def search_exact_learned_labels(spark, sf):
    return searched(spark, sf, SearchConfig(k=Z.K, mode="exact"), labels=F.array("label"), learned=True).select("query_id", "rank", "vec_id", "dist")


# ---- properties of learned pieces ---------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM embeddings) * (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS pairs, CAST(0 AS BIGINT) AS outside")
def bounds_bracket_distance(spark, sf):
    """Pairs whose distance is not between its bounds, in the learned index."""
    v = Z.plain_vectors(spark, sf)
    model, index = Z.learned_index(spark, sf)
    return S.bracketed(index, Z.queries(v), model)


@query("SELECT count(*) AS vectors, CAST(0 AS BIGINT) AS changed FROM embeddings")
def rotation_isometry(spark, sf):
    """Vectors whose distance to their partition's mean changes under its rotation."""
    model, index = Z.learned_index(spark, sf)
    plain = index.select("vec_id", "part_id", "embedding")
    mean = spark.createDataFrame([(p, one.mean.tolist()) for p, one in model.parts.items()], "part_id int, mean array<double>")
    turned = I.rotated(plain, model).select("vec_id", F.col("embedding").alias("z"))
    both = plain.join(F.broadcast(mean), "part_id").join(turned, "vec_id")  # mean: a row per partition
    norm = F.sqrt(X.total([X.element("z", i) * X.element("z", i) for i in range(Z.DIMS)]))
    return both.agg(F.count("*").alias("vectors"), F.sum((F.abs(norm - X.l2("embedding", "mean", Z.DIMS)) > 1e-9).cast("long")).alias("changed"))


@query("SELECT CAST(0 AS BIGINT) AS correlated")
def rotation_decorrelates(spark, sf):
    """Pairs of rotated dimensions of a partition whose covariance is not zero."""
    model, index = Z.learned_index(spark, sf)
    turned = I.rotated(index.select("vec_id", "part_id", "embedding"), model)
    cov = stats.covariance(turned, Z.DIMS, F.col("part_id"))
    return cov.agg(F.sum(((F.col("i") != F.col("j")) & (F.abs("cov") > 1e-9)).cast("long")).alias("correlated"))


@query("SELECT count(*) AS vectors, CAST(4 AS BIGINT) AS parts, true AS balanced FROM embeddings")
def balanced_partitions(spark, sf):
    _, index = Z.learned_index(spark, sf)
    size = index.groupBy("part_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("vectors"), F.count("*").alias("parts"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    fair = F.floor(F.col("vectors") / F.col("parts"))
    return size.select("vectors", "parts", ((F.col("lo") >= fair * 0.9) & (F.col("hi") <= F.ceil(fair * 1.1))).alias("balanced"))


@query("SELECT CAST(64 AS BIGINT) AS dims, CAST(0 AS BIGINT) AS worse")
def lloyd_reduces_error(spark, sf):
    """Dimensions whose refined cells have a larger squared error than the equi-depth ones."""
    v = Z.plain_vectors(spark, sf)
    bounds = equi_depth_bounds(v, Z.DIMS, {0: [16] * Z.DIMS})[0]
    x = I.sampled(v, Z.LEARNED.sample_rows, Z.DIMS)
    worse = sum(quantize.squared_error(x[:, d], quantize.lloyd(x[:, d], b)) > quantize.squared_error(x[:, d], b) + 1e-12 for d, b in enumerate(bounds))
    return spark.createDataFrame([(Z.DIMS, int(worse))], "dims int, worse int")


TRUTH = "tr AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(qe, e), vec_id) AS rank FROM v, q) WHERE rank <= 10)"
RECALL = f"{FULL}, {CUT}, {SHORT.format('hc')}, {RERANK}, {MERGE}, {TRUTH}, rc AS (SELECT query_id, CAST(count(mg.vec_id) AS BIGINT) AS hits, count(*) AS true_matches FROM tr LEFT JOIN mg USING (query_id, vec_id) GROUP BY query_id)"


def recalls(spark, sf):
    v = Z.plain_vectors(spark, sf)
    return W.recall_at(searched(spark, sf, Z.APPROX), W.ground_truth(v, Z.queries(v), Z.K), Z.K)


@query(f"{RECALL} SELECT query_id, hits, true_matches, round(hits / least(10, true_matches), 6) AS recall FROM rc")
def recall_at_k(spark, sf):
    return recalls(spark, sf)


@query(f"{RECALL}, s AS (SELECT (query_id // 20) % 3 AS s, avg(hits / least(10, true_matches)) AS r, count(*) AS n FROM rc GROUP BY 1) SELECT round(sum(r * n) / sum(n), 6) AS recall, CAST(sum(n) AS BIGINT) AS queries FROM s")
def recall_weighted(spark, sf):
    return W.weighted_recall(recalls(spark, sf), F.floor(F.col("query_id") / 20) % 3)


@query(f"""{RECALL} SELECT (SELECT count(*) FROM mg) AS results, (SELECT count(*) FROM rc) AS queries, (SELECT round(avg(hits / least(10, true_matches)), 6) FROM rc) AS recall,
  (SELECT count(*) FROM ro) AS visits, (SELECT CAST(sum(n) AS BIGINT) FROM ro) AS candidates""")
def run_metrics(spark, sf):
    return metrics.run_metrics(searched(spark, sf, Z.APPROX), recalls(spark, sf), routes_of(spark, sf)[3])


@query("SELECT true AS recalled")
def recall_learned(spark, sf):
    """Whether the learned index finds nine of ten true neighbours and more, with the sign cut."""
    v = Z.plain_vectors(spark, sf)
    got = W.recall_at(searched(spark, sf, SearchConfig(k=Z.K), learned=True), W.ground_truth(v, Z.queries(v), Z.K), Z.K)
    return got.agg((F.avg("recall") >= 0.9).alias("recalled"))


# ---- files, stored tables and the cache ---------------------------------------------------------------------------


def fresh(spark, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {V}, {XD} SELECT vec_id, CAST(d AS BIGINT) AS dim, round(x, 6) AS x FROM x")
def fvecs_source(spark, sf):
    """The vectors as an fvecs file, read in ranges."""
    path = fresh(spark, "vectors.fvecs")
    binary.write_fvecs(Z.plain_vectors(spark, sf), path)
    read = binary.read_fvecs(spark, path, record_bytes=8192)
    return read.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"WITH {AV} " + " UNION ALL ".join(f"SELECT vec_id, CAST({i} AS BIGINT) AS attr, round(CAST(CAST(a{i} AS FLOAT) AS DOUBLE), 6) AS value FROM v" for i in range(4)))
def attribute_source(spark, sf):
    """The attributes as a file of float32 columns, read in ranges."""
    rows = Z.vectors(spark, sf).orderBy("vec_id").select("attrs").collect()
    path = fresh(spark, "attributes.af")
    write_bytes(spark, path, np.array([r.attrs for r in rows], "<f4").T.tobytes())
    return binary.read_attributes(spark, path, len(rows))


@query(f"WITH {AV} SELECT vec_id, CAST(i AS BIGINT) AS place, CAST(labels[i + 1] AS BIGINT) AS label FROM v, (SELECT unnest(range(2)) AS i)")
def label_source(spark, sf):
    """The labels as compressed sparse rows, read in ranges and checked."""
    rows = [r.labels for r in Z.vectors(spark, sf).orderBy("vec_id").select("labels").collect()]
    path = fresh(spark, "labels.csr")
    write_bytes(spark, path, binary.label_bytes(rows, 17))
    return binary.read_labels(spark, path, record_bytes=1024).select("vec_id", F.posexplode("labels").alias("place", "label"))


@query(f"""WITH {V}, {XD}, s AS (SELECT part, d, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY part, d)
SELECT vec_id, CAST(part AS BIGINT) AS part_id, CAST(d AS BIGINT) AS dim, round(x, 6) AS turned, round(CASE WHEN std > 0 THEN (x - mean) / std ELSE 0.0 END, 6) + 0.0 AS z FROM x JOIN s USING (part, d)""")
def transformed_table(spark, sf):
    """Rotated and standardised vectors as a stored table (without a rotation, the profile that SQL can state)."""
    model, _, vectors = Z.stored_index(spark, sf, "plain")
    path = fresh(spark, "transformed")
    I.standardised(vectors, model).write.partitionBy("part_id").parquet(path)
    read = spark.read.parquet(path).select("vec_id", "part_id", F.posexplode(F.arrays_zip("rotated", "standardised")).alias("dim", "x"))
    return read.select("vec_id", "part_id", "dim", F.col("x.rotated").alias("turned"), F.col("x.standardised").alias("z"))


@query("SELECT CAST(vec_id % 4 AS BIGINT) AS part_id, count(*) AS vectors, count(*) AS population, CAST(16 * count(*) AS BIGINT) AS packed_bytes, CAST(8 * count(*) AS BIGINT) AS sign_bytes FROM embeddings GROUP BY 1")
def index_directory(spark, sf):
    """The stored index by partition: rows of both tables, the model's population, and bytes of codes and signs."""
    model, codes, vectors = Z.stored_index(spark, sf, "plain")
    sizes = spark.createDataFrame([(int(p), int(x.population)) for p, x in model.parts.items()], "part_id int, population long")
    size = codes.groupBy("part_id").agg(F.sum(F.octet_length("packed")).alias("packed_bytes"), F.sum(F.octet_length("sign")).alias("sign_bytes"))
    return vectors.groupBy("part_id").agg(F.count("embedding").alias("vectors")).join(sizes, "part_id").join(size, "part_id")


@query(knn_sql(NARROW))
def workload_tables(spark, sf):
    """A workload with both ground truths, written and loaded; the filtered truth of the loaded queries."""
    v, path = Z.vectors(spark, sf), fresh(spark, "workload")
    q = Z.queries(v, as_predicate(BETWEEN))
    truth = W.ground_truth(v, q.drop("preds"), Z.K)
    W.save_workload(path, q, truth, S.exact_search(v, q, Z.K, Z.DIMS, Z.ATTRS))
    queries, filtered_truth = W.load_workload(spark, path)
    return queries.where("size(preds) = 1").select("query_id").join(filtered_truth, "query_id")


@query("SELECT vec_id AS query_id, CAST(vec_id // 20 % 3 AS BIGINT) AS allocator FROM embeddings WHERE vec_id % 20 = 0")
def workload_concat(spark, sf):
    q = Z.queries(Z.plain_vectors(spark, sf))
    own = [q.where(F.floor(F.col("query_id") / 20) % 3 == i) for i in range(3)]
    return W.concatenated(own).select("query_id", "allocator")


@query(knn_sql(NARROW).replace("SELECT query_id, CAST(rank", "SELECT CAST(round AS BIGINT) AS round, query_id, CAST(rank").replace("FROM r WHERE", "FROM r, (SELECT unnest(range(2)) AS round) WHERE"))
def search_cached(spark, sf):
    """The exact filtered search twice through the cache; the second time nothing is searched."""
    model, codes, vectors = Z.stored_index(spark, sf, "learned")
    q = Z.queries(Z.vectors(spark, sf), as_predicate(BETWEEN))
    config = SearchConfig(k=Z.K, mode="exact")
    kept = ResultCache(fresh(spark, "results"), "learned")
    first = kept.search(lambda ask: S.search(codes, model, ask, config, Z.ATTRS, vectors), q, config)

    def never(ask):
        raise RuntimeError("a query that is known was searched")

    again = kept.search(never, q, config)
    return first.withColumn("round", F.lit(0)).unionByName(again.withColumn("round", F.lit(1)))


# ---- workloads, alternative indexes, inspection -------------------------------------------------------------------


@query("SELECT vec_id AS query_id, CAST(ntile(3) OVER (ORDER BY vec_id) - 1 AS BIGINT) AS allocator FROM embeddings WHERE vec_id % 20 = 0")
def workload_split(spark, sf):
    return W.split(Z.queries(Z.plain_vectors(spark, sf)), 3).select("query_id", "allocator")


@query("SELECT vec_id AS query_id, CAST(copy AS BIGINT) AS copy FROM embeddings, (SELECT unnest(range(3)) AS copy) WHERE vec_id % 20 = 0")
def workload_tile(spark, sf):
    return W.tile(Z.queries(Z.plain_vectors(spark, sf)), 3).select("query_id", "copy")


@query(f"""WITH {V}, {Q}, {XD}, l AS (SELECT d, min(x) AS lo, (max(x) - min(x)) / 255 AS s FROM x GROUP BY d),
c AS (SELECT vec_id, d, lo + greatest(0, least(255, floor((x - lo) / s + 0.5))) * s AS y FROM x JOIN l USING (d)), {QX},
a AS (SELECT query_id, vec_id, sqrt(sum((y - qx) * (y - qx))) AS est FROM c JOIN qx USING (d) GROUP BY query_id, vec_id),
s AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY est, vec_id) AS r FROM a) WHERE r <= 20),
t AS (SELECT query_id, vec_id, list_distance(qe, e) AS dist FROM s JOIN v USING (vec_id) JOIN q USING (query_id))
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM t) WHERE rank <= 10""")
def sq8_search(spark, sf):
    v = Z.plain_vectors(spark, sf)
    return altindex.AlternativeIndex(v, "sq8").search(Z.queries(v), Z.K)


#: Eight inverted lists whose centres SQL can state: the vectors 0 to 7. A query meets the lists of its three nearest.
LISTS = f"""WITH {V}, {Q}, ce AS (SELECT vec_id AS list, e AS c FROM v WHERE vec_id < 8),
li AS (SELECT vec_id, arg_min(list, struct_pack(d := list_distance(e, c), l := list)) AS list FROM v, ce GROUP BY vec_id),
pr AS (SELECT query_id, list FROM (SELECT query_id, list, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(qe, c), list) AS r FROM q, ce) WHERE r <= 3),
ca AS (SELECT query_id, qe, vec_id, e FROM pr JOIN li USING (list) JOIN v USING (vec_id) JOIN q USING (query_id))"""
NEAREST = "SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM t) WHERE rank <= 10"


@query(f"""{LISTS}, {XD}, l AS (SELECT d, min(x) AS lo, (max(x) - min(x)) / 255 AS s FROM x GROUP BY d),
y AS (SELECT vec_id, list(lo + greatest(0, least(255, floor((x - lo) / s + 0.5))) * s ORDER BY d) AS y FROM x JOIN l USING (d) GROUP BY vec_id),
sh AS (SELECT query_id, vec_id, list_distance(qe, e) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(qe, y), vec_id) AS r FROM ca JOIN y USING (vec_id)) WHERE r <= 20),
t AS (SELECT * FROM sh) {NEAREST}""")
def ivf_given_lists(spark, sf):
    """Inverted lists with given centres, of which a query meets three of eight, under the 8-bit coder."""
    v = Z.plain_vectors(spark, sf)
    first = np.array([r.embedding for r in v.where("vec_id < 8").orderBy("vec_id").collect()], float)
    return altindex.AlternativeIndex(v, "sq8", centres=first).search(Z.queries(v), Z.K, probes=3)


@query(f"""WITH {V}, {Q}, bk AS (SELECT vec_id AS c, e AS ce FROM v WHERE vec_id < 256),
g AS (SELECT CAST(unnest(range(16)) AS INTEGER) AS g),
cd AS (SELECT vec_id, g, arg_min(ce[4 * g + 1 : 4 * g + 4], struct_pack(d := list_distance(e[4 * g + 1 : 4 * g + 4], ce[4 * g + 1 : 4 * g + 4]), c := c)) AS code FROM v, bk, g GROUP BY vec_id, g),
y AS (SELECT vec_id, flatten(list(code ORDER BY g)) AS y FROM cd GROUP BY vec_id),
t AS (SELECT query_id, vec_id, list_distance(qe, e) AS dist FROM (SELECT query_id, qe, vec_id, e, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(qe, y), vec_id) AS r FROM q, y JOIN v USING (vec_id)) WHERE r <= 80) {NEAREST}""")
def pq_given_books(spark, sf):
    """Product quantisation with given code books: the parts of the vectors 0 to 255."""
    v = Z.plain_vectors(spark, sf)
    first = np.array([r.embedding for r in v.where("vec_id < 256").orderBy("vec_id").collect()], float)
    books = [first[:, a : a + 4] for a in range(0, Z.DIMS, 4)]
    return altindex.AlternativeIndex(v, "pq", books=books).search(Z.queries(v), Z.K, refine=8)


def same_as(spark, sf, kind, **settings):
    """Rows that differ between an index of inverted lists that probes all of them and the flat index of its kind."""
    v = Z.plain_vectors(spark, sf)
    q = Z.queries(v)
    a = altindex.AlternativeIndex(v, kind).search(q, Z.K, **settings)
    b = altindex.AlternativeIndex(v, kind, lists=8).search(q, Z.K, probes=8, **settings)
    return a.exceptAll(b).agg(F.count("*").alias("different"))


@query("SELECT CAST(0 AS BIGINT) AS different", name="ivf_search")
def ivf_search(spark, sf):
    return same_as(spark, sf, "sq8")


@query("SELECT CAST(0 AS BIGINT) AS different", name="pq_search")
def pq_search(spark, sf):
    return same_as(spark, sf, "pq", refine=4)


def probed(spark, sf, kind, **settings):
    """Neighbours by an index of eight inverted lists, of which a query meets the nearest six."""
    v = Z.plain_vectors(spark, sf)
    return altindex.AlternativeIndex(v, kind, lists=8).search(Z.queries(v), Z.K, probes=6, **settings)


def probed_recall(spark, sf, kind, **settings):
    v = Z.plain_vectors(spark, sf)
    found = probed(spark, sf, kind, **settings)
    return W.recall_at(found, W.ground_truth(v, Z.queries(v), Z.K), Z.K).agg((F.avg("recall") >= 0.9).alias("recalled"))


@query("SELECT true AS recalled")
def ivf_probed_recall(spark, sf):
    return probed_recall(spark, sf, "sq8")


@query("SELECT true AS recalled")
def ivf_two_level_recall(spark, sf):
    """Many lists, found in two steps, of which a query meets the nearest five in eight."""
    v = Z.plain_vectors(spark, sf)
    q = Z.queries(v)
    found = altindex.AlternativeIndex(v, "sq8", lists=64, two_level=True).search(q, Z.K, probes=40)
    return W.recall_at(found, W.ground_truth(v, q, Z.K), Z.K).agg((F.avg("recall") >= 0.9).alias("recalled"))


@query("SELECT true AS recalled")
def pq_probed_recall(spark, sf):
    return probed_recall(spark, sf, "pq", refine=8)


@query("SELECT true AS recalled", name="rabitq_search")
def rabitq_search(spark, sf):
    v = Z.plain_vectors(spark, sf)
    q = Z.queries(v)
    found = altindex.AlternativeIndex(v, "rabitq").search(q, Z.K, refine=24)  # a bit a dimension needs a long shortlist, the longer the more rows
    return W.recall_at(found, W.ground_truth(v, q, Z.K), Z.K).agg((F.avg("recall") >= 0.9).alias("recalled"))


@query(knn_sql(NARROW), name="graph_index_exact")
def graph_index_exact(spark, sf):
    v = Z.vectors(spark, sf)
    return altindex.AlternativeIndex(v, "graph").search(Z.queries(v, as_predicate(BETWEEN)), Z.K, attrs=Z.ATTRS)


@query(f"""{CODES}, w AS (SELECT d, qx FROM qx WHERE query_id = 0)
SELECT vec_id, CAST(part AS BIGINT) AS part_id, CAST(d AS BIGINT) AS dim, round(x, 6) AS raw, round(x, 6) AS turned, CAST(c AS BIGINT) AS cell, round(b[c + 1], 6) AS lo, round(b[c + 2], 6) AS hi,
  round(CASE WHEN least(4, len(list_filter(b[2:5], lambda y: y < qx))) = c THEN 0.0 ELSE least(abs(b[c + 1] - qx), abs(b[c + 2] - qx)) END, 6) AS lower, round(greatest(abs(b[c + 1] - qx), abs(b[c + 2] - qx)), 6) AS upper
FROM c JOIN w USING (d)""")
def inspect_vector(spark, sf):
    """Every vector against the query 0, dimension by dimension."""
    model, index = Z.plain_index(spark, sf)
    first = Z.plain_vectors(spark, sf).where("vec_id = 0").first()
    return inspection.inspect(index, model, list(first.embedding), F.lit(True))


@query("SELECT CAST(part AS BIGINT) AS part_id, CAST(0 AS BIGINT) AS different FROM (SELECT unnest(range(4)) AS part)")
def bounds_allclose(spark, sf):
    """Bounds of a rebuild that differ from those that were built."""
    model, index = Z.plain_index(spark, sf)
    again, _ = I.rebuild(index.select("vec_id", "part_id", "embedding"), I.Model(Z.DIMS, Z.PLAIN))
    a, b = Z.flat_bounds(model, spark), Z.flat_bounds(again, spark)
    bad = inspection.unequal(a, b, ["part_id", "dim", "j"], "bound").groupBy("part_id").agg(F.count("*").alias("n"))
    return a.select("part_id").distinct().join(bad, "part_id", "left").select("part_id", F.coalesce("n", F.lit(0)).alias("different"))




@query("""WITH z AS (SELECT l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem),
s AS (SELECT avg(x0) m0, stddev_pop(x0) s0, avg(x1) m1, stddev_pop(x1) s1, avg(x2) m2, stddev_pop(x2) s2, avg(x3) m3, stddev_pop(x3) s3 FROM z),
n AS (SELECT (x0 - m0) / s0 y0, (x1 - m1) / s1 y1, (x2 - m2) / s2 y2, (x3 - m3) / s3 y3 FROM z, s),
l AS (SELECT 0 AS d, y0 AS y FROM n UNION ALL SELECT 1, y1 FROM n UNION ALL SELECT 2, y2 FROM n UNION ALL SELECT 3, y3 FROM n),
r AS (SELECT d, y, row_number() OVER (PARTITION BY d ORDER BY y) - 1 AS rk, count(*) OVER (PARTITION BY d) AS n FROM l)
SELECT CAST(d AS BIGINT) AS dim, CAST(j AS BIGINT) AS j, round(CASE WHEN j = 0 THEN min(y) - 0.001 WHEN j = 16 THEN max(y) + 0.001 ELSE max(CASE WHEN rk = least(n - 1, CAST(ceil(j * n / 16.0) AS BIGINT)) THEN y END) END, 6) AS bound
FROM r, (SELECT unnest(range(17)) AS j) GROUP BY d, j""")
def volume_equi_depth_bounds(spark, sf):
    """Exact equi-depth bounds of all line items as four-dimensional vectors."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(*names)
    s = {r.attr: r for r in stats.attribute_stats(items, names).collect()}
    v = items.select(F.array(*[X.standardised(F.col(n), F.lit(s[n].mean), F.lit(s[n]["std"])) for n in names]).alias("embedding"))
    bounds = equi_depth_bounds(v, 4, {0: [16] * 4})[0]
    return spark.createDataFrame([(d, j, float(x)) for d, b in enumerate(bounds) for j, x in enumerate(b)], "dim int, j int, bound double")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
