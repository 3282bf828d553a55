"""Sources, the index directory, streams, blocks of queries and edge cases."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.config import IndexConfig, SearchConfig
from vectorloom.operators import index as I
from vectorloom.operators import search as S
from vectorloom.operators.altindex import AlternativeIndex
from vectorloom.plans import fixtures as Z
from vectorloom.sources import binary, index_store
from vectorloom.streaming.query_stream import serve


def test_fvecs_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((25, 5)).astype(np.float32)
    (tmp_path / "a.fvecs").write_bytes(binary.fvecs_bytes(x))
    rows = binary.read_fvecs(spark, str(tmp_path / "a.fvecs"), record_bytes=200).orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(25)) and np.allclose([r.embedding for r in rows], x)
    (tmp_path / "none.fvecs").write_bytes(b"")
    assert binary.read_fvecs(spark, str(tmp_path / "none.fvecs")).count() == 0


def test_big_endian_fvecs(spark, tmp_path):
    (tmp_path / "b.fvecs").write_bytes(b"".join(struct.pack(">i2f", 2, i, -i) for i in range(3)))
    rows = binary.read_fvecs(spark, str(tmp_path / "b.fvecs"), big_endian=True).orderBy("vec_id").collect()
    assert [list(r.embedding) for r in rows] == [[0, 0], [1, -1], [2, -2]]


def test_attribute_and_label_files(spark, tmp_path):
    (tmp_path / "x.af").write_bytes(np.arange(6, dtype="<f4").tobytes())
    rows = binary.read_attributes(spark, str(tmp_path / "x.af"), 3).orderBy("attr", "vec_id").collect()
    assert [(r.vec_id, r.attr, r.value) for r in rows] == [(i % 3, i // 3, float(i)) for i in range(6)]
    starts, labels = np.array([0, 2, 2, 3]), np.array([0, 4, 1])
    data = np.array([3, 5, 3], "<i8").tobytes() + starts.astype("<i8").tobytes() + labels.astype("<i4").tobytes() + np.ones(3, "<f4").tobytes()
    (tmp_path / "x.labels").write_bytes(data)
    rows = binary.read_labels(spark, str(tmp_path / "x.labels")).orderBy("vec_id").collect()
    assert [list(r.labels) for r in rows] == [[0, 4], [], [1]]
    assert binary.label_bytes([[0, 4], [], [1]], 5) == data
    rows = binary.read_labels(spark, str(tmp_path / "x.labels"), record_bytes=8).orderBy("vec_id").collect()
    assert [list(r.labels) for r in rows] == [[0, 4], [], [1]]
    for head in ([3, 4, 3], [3, 5, 4]):  # a label too large; entries that contradict the starts
        (tmp_path / "bad.labels").write_bytes(np.array(head, "<i8").tobytes() + data[24:])
        with pytest.raises(ValueError):
            binary.read_labels(spark, str(tmp_path / "bad.labels"))
    (tmp_path / "bad.fvecs").write_bytes(binary.fvecs_bytes(np.zeros((3, 2)))[:-1])
    with pytest.raises(ValueError):
        binary.read_fvecs(spark, str(tmp_path / "bad.fvecs"))


def test_store_and_load(spark, small, tmp_path):
    model, index = Z.plain_index(spark, small)
    index_store.save(index, model, str(tmp_path / "index"))
    again, codes, vectors = index_store.load(spark, str(tmp_path / "index"))
    q = Z.queries(Z.plain_vectors(spark, small))
    a = sorted(map(tuple, S.search(index, model, q, Z.APPROX).select("query_id", "rank", "vec_id").collect()))
    found = S.search(codes, again, q, Z.APPROX, vectors=vectors)
    assert a == sorted(map(tuple, found.select("query_id", "rank", "vec_id").collect())) and len(a) == 250


def test_pruned_search(spark, small, tmp_path, monkeypatch):
    """A search of a stored index reads packed codes and embeddings of the visited partitions' directories alone, also
    where its queries come in blocks."""
    model, codes, vectors = Z.stored_index(spark, small, "plain")
    q = Z.queries(Z.plain_vectors(spark, small)).where("query_id = 20")
    found = S.search(codes, model, q, Z.APPROX, vectors=vectors)
    plan = found._jdf.queryExecution().executedPlan().toString()
    visited = {r.part_id for r in found.collect()}
    for part in visited:
        assert f"PartitionFilters: [isnotnull(part_id" in plan or "PartitionFilters: [part_id" in plan, plan
    assert "embedding" not in [f.name for f in codes.schema] and "codes" not in [f.name for f in codes.schema]
    assert S.pruned(codes, sorted(visited)).count() == sum(model.parts[p].population for p in visited) < 500
    assert len(S.pruned(codes, sorted(visited)).inputFiles()) <= len(codes.inputFiles())
    q = Z.queries(Z.plain_vectors(spark, small))
    whole = sorted(map(tuple, S.search(codes, model, q, Z.APPROX, vectors=vectors).collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "VECTOR_BLOCK", 60)
    assert sorted(map(tuple, S.search(codes, model, q, Z.APPROX, vectors=vectors).collect())) == whole


def test_null_vectors(spark, small):
    """Vectors that are null or hold nulls take no part, as vectors or as queries, in any search."""
    v = Z.vectors(spark, small).select("vec_id", "embedding", "attrs", "labels")
    bad = [(-1, None), (-2, [1.0, None] + [0.0] * 62)]
    odd = spark.createDataFrame(bad, "vec_id long, embedding array<float>").withColumns({"attrs": F.lit(None).cast("array<double>"), "labels": F.lit(None).cast("array<int>")})
    both, q = v.union(odd), Z.queries(v)
    asked = q.union(odd.select("vec_id", "embedding"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id").collect()))
    assert rows(S.exact_search(both, asked, 5, Z.DIMS)) == rows(S.exact_search(v, q, 5, Z.DIMS))
    pair = q.withColumn("labels", F.array(F.lit(3)))
    assert rows(S.exact_search(both, pair, 5, Z.DIMS)) == rows(S.exact_search(v, pair, 5, Z.DIMS))
    for config in (IndexConfig(partitions=3, bits=128, lloyd_rounds=2), Z.PLAIN):
        part = None if config.rotate else F.col("vec_id") % 4
        (m, a), (n, b) = (I.build(t, config, part=None if part is None else F.abs(part)) for t in (v, both))
        assert rows(S.search(b, n, asked, SearchConfig(k=5, mode="exact"))) == rows(S.search(a, m, q, SearchConfig(k=5, mode="exact")))
    for kind in ("flat", "sq8", "pq", "rabitq"):
        assert rows(AlternativeIndex(both, kind).search(asked, 5)) == rows(AlternativeIndex(v, kind).search(q, 5))


def test_stream_of_queries(spark, small, tmp_path):
    model, index = Z.plain_index(spark, small)
    q = Z.queries(Z.plain_vectors(spark, small))
    q.coalesce(1).write.parquet(str(tmp_path / "q"))
    got = []
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q"))
    serve(stream, index, model, lambda df, n: got.extend(df.collect()), str(tmp_path / "c"), Z.APPROX).awaitTermination(120)
    want = S.search(index, model, q, Z.APPROX).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted((r.query_id, r.rank, r.vec_id) for r in want)


def test_blocks_of_queries(spark, small, monkeypatch):
    v = Z.plain_vectors(spark, small)
    whole = S.exact_search(v, Z.queries(v), 5, Z.DIMS).collect()
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "VECTOR_BLOCK", 100)
    assert sorted(map(tuple, S.exact_search(v, Z.queries(v), 5, Z.DIMS).collect())) == sorted(map(tuple, whole))


def test_edges(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(9)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = [(r.rank, r.vec_id) for r in S.exact_search(v, q, 4, 2).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 3), (3, 6), (4, 1)]  # equal vectors in order of vec_id
    assert S.exact_search(v, q.limit(0), 4, 2).count() == 0
    assert S.exact_search(v.limit(0), q, 4, 2).count() == 0
    model, index = I.build(v, IndexConfig(partitions=3, bits=4, lloyd_rounds=0), part=F.col("vec_id") % 3)
    far = q.withColumn("embedding", F.array(F.lit(1e6), F.lit(-1e6)))
    for config in (SearchConfig(k=20, mode="exact"), SearchConfig(k=20, mode="approx_nocut", centroid_factor=1e9)):
        assert S.search(index, model, far, config).count() == 9


def test_null_attributes_fail(spark):
    v = spark.createDataFrame([(0, [0.0], [None]), (1, [1.0], [5.0])], "vec_id long, embedding array<double>, attrs array<double>")
    q = spark.createDataFrame([(7, [0.0], [(0, "<", 9.0, None)])], "query_id long, embedding array<double>, preds array<struct<attr:int,op:string,lo:double,hi:double>>")
    assert [r.vec_id for r in S.exact_search(v, q, 5, 1, 1).collect()] == [1]


@pytest.mark.parametrize("kind", ["sq8", "pq", "rabitq", "flat", "graph"])
def test_alternative_indexes_recall(spark, small, kind):
    v = Z.plain_vectors(spark, small)
    q = Z.queries(v)
    real = {(r.query_id, r.vec_id) for r in S.exact_search(v, q, 10, Z.DIMS).collect()}
    got = {(r.query_id, r.vec_id) for r in AlternativeIndex(v, kind).search(q, 10, refine=8).collect()}
    assert len(real & got) / len(real) >= 0.8


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_rabitq_search_recall(spark, monkeypatch, sf):
    """The query finds nine of ten true neighbours on every size, and says so if it does not."""
    from vectorloom.plans import queries as registry

    recall_at, got = registry.W.recall_at, []

    def noted(*args):
        got.append(recall_at(*args))
        return got[0].withColumn("recall", F.lit(0.89))

    monkeypatch.setattr(registry.W, "recall_at", noted)
    assert not registry.QUERIES["rabitq_search"](spark, f"/root/testdata/{sf}").first().recalled
    assert got[0].agg(F.avg("recall")).first()[0] >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("kind, refine", [("sq8", 2), ("pq", 8)])
def test_probed_lists_recall(spark, sf, kind, refine):
    """Six of eight lists hold nine of ten true neighbours, and lists that are not probed are left out."""
    from vectorloom.plans import queries as registry

    v = Z.plain_vectors(spark, f"/root/testdata/{sf}")
    real = {(r.query_id, r.vec_id) for r in S.exact_search(v, Z.queries(v), Z.K, Z.DIMS).collect()}
    rows = registry.probed(spark, f"/root/testdata/{sf}", kind, refine=refine).collect()
    got = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == len(got) == len(real) and 0.9 <= len(real & got) / len(real) < 1
    assert registry.QUERIES["ivf_probed_recall" if kind == "sq8" else "pq_probed_recall"](spark, f"/root/testdata/{sf}").first().recalled


def test_staged_build_and_rebuild(spark, small):
    v = Z.plain_vectors(spark, small)
    config = IndexConfig(partitions=3, bits=160, lloyd_rounds=5)
    model, parted = I.build(v, config, stage="partition")
    assert parted.columns == [*v.columns, "part_id"] and not model.parts
    again, table = I.rebuild(parted, model)
    assert sum(p.population for p in again.parts.values()) == v.count() == table.count()
    assert all(sum(p.bits) <= 160 for p in again.parts.values())
    fair = v.count() // 3
    assert all(0.9 * fair <= p.population <= 1.1 * fair + 1 for p in again.parts.values())


def test_selective_predicates(spark, small):
    from vectorloom.functions import columns as X
    from vectorloom.operators.workload import selective_predicates

    v = Z.vectors(spark, small)
    tests = selective_predicates(v, Z.NAMES, 0.2)
    kept = v.where(Z.all_of([X.holds(op, F.col(Z.NAMES[i]), F.lit(x)) for i, op, x in tests])).count()
    assert 0.2 <= kept / v.count() <= 0.35


def test_order_statistics_with_ties(spark):
    from vectorloom.operators.quantiles import order_statistics

    x = [-0.0, 0.0, 1.5, 1.5, 1.5, -7.25, 1e300, -1e-300]
    v = spark.createDataFrame([(i, [y, -y]) for i, y in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = order_statistics(v, 2, {(0, 0): list(range(8)), (0, 1): [0, 7]})
    assert got[(0, 0)] == sorted(x) and got[(0, 1)] == [-1e300, 7.25]


def test_metrics_files(spark, small, tmp_path):
    from vectorloom.operators import metrics
    from vectorloom.plans.queries import QUERIES

    one = QUERIES["run_metrics"](spark, small)
    metrics.write_metrics(one, str(tmp_path))
    assert spark.read.json(str(tmp_path / "json")).first().queries == one.first().queries == 25
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_hamming_nearest_sends_few(spark, small, monkeypatch):
    """A task sends on k candidates of a partition for each query and batch, not every pair."""
    from vectorloom.plans import queries

    seen, ranked = [], S.ranked
    monkeypatch.setattr(S, "ranked", lambda df, *a, **b: seen.append(df) or ranked(df, *a, **b))
    out = queries.QUERIES["hamming_topk"](spark, small).collect()
    assert seen[0].count() == 25 * 4 * 10 == len(out)  # one batch of 500 vectors; before: 25 x 500 pairs


def test_candidates_leave_in_pieces(spark, small, monkeypatch):
    from vectorloom.plans import queries

    rows = sorted(queries.QUERIES["adc_lower_bounds"](spark, small).collect())
    monkeypatch.setattr(S, "CANDIDATE_ROWS", 300)
    sizes, met = [], S.met

    def watched(vectors, asked, dims, attrs, kernel, schema, table=None):
        table = S.fetched(asked)[1]
        q = S.Rows(table, "query_id", dims, attrs)
        sizes.extend(b.num_rows for b in kernel(q, S.Rows(vectors.toArrow().combine_chunks(), "vec_id", dims, attrs)))
        return met(vectors, asked, dims, attrs, kernel, schema, table)

    monkeypatch.setattr(S, "met", watched)
    assert sorted(queries.QUERIES["adc_lower_bounds"](spark, small).collect()) == rows
    assert sum(sizes) == 25 * 500 and max(sizes) < 300 + 500


def test_bounds_are_checked_where_blocks_meet(spark, small, monkeypatch):
    """Pairs are counted without being shuffled or joined; those outside their bounds are found."""
    from vectorloom.functions import kernels as K
    from vectorloom.plans import fixtures as Z
    from vectorloom.plans import queries

    monkeypatch.setattr(S, "reranked", None)  # before: every pair was joined with both vectors
    assert tuple(queries.QUERIES["bounds_bracket_distance"](spark, small).first()) == (25 * 500, 0)
    model, index = Z.learned_index(spark, small)
    for one in model.parts.values():  # cells that don't hold their vectors
        one.bounds = [b * 0.7 for b in one.bounds]
    pairs, bad, q = 0, 0, {r.vec_id: np.array(r.embedding, float) for r in index.where("vec_id % 20 = 0").collect()}
    for r in index.select("part_id", "codes", "embedding").collect():
        one, x = model.parts[r.part_id], np.array([r.embedding], float)
        for v in q.values():
            low, high = K.bounds_of(np.array([r.codes]), K.bound_tables(one.turn(v[None])[0], one.bounds))
            d = K.distances(x, v)
            pairs, bad = pairs + 1, bad + int(low[0] > d[0] + 1e-9 or high[0] < d[0] - 1e-9)
    assert bad > 0
    monkeypatch.setattr(S, "QUERY_BLOCK", 8)  # blocks that are shuffled, too
    assert tuple(S.bracketed(index, Z.queries(Z.plain_vectors(spark, small)), model).first()) == (pairs, bad)
