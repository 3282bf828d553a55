"""Workloads: attributes, query samples, predicates of a wanted selectivity, ground truth, recall, and splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.functions import columns as X
from vectorloom.operators import predicates as P
from vectorloom.operators import search as S
from vectorloom.operators import stats


def uniform_number(key: str, seed: int) -> Column:
    """A number in [0, 1) from a hash of seed and key: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def random_attributes(vectors: DataFrame, count: int, normal: bool = False, seed: int = 0) -> DataFrame:
    """(vec_id, r0, r1, ...): uniform numbers, or standard normal ones by the Box-Muller transform."""

    def number(i: int) -> Column:
        u = uniform_number("vec_id", seed + i)
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * uniform_number("vec_id", seed + count + i)) if normal else u

    return vectors.select("vec_id", *[number(i).alias(f"r{i}") for i in range(count)])


def sample_queries(vectors: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """`count` vectors by hash order, in order of vec_id; each is its own nearest neighbour."""
    return vectors.withColumn("u", uniform_number("vec_id", seed)).orderBy("u", "vec_id").limit(count).drop("u").orderBy("vec_id")


def selective_predicates(table: DataFrame, names: list[str], share: float, bins: int = 40) -> list[tuple[int, str, float]]:
    """One '<' or '>' predicate for each attribute, in turn, that together keep about `share` of the rows.

    Each keeps share^(1/attributes) of the rows that pass those before it, rounded up to whole histogram bins."""
    out, part = [], share ** (1 / len(names))
    for i, name in enumerate(names):
        counts = stats.histogram(table, name, bins)
        up = i % 2 == 0
        order = Window.orderBy(F.col("bin") if up else F.desc("bin"))  # a row per bin
        row = counts.withColumns({"c": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy())}).where(F.col("c") >= F.col("all") * part).orderBy("bin" if up else F.desc("bin")).first()
        op, edge = ("<", row.hi) if up else (">", row.lo)
        out.append((i, op, edge))
        table = table.where(X.holds(op, F.col(name), F.lit(edge)))
    return out


def ground_truth(vectors: DataFrame, queries: DataFrame, depth: int = 100, attrs: int = 0) -> DataFrame:
    return S.exact_search(vectors, queries, depth, stats.vector_length(vectors), attrs)


def recall_at(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, true_matches, recall) over the first k of both."""
    real = truth.where(F.col("rank") <= k)
    hit = results.where(F.col("rank") <= k).select("query_id", "vec_id").join(real.select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    n = real.groupBy("query_id").agg(F.count("*").alias("true_matches"))
    out = n.join(hit, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("recall", X.recall(F.col("hits"), k, F.col("true_matches")))


def weighted_recall(recalls: DataFrame, session: Column) -> DataFrame:
    """One row: the sessions' mean recalls, weighted by their numbers of queries."""
    by = recalls.groupBy(session.alias("session")).agg(F.avg("recall").alias("r"), F.count("*").alias("n"))
    return by.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("recall"), F.sum("n").alias("queries"))


def split(queries: DataFrame, parts: int) -> DataFrame:
    """queries with allocator, equal parts in order of query_id (a window over query ids alone)."""
    place = queries.select("query_id").withColumn("allocator", F.ntile(parts).over(Window.orderBy("query_id")) - 1)
    return queries.join(place, "query_id")


def tile(queries: DataFrame, factor: int) -> DataFrame:
    """queries repeated `factor` times, numbered by copy."""
    return queries.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))


def with_predicates(queries: DataFrame, predicates: list[Column]) -> DataFrame:
    return queries.withColumn("preds", F.array(*predicates).cast(P.PREDICATES))


def save_workload(path: str, queries: DataFrame, truth: DataFrame, filtered_truth: DataFrame) -> None:
    """A workload as Parquet tables: queries (query_id, embedding[, preds][, labels]) and both ground truths."""
    for name, table in (("queries", queries), ("truth", truth), ("filtered_truth", filtered_truth)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_workload(spark: SparkSession, path: str, filtered: bool = True) -> tuple[DataFrame, DataFrame]:
    """The queries, without predicates and labels if not filtered, and the ground truth that belongs to them."""
    queries = spark.read.parquet(f"{path}/queries")
    if not filtered:
        queries = queries.drop("preds", "labels")
    return queries, spark.read.parquet(f"{path}/{'filtered_truth' if filtered else 'truth'}")


def concatenated(workloads: list[DataFrame]) -> DataFrame:
    """The queries of several allocators' workloads, numbered by allocator; a missing column is null."""
    numbered = [w.withColumn("allocator", F.lit(i)) for i, w in enumerate(workloads)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
