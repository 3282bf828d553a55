"""The tables that the registered queries run on, derived from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.config import IndexConfig, SearchConfig
from vectorloom.operators import index as I
from vectorloom.operators import predicates as P
from vectorloom.sources import index_store
from vectorloom.sources.shared import exists, fingerprint, shared_dir

DIMS, ATTRS, K, STEP = 64, 4, 10, 20
NAMES = [f"a{i}" for i in range(ATTRS)]
#: The profile whose every stage SQL can express: given partitions, no rotation, equal bits, equi-depth cells.
PLAIN = IndexConfig(partitions=4, bits=2 * DIMS, uniform=True, rotate=False, lloyd_rounds=0)
LEARNED = IndexConfig(partitions=4, bits=4 * DIMS)
APPROX = SearchConfig(k=K, centroid_factor=1.01, percent=2, refine=2)

#: The columns that are used of each table: stated, so that no job has to look for them.
SCHEMAS = {
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double",
    "events": "event_id bigint, user_id bigint, value double",
}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Attributed vectors: vec_id, embedding, label, a0-a3, attrs, labels."""
    v, o, e = (read(spark, sf, name) for name in ("embeddings", "orders", "events"))
    as_double = lambda c: F.col(c).cast("double")
    o = o.select(F.col("o_orderkey").alias("vec_id"), F.col("o_totalprice").alias("a0"), as_double("o_custkey").alias("a1"))
    own = [F.col("value").alias("a2"), as_double("user_id").alias("a3"), F.col("user_id").alias("u")]
    out = v.join(o, "vec_id").join(e.select(F.col("event_id").alias("vec_id"), *own), "vec_id")
    labels = F.array(F.col("label"), (10 + F.col("u") % 7).cast("int")).alias("labels")
    return out.select("vec_id", "embedding", "label", *NAMES, F.array(*NAMES).alias("attrs"), labels)


def plain_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", "embedding")


def queries(table: DataFrame, *predicates: Column, labels: Column | None = None) -> DataFrame:
    """The stated query set, every row whose id is divisible by STEP, against all rows."""
    out = table.where(F.col("vec_id") % STEP == 0).withColumn("query_id", F.col("vec_id"))
    columns = ["query_id", "embedding"]
    if predicates:
        out = out.withColumn("preds", F.array(*predicates).cast(P.PREDICATES))
        columns.append("preds")
    if labels is not None:
        out = out.withColumn("labels", labels)
        columns.append("labels")
    return out.select(*columns)


def plain_index(spark: SparkSession, sf: str, table: DataFrame | None = None) -> tuple[I.Model, DataFrame]:
    """The plain profile's model and its table of codes, encoded anew from the given vectors."""
    table = table if table is not None else plain_vectors(spark, sf)
    model = stored_index(spark, sf, "plain")[0]
    return model, I.encoded(table.withColumn("part_id", given()), model)


def learned_index(spark: SparkSession, sf: str, table: DataFrame | None = None) -> tuple[I.Model, DataFrame]:
    table = table if table is not None else plain_vectors(spark, sf)
    model = stored_index(spark, sf, "learned")[0]
    return model, I.encoded(I.partition(table, model), model)


def given() -> Column:
    """The plain profile's partition of a vector."""
    return (F.col("vec_id") % PLAIN.partitions).cast("int")


def build_index(spark: SparkSession, sf: str, profile: str, path: str) -> None:
    """Builds a profile's index of the attributed vectors and writes it."""
    table = vectors(spark, sf).select("vec_id", "embedding", "attrs", "labels")
    model, index = I.build(table, PLAIN, part=given()) if profile == "plain" else I.build(table, LEARNED)
    index_store.save(index, model, path)


def stored_index(spark: SparkSession, sf: str, profile: str) -> tuple[I.Model, DataFrame, DataFrame]:
    """The profile's model, codes and vectors, read from the shared folder; built first where the index of these files
    with these settings isn't there yet."""
    tables = [f"{sf}/{name}.parquet" for name in ("embeddings", "orders", "events")]
    path = f"{shared_dir(spark)}/index-{profile}-{fingerprint(spark, tables, PLAIN, LEARNED, index_store.FORMAT)}"
    if not exists(spark, f"{path}/settings/_SUCCESS"):
        build_index(spark, sf, profile, path)
    return index_store.load(spark, path)


def flat_bounds(model: I.Model, spark: SparkSession) -> DataFrame:
    """(part_id, dim, j, bound): the model's bounds as rows."""
    rows = [(int(p), d, j, float(x)) for p, one in sorted(model.parts.items()) for d, b in enumerate(one.bounds) for j, x in enumerate(b)]
    return spark.createDataFrame(rows, "part_id int, dim int, j int, bound double")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (zero without a sign), whole numbers to BIGINT."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    pick = lambda n: F.round(F.col(n), 6) + F.lit(0.0) if kinds[n] == "double" else F.col(n).cast("long") if kinds[n] in ("int", "smallint", "tinyint") else F.col(n)
    return df.select(*[pick(n).alias(n) for n in df.columns])


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
