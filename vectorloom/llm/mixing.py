"""Mixing sources to target weights.

Words are summed by source (map-side first, so a hot source is a few partial sums). The sources, in code-point order
with null last, take the weights in turn and share all words by weight; no source may exceed `most` times its own
words, and the excess of those that would is shared by weight among the others. With sources in rising order of cap per
weight this fixed point has a closed form, found by running sums over the table of sources. A source's repetition rate
is its target over its words; a document is taken floor(rate) times, and once more if a number drawn from a hash of the
seed and its doc_id is below the rate's fraction.

Everything is DataFrame operations; the table of sources has a row per source, and is broadcast if it is small.
Null and empty texts have no words and are taken without adding any. Null sources form one source. Rows without doc_id
draw the number of the text 'null'; repeated rows draw alike. A table without words has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.llm._spark import stage

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
#: Up to this size the table of sources is broadcast, so that texts are not shuffled; a larger one is joined by sorting.
BROADCAST_BYTES = 16 << 20


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) of (source, size)."""
    every = Window.partitionBy()  # a row per source, not per document
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    table = table.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * most).withColumn("n", F.row_number().over(Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())))
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({"rest": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_rest": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    under = F.col("rest") * F.col("w") <= F.col("cap") * F.col("w_rest")
    table = table.withColumn("x", F.min(F.when(under, F.struct("n", "rest", "w_rest"))).over(every))
    target = F.when(F.col("n") < F.col("x.n"), F.col("cap").cast("double")).otherwise((F.col("x.rest") * F.col("w")).cast("double") / F.col("x.w_rest"))
    table = table.withColumn("target", F.least(target, F.col("cap").cast("double")))
    return table.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with the probability of its fraction, by a hash of seed and key."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with __vl_size, __vl_source_size, __vl_target, __vl_copies."""
    sized = docs.withColumn("__vl_size", word_count("text"))
    targets = stage(source_targets(sized.select("source", F.col("__vl_size").alias("size")), weights, most), "mixing-targets").select(*[F.col(c).alias(f"__vl_{c}") for c in ("source", "source_size", "target", "rate")])
    few = targets.agg(F.coalesce(F.sum(F.octet_length("__vl_source") + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES
    joined = sized.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("__vl_source")))
    return joined.withColumn("__vl_copies", copies(F.col("__vl_rate"), F.col("doc_id"), seed)).drop("__vl_source", "__vl_rate")


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row."""
    out = mixed(docs.select("doc_id", "text", "source"), **settings)
    return out.select("doc_id", F.col("__vl_size").alias("size"), F.col("__vl_source_size").alias("source_size"), F.col("__vl_target").alias("target"), (F.col("__vl_size") * F.col("__vl_copies")).alias("taken"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row as often as it is taken; columns as before."""
    out = mixed(docs, **settings).where("__vl_copies > 0")
    return out.withColumn("__vl_copy", F.explode(F.sequence(F.lit(1), F.col("__vl_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def report_sql(docs: str = "documents", seed: str = SEED) -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
  FROM sized GROUP BY source
), r AS (
  SELECT *, source_size * 3 AS cap, row_number() OVER (ORDER BY (source_size * 3) / w, source ASC NULLS LAST) AS n FROM s
), c AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_rest FROM r
), k AS (
  SELECT n AS kn, rest AS krest, w_rest AS kw FROM c WHERE rest * w <= cap * w_rest ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size, least(CASE WHEN n < kn THEN CAST(cap AS DOUBLE) ELSE CAST(krest * w AS DOUBLE) / kw END, CAST(cap AS DOUBLE)) AS target FROM c, k
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('{seed}/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS UBIGINT) / 4294967296.0 AS drawn
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN CAST(drawn AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rated"""
