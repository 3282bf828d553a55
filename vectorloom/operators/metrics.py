"""A run's metrics as one row, and their JSON and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_metrics(results: DataFrame, recalls: DataFrame, chosen: DataFrame, seconds: float | None = None) -> DataFrame:
    """queries, results, mean recall, partitions visited, candidates found in them; with seconds, queries a second.

    results: query_id, rank, ...; recalls: as of workload.recall_at; chosen: as of search.routes."""
    found = results.count()
    right = recalls.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall")).first()
    routed = chosen.agg(F.count("*").alias("visits"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates")).first()
    row = {"results": found, "queries": right.queries, "recall": right.recall, "visits": routed.visits, "candidates": routed.candidates}
    schema = "results long, queries long, recall double, visits long, candidates long"
    if seconds is not None:
        row |= {"seconds": float(seconds), "queries_per_second": right.queries / max(float(seconds), 1e-9)}
        schema += ", seconds double, queries_per_second double"
    return results.sparkSession.createDataFrame([tuple(row.values())], schema)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
