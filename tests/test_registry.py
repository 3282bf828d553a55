"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from helpers import agree, rows_of

from vectorloom.plans import queries as registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    names = sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert agree([tuple(r) for r in df.select(*names).collect()], rows_of(duck.execute(registry.SQL[name]), names))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())


def test_plan_of_the_scan(spark, small):
    """The scan reads two columns, is not shuffled, and sends on a limited number of rows a query."""
    plan = registry.QUERIES["knn_l2_topk"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")


def test_attributes_are_pushed_to_the_scan(spark, small):
    from pyspark.sql import functions as F

    from vectorloom.functions import columns as X

    orders = spark.read.parquet(f"{small}/orders.parquet")
    plan = orders.where(X.holds("B", F.col("o_totalprice"), F.lit(10.0), F.lit(20.0))).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
