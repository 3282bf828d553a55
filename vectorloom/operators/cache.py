"""Results of earlier searches, kept by the whole query: its vector, predicates and labels, the settings and the index."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.config import SearchConfig
from vectorloom.sources.shared import exists, staged

_RESULTS = "array<struct<rank:int,vec_id:bigint,dist:double>>"
_SCHEMA = f"key string, results {_RESULTS}"


class ResultCache:
    """A folder of results. `index` names the index and changes with it, so that stale results are never found.

    Equal queries are searched once. Queries without results are kept too. Two searches at a time may both search a
    query; the results are equal, and one of them is used."""

    def __init__(self, path: str, index: str):
        self.path, self.index = path, index

    def keyed(self, queries: DataFrame, config: SearchConfig) -> DataFrame:
        """queries with key, a digest of everything that their results depend on; query_id is not."""
        asked = [F.col(c) for c in ("embedding", "preds", "labels") if c in queries.columns]
        whole = F.to_json(F.struct(*asked, F.lit(repr(config)).alias("config"), F.lit(self.index).alias("index")))
        return queries.withColumn("key", F.sha2(whole, 256))

    def known(self, queries: DataFrame) -> DataFrame:
        spark = queries.sparkSession
        if not exists(spark, self.path):
            return spark.createDataFrame([], _SCHEMA)
        return spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(self.path).dropDuplicates(["key"])

    def search(self, run: Callable[[DataFrame], DataFrame], queries: DataFrame, config: SearchConfig) -> DataFrame:
        """(query_id, rank, vec_id, dist): run(queries) for the queries that are not known, and known results."""
        asked = staged(self.keyed(queries, config), "cache-asked")
        new = asked.join(self.known(queries).select("key"), "key", "left_anti")
        new = staged(new.dropDuplicates(["key"]), "cache-new")
        if new.limit(1).count():
            found = run(new.drop("key")).select("query_id", F.struct("rank", "vec_id", "dist").alias("r"))
            lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list("r")).cast(_RESULTS).alias("results"))
            whole = new.select("key", "query_id").join(lists, "query_id", "left")
            whole = whole.select("key", F.coalesce("results", F.array().cast(_RESULTS)).alias("results"))
            whole.write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        out = asked.select("query_id", "key").join(self.known(queries), "key")
        return out.select("query_id", F.explode("results").alias("r")).select("query_id", "r.*")
