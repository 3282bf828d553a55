"""An index as a directory of Parquet tables: codes and vectors, both partitioned by part_id, model (a row per
partition), and settings, which are written last and so mark an index that is whole.

codes has the packed codes, sign bits, attributes and labels that a search looks through; vectors the embeddings that it
reads for exact distances. A search reads the directories of the partitions that its queries visit."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vectorloom.config import IndexConfig
from vectorloom.operators.index import Model, Part

#: Tasks, and so files, over which a partition's rows are spread at most: a large partition is not one task.
SPREAD = 32
FORMAT = 2  # of the directory
_MODEL = (
    "part_id int, population long, mean array<double>, rotation array<array<double>>, cut array<double>, "
    "cells array<int>, bounds array<array<double>>, centroid array<double>"
)


def save(index: DataFrame, model: Model, path: str) -> None:
    tables = {
        "codes": [c for c in index.columns if c not in ("embedding", "codes")],
        "vectors": ["vec_id", "part_id", "embedding"],
    }
    for name, columns in tables.items():
        own = index.select(*columns).repartition("part_id", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)))
        own = own.sortWithinPartitions("part_id", "vec_id")
        own.write.mode("overwrite").partitionBy("part_id").parquet(f"{path}/{name}")
    plain = lambda a: None if a is None else a.tolist()
    rows = [
        (p, x.population, plain(x.mean), plain(x.rotation), plain(x.cut), [int(c) for c in x.cells], [plain(b) for b in x.bounds], plain(x.centroid))
        for p, x in sorted(model.parts.items())
    ]
    spark = index.sparkSession
    spark.createDataFrame(rows, _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    whole = [None if a is None else a.tolist() for a in (model.mean, model.rotation, model.centres, model.prices)]
    schemas = {name: index.select(*columns).schema.json() for name, columns in tables.items()}
    text = json.dumps({"dims": model.dims, "config": asdict(model.config), "partitioner": whole, "schemas": schemas})
    spark.createDataFrame([(text,)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the codes and the vectors."""
    said = json.loads(spark.read.schema("settings string").parquet(f"{path}/settings").first()[0])
    arrays = [None if a is None else np.array(a) for a in said["partitioner"]]
    model = Model(said["dims"], IndexConfig(**said["config"]), {}, *arrays)
    for r in spark.read.schema(_MODEL).parquet(f"{path}/model").collect():
        rotation = None if r.rotation is None else np.array(r.rotation)
        bounds = [np.array(b) for b in r.bounds]
        model.parts[r.part_id] = Part(
            np.array(r.mean), rotation, np.array(r.cut), list(r.cells), bounds, np.array(r.centroid), r.population
        )
    schemas = {name: StructType.fromJson(json.loads(text)) for name, text in said["schemas"].items()}
    return model, *(spark.read.schema(schemas[name]).parquet(f"{path}/{name}") for name in ("codes", "vectors"))
