"""Readers and writers of binary vector, attribute and label files.

fvecs: for each vector one int32 (its length) and as many float32. Attribute files: float32 columns one after another.
Label files: int64 rows, columns and entries, then compressed sparse rows (int64 starts, int32 columns, float32 values).

Files are read in ranges through the Hadoop file system, so any path that Spark can read will do, and a file of any size
is as many tasks as it has splits. A record is the largest equal share of the file's rows that is small enough."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.sources.shared import head_of, write_bytes

#: NumPy type names and the Spark types that hold them; unsigned ones widen.
TYPES = {
    "int8": "byte",
    "int16": "short",
    "int32": "int",
    "int64": "long",
    "uint8": "short",
    "uint16": "int",
    "uint32": "long",
    "uint64": "decimal(20,0)",
    "float16": "float",
    "float32": "float",
    "float64": "double",
}
RECORD_BYTES = 1 << 20
_FORMAT = "org.apache.spark.input.FixedLengthBinaryInputFormat"


def share_of(rows: int, most: int) -> int:
    """The largest divisor of rows that is `most` at most."""
    return next((d for d in range(max(1, min(rows, most)), 0, -1) if rows % d == 0), 1)


def records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(record, content): a file as records of `size` bytes, numbered in order; each split reads its own range."""
    conf = {f"{_FORMAT}.recordLength": str(size)}
    kinds = ("org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")
    rows = spark.sparkContext.newAPIHadoopFile(path, _FORMAT, *kinds, conf=conf)
    return spark.createDataFrame(rows, "record long, content binary")


def read_fvecs(
    spark: SparkSession, path: str, dtype: str = "float32", big_endian: bool = False, record_bytes: int = RECORD_BYTES
) -> DataFrame:
    """(vec_id, embedding): the vectors of a file in order; ValueError if its size doesn't fit its first row."""
    kind = np.dtype(dtype).newbyteorder(">" if big_endian else "<")
    word = np.dtype(">i4" if big_endian else "<i4")
    schema = f"vec_id long, embedding array<{TYPES[dtype]}>"
    length, head = head_of(spark, path, 4)
    if not length:
        return spark.createDataFrame([], schema)
    dims = int(np.frombuffer(head, word)[0])
    row = 4 + dims * kind.itemsize
    if length % row:
        raise ValueError(f"{path}: {length} bytes are no whole number of vectors of {dims} dimensions")
    share = share_of(length // row, max(1, record_bytes // row))
    fields = np.dtype([("n", word), ("x", kind, (dims,))])

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = np.frombuffer(content, fields)
                if (rows["n"] != dims).any():
                    raise ValueError("vectors of different lengths")
                x = np.ascontiguousarray(rows["x"].astype(kind.newbyteorder("=")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(share + 1) * dims, pa.int32()), pa.array(x.ravel()))
                ids = pa.array(number * share + np.arange(share), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, lists], ["vec_id", "embedding"])

    return records(spark, path, share * row).mapInArrow(run, schema)


def fvecs_bytes(x: np.ndarray) -> bytes:
    out = np.zeros(len(x), [("n", "<i4"), ("x", "<f4", (x.shape[1],))])
    out["n"], out["x"] = x.shape[1], x
    return out.tobytes()


def write_fvecs(vectors: DataFrame, path: str) -> None:
    """The embeddings in order of vec_id as one file, by the driver: for samples and tests, not for large tables."""
    rows = vectors.orderBy("vec_id").select("embedding").collect()
    write_bytes(vectors.sparkSession, path, fvecs_bytes(np.array([r[0] for r in rows], "<f4").reshape(len(rows), -1)))


def read_attributes(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(vec_id, attr, value) of a column-major float32 file of `rows` rows."""
    length, _ = head_of(spark, path, 0)
    if length % (4 * rows):
        raise ValueError("attribute file of a different number of rows")
    share = share_of(length // 4, RECORD_BYTES // 4)

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(content, "<f4").astype(float)
                at = number * share + np.arange(share)
                columns = [pa.array(at % rows, pa.int64()), pa.array((at // rows).astype(np.int32)), pa.array(x)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "attr", "value"])

    if not length:
        return spark.createDataFrame([], "vec_id long, attr int, value double")
    return records(spark, path, 4 * share).mapInArrow(run, "vec_id long, attr int, value double")


def label_bytes(rows: list[list[int]], columns: int) -> bytes:
    """A label file of the rows' label lists."""
    starts = np.cumsum([0, *map(len, rows)])
    flat = np.array([x for r in rows for x in r], "<i4")
    head = np.array([len(rows), columns, len(flat)], "<i8")
    return head.tobytes() + starts.astype("<i8").tobytes() + flat.tobytes() + np.ones(len(flat), "<f4").tobytes()


def read_labels(spark: SparkSession, path: str, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """(vec_id, labels) of a compressed sparse row file; ValueError if it contradicts itself.

    Ranges of the file give starts and labels by their places; every row meets its labels by an equi-join on the place,
    so no task holds more than its range and a row's labels."""
    length, head = head_of(spark, path, 24)
    rows, columns, entries = np.frombuffer(head, "<i8", 3).tolist()
    labels_at = 24 + 8 * (rows + 1)
    if length != labels_at + 8 * entries:
        raise ValueError("damaged label file")
    share = share_of(length // 8, record_bytes // 8) * 8

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = number * share
                for first, last, kind, size in ((24, labels_at, "<i8", 8), (labels_at, labels_at + 4 * entries, "<i4", 4)):
                    a, b = max(at, first), min(at + share, last)
                    if a < b:
                        x = np.frombuffer(content[a - at : b - at], kind).astype(np.int64)
                        place = pa.array((a - first) // size + np.arange(len(x)))
                        yield pa.RecordBatch.from_arrays([pa.array([size == 8] * len(x)), place, pa.array(x)], ["start", "at", "x"])

    found = records(spark, path, share).mapInArrow(run, "start boolean, at long, x long")
    starts = found.where("start").select(F.col("at").alias("vec_id"), F.col("x").alias("lo"))
    ends = found.where("start and at > 0").select((F.col("at") - 1).alias("vec_id"), F.col("x").alias("hi"))
    spans = starts.join(ends, "vec_id")
    labels = found.where("not start").select("at", F.col("x").cast("int").alias("label"))
    problems = starts.where((F.col("vec_id") == rows) & (F.col("lo") != entries)).select("vec_id")
    problems = problems.union(spans.where("lo > hi").select("vec_id"))
    problems = problems.union(labels.where((F.col("label") < 0) | (F.col("label") >= columns)).select("at"))
    if problems.limit(1).count():
        raise ValueError("damaged label file")
    every = spans.where("hi > lo").select("vec_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at"))
    listed = every.join(labels, "at").groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("at", "label"))).alias("x"))
    out = spans.select("vec_id").join(listed, "vec_id", "left")
    return out.select("vec_id", F.coalesce(F.col("x.label"), F.array().cast("array<int>")).alias("labels"))


def dimension_major(vectors: DataFrame) -> DataFrame:
    """(dim, vec_id, x): the transposed scan."""
    return vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select("dim", "vec_id", F.col("x").cast("double").alias("x"))
