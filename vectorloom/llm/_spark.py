"""Spark helpers shared by the operators: tables in the shared folder, grouped Arrow streams, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.sources.shared import file_system, shared_dir

#: Rows and bytes of one Arrow batch; texts and archives are long, so 10,000 of them can reach gigabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts (a runtime setting of the session)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        fs, path = file_system(df.sparkSession, df._staged)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files and broadcasts that nothing refers to any more; it only sees them go by
    collecting garbage, which may come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system at a task's end: Python workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if malloc_trim is not None:
        malloc_trim(0)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text modulo `modulus`; null keys give null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def held_out(key: str, modulus: int, rest: int) -> Column:
    """Whether the key's remainder is `rest`; false for a null key, whose row is a training row."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of equal keys from a stream that is sorted by them; a group may span batches."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        start = 0
        table = pa.Table.from_batches([batch])
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                piece = table.slice(start, i - start)
                if held and held_key != rows[start]:
                    yield pa.concat_tables(held)
                    held = []
                held, held_key, start = [*held, piece], rows[start], i
    if held:
        yield pa.concat_tables(held)


def per_group(
    df: DataFrame, keys: list[str], function: Callable, schema: str, partitions: int | None = None
) -> DataFrame:
    """Run `function(table) -> RecordBatch | None` on each group of `keys`, grouped by a sort within partitions.

    Groups must be of bounded size: callers split hot ones by a block number first."""

    def run(batches):
        for table in grouped(batches, *keys):
            out = function(table)
            if out is not None and out.num_rows:
                yield out
        trim()

    parted = df.repartition(partitions or shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return parted.mapInArrow(run, schema)


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key; a key's rows are spread over `salts` tasks by another column.

    The table is copied `salts` times, so it should be much smaller than the rows of hot keys."""
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def rooted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), ascending, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def forests(batches: Iterator[pa.RecordBatch], itself: bool, most: int) -> Iterator[pa.RecordBatch]:
    """(node, root) of the nodes of every `most` edges or a few more, roots included if `itself`."""

    def found(held):
        node, root = rooted(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
        keep = slice(None) if itself else node != root
        out = pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (node, root)], ["node", "root"])
        for i in range(0, out.num_rows, 1 << 16):
            yield out.slice(i, 1 << 16)

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n > most:
            yield from found(held)
            held, n = [], 0
    if n:
        yield from found(held)
    trim()


def components(edges: DataFrame, a: str, b: str, name: str, at_once: int = 1 << 21) -> DataFrame:
    """Connected components of an edge list.

    Returns (node, root) for every node that has an edge to another one; root is the smallest node reachable.
    Each task first replaces its edges by those of a spanning forest. If at most `at_once` are left, a counted number
    that bounds the memory taken, one task finds the components; more go through alternating large-star and small-star
    rounds. Each round is written to the shared folder; rounds stop when the edge set no longer changes. Nodes of high
    degree are only aggregated by min and joined, spread over several tasks, never gathered."""
    spark = edges.sparkSession

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    kind = "node long, root long"
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = stage(e.mapInArrow(lambda batches: forests(batches, False, 1 << 20), kind).toDF("u", "v"), f"{name}-edges")
    if e.count() <= at_once:
        whole = e.coalesce(1).mapInArrow(lambda batches: forests(batches, True, at_once), kind)
        out = stage(whole, f"{name}-roots")
        discard(e)
        return out
    last = summary(e)
    while last[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), low, "u", "v")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, f"{name}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        to_least = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = salted_join(large, low, "u", "v").select(F.explode(to_least).alias("x")).select("x.u", "x.v")
        before, e = e, stage(small.where("u <> v").distinct(), f"{name}-small")
        discard(before, large)
        now = summary(e)
        if now == last:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
