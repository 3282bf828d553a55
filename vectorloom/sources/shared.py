"""The folder that driver and executors share, and the state of input files, through the Hadoop file system."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own if the session has one machine, as in tests; a
    cluster must name one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and not lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) as JVM objects."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def fingerprint(spark: SparkSession, paths: list[str], *settings) -> str:
    """Changes whenever a file below the paths, or a setting, does."""
    said = [repr(x) for x in settings]
    for path in paths:
        fs, at = file_system(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            one = files.next()
            said.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(said)).encode()).hexdigest()[:20]


def head_of(spark: SparkSession, path: str, size: int) -> tuple[int, bytes]:
    """Length and first bytes of a file."""
    fs, at = file_system(spark, path)
    length = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return length, bytes(stream.readNBytes(min(size, length)))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, such as a test's."""
    fs, at = file_system(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
