"""A corpus pipeline of five stages over `documents`, each calling one operator of vectorloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet to the shared folder
and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import language_id, minhash, mixing, packing, substring_dedup
from vectorloom.llm._spark import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified; texts that are null, without a letter, or in no learned
    language go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity of 0.8 and more), that of
    smallest doc_id. Rows without doc_id or words stay; equal rows that repeat a kept doc_id stay as rows."""
    return minhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds from the texts; n_chars follows the text. Rows without doc_id and
    null texts stay as they are; a text of which nothing is left goes."""
    return substring_dedup.clean_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources come to their target shares. A null source is a source; rows
    without doc_id draw alike, and so do equal rows."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 1024 tokens: a row for each piece of each row; null texts are the end id."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Language models, sketches and genetic packing can't be written in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
