"""A stream of queries against a static index: every micro-batch is one search plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectorloom.config import SearchConfig
from vectorloom.operators.index import Model
from vectorloom.operators.search import search


def serve(queries: DataFrame, index: DataFrame, model: Model, sink: Callable[[DataFrame, int], None], checkpoint: str, config: SearchConfig = SearchConfig(), attrs: int = 0, **trigger) -> StreamingQuery:
    """Answers (query_id, embedding, ...) rows as they come; `sink` gets each batch's results and its number.

    A batch that is run again after a failure gives the sink the same number, so that a sink can be idempotent."""

    def answer(batch: DataFrame, number: int) -> None:
        sink(search(index, model, batch, config, attrs), number)

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
