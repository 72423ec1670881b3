"""Streams of query vectors against an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiverine.operators.index import Index


def answer_stream(stream: DataFrame, index: Index, k: int, nprobe: int, sink: Callable[[DataFrame, int], None], checkpoint: str, query_id: str = "query_id", vec: str = "vec") -> StreamingQuery:
    """Answer each micro-batch of (query_id, vec), of any size, and hand the rows to ``sink`` with the batch's number.

    ``query_id`` is a whole number. ``sink`` may see a batch again after a
    failure, under the same number.
    """

    def answer(batch: DataFrame, number: int) -> None:
        asked = batch.select(F.col(query_id).alias("query_id"), F.col(vec).alias("vec"))
        sink(index.query_table(asked, k, nprobe).withColumnRenamed("query_id", query_id), number)

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
