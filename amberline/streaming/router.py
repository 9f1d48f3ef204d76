"""The question router over a stream of questions.

An extension: the router keeps no state, so each micro-batch of questions meets the static index in
batch form and its answers are appended. A batch that is retried writes the same rows under its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from amberline.operators import retrieval, routing


def route_stream(index: retrieval.Index, questions: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers of a stream of ``(query_id, query)`` as Parquet under ``out``, one folder a batch."""

    def answer(batch: DataFrame, number: int) -> None:
        routing.answers(index, batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
