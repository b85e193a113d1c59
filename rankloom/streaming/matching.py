"""Queries as a stream against a static corpus: each micro-batch is one batch match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankloom.methods import decide
from rankloom.operators.gate import Gate


def match_stream(method, queries: DataFrame, path: str, checkpoint: str, gate: Gate | None = None) -> StreamingQuery:
    """Writes a decision of ``method`` for each streamed (query_id, text) to Parquet under ``path``, a folder a batch, so a retried batch overwrites its own."""

    def batch(rows: DataFrame, number: int) -> None:
        decide(method, rows, gate).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
