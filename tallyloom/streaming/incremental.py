"""The validators and profilers under Structured Streaming, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.validate import validate_raw
from tallyloom.spec import TableSpec


def each_batch(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append analyse(batch) to a Parquet folder; a batch that is replayed overwrites its own subfolder, so results are exactly once."""

    def sink(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def validate_stream(stream: DataFrame, path: str, checkpoint: str, spec: TableSpec = TableSpec()) -> StreamingQuery:
    return each_batch(stream, lambda df: validate_raw(df, spec, samples=False), path, checkpoint)
