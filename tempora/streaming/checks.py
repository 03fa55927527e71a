"""Data-quality checks that need no state, or bounded state, on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempora.operators.pit import lookahead_violations


def stream_lookahead(stream: DataFrame, *, available: str, asof: str, context: str) -> DataFrame:
    """Look-ahead violations of a stream; stateless, so it is the batch operator itself."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return lookahead_violations(stream, available=available, asof=asof, context=context)


def stream_duplicates(stream: DataFrame, *, keys: Sequence[str], event_time: str, delay: str, window: str) -> DataFrame:
    """Keys seen more than once inside an event-time window (state is dropped with the watermark)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).select(F.col("window.start").alias("window_start"), *keys, "n")
    )


def write_violations(violations: DataFrame, path: str, checkpoint: str, *, output_mode: str = "append") -> StreamingQuery:
    """Append violations to parquet, reading everything available and stopping."""
    return (
        violations.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(output_mode).trigger(availableNow=True).start()
    )
