"""Incremental state with Structured Streaming; each function also works on a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, ts: str, keys: Sequence[str], width: str, late: str = "1 hour") -> DataFrame:
    """Counts in fixed windows; state of windows older than the watermark is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def once(events: DataFrame, ts: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Idempotent receipt: the first event of each key within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def counters(deltas: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Running sums of +1 and -1; keys at zero or below go."""
    return deltas.groupBy(*keys).agg(F.sum(delta).alias("n")).where("n > 0")


def latest(events: DataFrame, keys: Sequence[str], ts: str, ident: str, value: str) -> DataFrame:
    """The last value of each key, by time and then id."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(ts, ident)).alias(value), F.max(ts).alias(ts))


def not_undone(actions: DataFrame, undone: str) -> DataFrame:
    return actions.where(F.col(undone).isNull())


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], query: str = "drain") -> None:
    """Work off what is there and stop; a batch that runs again has the same id, by which the sink can tell."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).queryName(query).trigger(availableNow=True).start().awaitTermination()
