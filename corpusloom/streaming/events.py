"""Streams of events: windowed counts, interval joins, stage pairing with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_summary(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and peak of each window and key; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak")).select(F.col("w.start").alias("start"), key, "n", "mean", "peak")


def session_summary(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def in_intervals(events: DataFrame, intervals: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """A stream against a static table of intervals, by an equality join on stretches of time."""
    from ..operators.telemetry import samples_in_intervals

    return samples_in_intervals(events, intervals, at, first, last)


def stage_pairs(events: DataFrame, keys: list[str], at: str, event: str, late: str = "2 hours", open_s: int = 7 * 86_400) -> DataFrame:
    """(keys, started, completed) as completions come; the open start of each key is the state.

    A start that nothing completes is forgotten when the watermark (``late`` behind the newest event) is
    open_s seconds past it, so state doesn't grow with the stages that never end.
    """
    names = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = ", ".join([*[f"{k} {names[k]}" for k in keys], f"started {names[at]}", f"completed {names[at]}"])

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        found = []
        if state.hasTimedOut:
            state.remove()
        else:
            start = state.get[0] if state.exists else None
            rows = pd.concat(list(batches)).sort_values(at, kind="stable")
            for when, kind in zip(rows[at], rows[event]):
                if kind == "started":
                    start = when.value
                elif kind == "completed" and start is not None:
                    found.append((*key, pd.Timestamp(start), when))
                    start = None
            if start is not None:
                state.update((start,))
                state.setTimeoutTimestamp(max(start // 1_000_000, state.getCurrentWatermarkMs()) + 1000 * open_s)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(found, columns=[*keys, "started", "completed"])

    return events.withWatermark(at, late).groupBy(*keys).applyInPandasWithState(pair, out, "start long", "append", "EventTimeTimeout")


def weight_updates(stream: DataFrame, apply, checkpoint: str):
    """Each batch of predictions through apply(batch, number), once."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
