"""Stage events and resource samples: pairing, interval joins, percentiles, energy."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_stages(events: DataFrame, keys: list[str], at: str, event: str, order: str) -> DataFrame:
    """(keys, started, completed): each completion with the last start since the one before; the last pair of each key.

    Completions without a start and starts without a completion give nothing. Null keys are a group.
    """
    by = Window.partitionBy(*keys).orderBy(at, order)
    done = (F.col(event) == "completed").cast("int")
    part = events.where(F.col(event).isin("started", "completed")).withColumn("segment", F.coalesce(F.sum(done).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = lambda kind: F.max(F.when(F.col(event) == kind, F.struct(F.col(at).alias("v"), F.col(order).alias("o"))))["v"]
    whole = part.groupBy(*keys, "segment").agg(last("started").alias("started"), last("completed").alias("completed")).where("started IS NOT NULL AND completed IS NOT NULL")
    return whole.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("segment")))).where("n = 1").drop("n", "segment")


#: An interval is listed under so many stretches on average at most.
STRETCHES = 8


def samples_in_intervals(samples: DataFrame, intervals: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Each sample with every interval that holds it, both ends included.

    An interval is listed under each stretch of time that it touches, in widths that double: it takes the
    width that cuts it into STRETCHES pieces at most. Samples meet it by an equality join on (width,
    stretch), once for each width that is in use; neither side is compared as a whole with the other.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    told = intervals.where(F.col(first) <= F.col(last)).withColumn("__w", F.greatest(F.lit(0), F.ceil(F.log2((micros(last) - micros(first) + 1) / (STRETCHES * 1_000_000)))).cast("int"))
    stretch = lambda c: F.floor(micros(c) / F.expr("shiftleft(1000000L, __w)")).cast("long")
    spread = told.withColumn("__at", F.explode(F.sequence(stretch(first), stretch(last))))
    # a few dozen widths at most: one for each doubling
    widths = sorted(r["__w"] for r in told.select("__w").distinct().collect()) or [0]
    return samples.withColumn("__w", F.explode(F.array(*map(F.lit, widths)))).withColumn("__at", stretch(at)).join(spread, ["__w", "__at"]).where(F.col(at).between(F.col(first), F.col(last))).drop("__w", "__at")


def summary(value: str) -> list[Column]:
    """mean, p50, p95 (interpolated) and max; null on no values."""
    v = F.col(value)
    return [F.avg(v).alias(f"{value}_mean"), F.percentile(v, 0.5).alias(f"{value}_p50"), F.percentile(v, 0.95).alias(f"{value}_p95"), F.max(v).alias(f"{value}_max")]


def energy(samples: DataFrame, by: list[str], at: str, order: str, power: str) -> DataFrame:
    """(by, wh): the trapezoid integral of power over time, in watt hours; rows in order of (at, order)."""
    w = Window.partitionBy(*by).orderBy(at, order)
    seconds = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1e6
    return samples.withColumn("__e", (F.col(power) + F.lag(power).over(w)) / 2 * seconds).groupBy(*by).agg((F.coalesce(F.sum("__e"), F.lit(0.0)) / 3600).alias("wh"))


def resource_slices(samples: DataFrame, intervals: DataFrame, stage: str, values: list[str], at: str, first: str, last: str, device: str | None = None, power: str | None = None, order: str | None = None, peak: str | None = None, all_name: str = "__all__") -> DataFrame:
    """Of all samples and of those of each stage: n, summaries of values, and where named energy_wh and peak.

    energy_wh is the sum over devices of the trapezoid integral of power, over samples that have one, in
    order of (at, order); 0 without any. peak is the largest value of its column, null without any.
    """
    aggs = [F.count("*").alias("n"), *[x for v in values for x in summary(v)], *([F.max(peak).alias("peak")] if peak else [])]
    staged = samples_in_intervals(samples, intervals, at, first, last)
    every = samples.withColumn(stage, F.lit(all_name))
    out = every.groupBy(stage).agg(*aggs).unionByName(staged.groupBy(stage).agg(*aggs))
    if not power:
        return out
    held = every.select(stage, at, device, power, order).unionByName(staged.select(stage, at, device, power, order)).where(F.col(power).isNotNull() & F.col(at).isNotNull())
    used = energy(held, [stage, device], at, order, power).groupBy(stage).agg(F.sum("wh").alias("energy_wh"))
    return out.join(used, stage, "left").withColumn("energy_wh", F.coalesce("energy_wh", F.lit(0.0)))


def wall_times(pairs: DataFrame, by: str, stage: str, first: str, last: str) -> DataFrame:
    """(by, stages): map of stage to seconds."""
    seconds = (F.unix_micros(F.col(last).cast("timestamp")) - F.unix_micros(F.col(first).cast("timestamp"))) / 1e6
    return pairs.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(stage), seconds.alias("s"))))).alias("stages"))


@contextmanager
def stage_timer(append, stage: str, round_: int | None = None):
    """Calls append(event) with a started and, when the block ends, a completed event."""
    began = time.time()
    event = lambda kind, **more: {"unix_timestamp": time.time(), "round": round_, "stage": stage, "event": kind, **more}
    append(event("started"))
    try:
        yield
    finally:
        append(event("completed", duration_seconds=time.time() - began))
