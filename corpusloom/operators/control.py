"""Feedback control: rewards, multiplicative weights, sampling distribution, benign-ratio controller.

State tables have a row for each arm; what they are computed from is aggregated to that before any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio


def all_rows():
    """The window over a whole table: only for tables with a row for each arm."""
    return Window.partitionBy()


def smoothed_rewards(stats: DataFrame, arms: DataFrame, key: str = "cluster", alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(key, reward) of each declared arm: (fn + alpha) / (total + alpha + beta); an arm without stats raises on reading."""
    joined = arms.select(key).join(stats, key, "left")
    there = F.when(F.col("total").isNull(), F.raise_error(F.concat(F.lit("no statistics of arm "), F.col(key)))).otherwise(F.col("total"))
    return joined.select(key, ((F.col("fn") + alpha) / (there + alpha + beta)).alias("reward"))


def centered_weights(rewards: DataFrame, weights: DataFrame, key: str = "cluster", eta: float = 0.3) -> DataFrame:
    """weight * exp(eta * (reward - mean reward)); a new arm starts at 1."""
    joined = rewards.join(weights, key, "left").withColumn("baseline", F.avg("reward").over(all_rows()))
    return joined.select(key, (F.coalesce("weight", F.lit(1.0)) * F.exp(eta * (F.col("reward") - F.col("baseline")))).alias("weight"))


def sampling_distribution(weights: DataFrame, arms: DataFrame, gamma: float, power: float = 1.0, key: str = "cluster") -> DataFrame:
    """(key, ordinal, probability): (1-gamma) w^q / sum + gamma / n, summing to 1; uniform if no weight is positive."""
    joined = arms.select(key, "ordinal").join(weights, key, "left").withColumn("p", F.pow(F.coalesce("weight", F.lit(0.0)), F.lit(power)))
    total, n = F.sum("p").over(all_rows()), F.count("*").over(all_rows())
    mixed = joined.withColumn("m", F.when(total > 0, (1 - gamma) * F.col("p") / total + F.lit(gamma) / n).otherwise(F.lit(1.0) / n))
    return mixed.select(key, "ordinal", (F.col("m") / F.sum("m").over(all_rows())).alias("probability"))


def mutation_probability(base: float, weight: Column, least_scale: float, cap: float) -> Column:
    """base scaled by the weight over the mean, held within base * least_scale and the cap (the cap wins)."""
    return F.least(F.lit(cap), F.greatest(F.lit(base * least_scale), base * ratio(weight, F.avg(weight).over(all_rows()))))


def benign_ratio_controller(rounds: DataFrame, order: str, error: str, start: float, ema_start: float, decay: float, step: float, target: float, low: float, high: float) -> DataFrame:
    """One row (ema, rho): an error average by decay, and a ratio moved by step * (ema - target) and clipped, over rounds in order."""
    series = rounds.agg(F.array_sort(F.collect_list(F.struct(order, error))).alias("s"))

    def fold(state: Column, x: Column) -> Column:
        ema = decay * state["ema"] + (1 - decay) * x[error]
        return F.struct(ema.alias("ema"), F.least(F.lit(high), F.greatest(F.lit(low), state["rho"] + step * (ema - target))).alias("rho"))

    first = F.struct(F.lit(float(ema_start)).alias("ema"), F.lit(float(start)).alias("rho"))
    return series.select(F.aggregate("s", first, fold).alias("x")).select("x.*")
