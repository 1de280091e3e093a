"""Weighted, stratified, quota and round-robin sampling by hash-based draws.

Every choice is a rank over a deterministic number, so a sample is the same for any partitioning. Global
top-k picks plan as a partial top-k on each partition; per-group picks as one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform


#: Ranges of draws that rows are numbered in; each has a row of its own in a small table.
RANGES = 4096


def draw(df: DataFrame, seed: int, *key: str) -> DataFrame:
    return df.withColumn("u", uniform(seed, *[F.col(k) for k in key]))


def top_k(df: DataFrame, k: int, score: str, ordinal: str) -> DataFrame:
    """The k rows of the highest score; ties keep the declared order."""
    return df.orderBy(F.desc(score), F.asc(ordinal)).limit(k)


def weighted_without_replacement(df: DataFrame, k: int, weight: str, seed: int, *key: str) -> DataFrame:
    """k rows, one after the other in proportion to weight (smallest exponential waiting times); weights of 0 last."""
    wait = F.when(F.col(weight) > 0, -F.ln("u") / F.col(weight)).otherwise(F.lit(float("inf")))
    return draw(df, seed, *key).withColumn("wait", wait).orderBy("wait", *key).limit(k)


def uniform_sample(df: DataFrame, k: int, seed: int, *key: str, strict: bool = False) -> DataFrame:
    """k rows without replacement; ``strict`` raises if there are fewer."""
    if strict and (n := df.count()) < k:
        raise ValueError(f"{k} rows asked of {n}")
    return draw(df, seed, *key).orderBy("u", *key).limit(k)


def with_replacement(df: DataFrame, k: int, seed: int, *key: str) -> DataFrame:
    """k draws; with replacement only if k is over the number of rows, else without."""
    n = df.count()
    if k <= n:
        return uniform_sample(df, k, seed, *key)
    if not n:
        raise ValueError("no rows to draw from")
    spark = df.sparkSession
    # rows are numbered in order of their draws, within ranges of them: the same numbers in any partitioning
    ranked = draw(df, seed, *key).withColumn("__range", F.floor(F.col("u") * RANGES)).withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy("u", *key)))
    sizes = ranked.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = ranked.join(F.broadcast(before), "__range").withColumn("__pick", F.col("base") + F.col("__at") - 1).drop("__range", "__at", "base", "u")
    slots = spark.range(k).select(F.col("id").alias("slot"), F.floor(uniform(seed, F.col("id")) * n).alias("__pick"))
    return slots.join(numbered, "__pick").drop("__pick")


def per_group(df: DataFrame, group: str, quota: Column | int, seed: int, *key: str, first: list[Column] | None = None) -> DataFrame:
    """Of each group the quota of rows that rank first, by ``first`` and then by the draw."""
    w = Window.partitionBy(group).orderBy(*(first or []), "u", *key)
    limit = F.lit(quota) if isinstance(quota, int) else quota
    return draw(df, seed, *key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def one_per_group(df: DataFrame, group: str, seed: int, *key: str) -> DataFrame:
    """One row of each group: partial aggregation, no sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return draw(df, seed, *key).groupBy(F.col(group).alias("__g")).agg(F.min_by(row, F.struct("u", *key)).alias("row")).select("row.*")


def split_budget(n: int, share: Column) -> Column:
    """round(n * share), halves to even."""
    return F.bround(F.lit(float(n)) * share).cast("long")


def round_robin_quota(n: int, k: int, index: Column, offset: int = 0) -> Column:
    """n dealt over k sources; what is over goes to the sources from ``offset`` on, in turn."""
    return F.lit(n // k) + F.when(F.pmod(index - offset, F.lit(k)) < n % k, 1).otherwise(0)


def cyclic_allocation(n: int, k: int, index: Column) -> Column:
    """How many of n slots dealt in turn go to the index-th of k."""
    return F.greatest(F.lit(0), F.ceil((F.lit(n) - index) / F.lit(float(k)))).cast("long")


def first_successes(attempts: DataFrame, n: int, attempt: str, ordinal: str, success: str) -> DataFrame:
    """The first n successes in order of (attempt, cluster), as a loop in turn over the clusters would give."""
    return attempts.where(F.col(success)).orderBy(attempt, ordinal).limit(n)


def mixed_sources(df: DataFrame, n: int, source: str, local: str, externals: list[str], seed: int, key: str, offset: int = 0) -> DataFrame:
    """n // 2 rows of the local source, the others dealt over the external ones in turn."""
    quota = F.when(F.col(source) == local, n // 2)
    for i, name in enumerate(externals):
        quota = quota.when(F.col(source) == name, round_robin_quota(n - n // 2, len(externals), F.lit(i), offset))
    return per_group(df.where(F.col(source).isin(local, *externals)), source, quota, seed, key)


def token_selection(df: DataFrame, labels: str, key: str, share: float, seed: int) -> DataFrame:
    """df with labels masked (-100) but for floor(share n) of the n that aren't, chosen over the corpus.

    The threshold is the draw of the last one chosen: positions are ranked once, rows keep their arrays.
    """
    spots = df.select(key, F.posexplode(labels).alias("pos", "x")).where("x <> -100").select(key, "pos", uniform(seed, F.col(key), F.col("pos")).alias("u"))
    n = spots.count()
    chosen = spots.orderBy("u", key, "pos").limit(int(n * share)).groupBy(key).agg(F.collect_list("pos").alias("__keep"))
    keep = F.coalesce("__keep", F.array().cast("array<int>"))
    return df.join(chosen, key, "left").withColumn(labels, F.transform(labels, lambda x, i: F.when(F.array_contains(keep, i), x).otherwise(-100))).drop("__keep")


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    return draw(df, seed, *key).orderBy("u", *key)


def bernoulli(p: float, seed: int, *key: Column, inclusive: bool = False) -> Column:
    u = uniform(seed, *key)
    return u <= p if inclusive else u < p


def schedule(spark: SparkSession, start: float, end: float, rounds: int) -> DataFrame:
    """(round, gamma): linear from start to end; one round has the start."""
    step = (end - start) / (rounds - 1) if rounds > 1 else 0.0
    return spark.range(1, rounds + 1).select(F.col("id").alias("round"), (F.lit(start) + F.lit(step) * (F.col("id") - 1)).alias("gamma"))
