"""Binary-classification metrics, global and for each cluster, in one conditional aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = "malicious", "benign"


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for a zero denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(truth: Column, predicted: Column) -> dict[str, Column]:
    """Counts; a prediction that is neither label is wrong: a miss of a positive, a false alarm on a negative."""
    t, p = F.lower(F.trim(truth)), F.coalesce(F.lower(F.trim(predicted)), F.lit(""))
    count = lambda c: F.count_if(c)
    return {
        "total": F.count("*"),
        "tp": count((t == POSITIVE) & (p == POSITIVE)),
        "fn": count((t == POSITIVE) & (p != POSITIVE)),
        "tn": count((t == NEGATIVE) & (p == NEGATIVE)),
        "fp": count((t == NEGATIVE) & (p != NEGATIVE)),
        "invalid": count(~p.isin(POSITIVE, NEGATIVE)),
    }


def rates() -> dict[str, Column]:
    """Rates from the counts of confusion(); all 0 where the denominator is."""
    c = {k: F.col(k).cast("double") for k in ("total", "tp", "fn", "tn", "fp", "invalid")}
    tp, fn, tn, fp = c["tp"], c["fn"], c["tn"], c["fp"]
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "support_malicious": F.col("tp") + F.col("fn"),
        "support_benign": F.col("tn") + F.col("fp"),
        "accuracy": ratio(tp + tn, c["total"]),
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "f1": ratio(2 * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
        "balanced_accuracy": (recall + specificity) / 2,
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "validity_rate": ratio(c["total"] - c["invalid"], c["total"]),
    }


def checked_truth(df: DataFrame, truth: str) -> DataFrame:
    """df; reading a row whose ground truth is neither label raises."""
    ok = F.lower(F.trim(F.col(truth))).isin(POSITIVE, NEGATIVE)
    return df.withColumn(truth, F.when(F.coalesce(ok, F.lit(False)), F.col(truth)).otherwise(F.raise_error(F.concat(F.lit("unknown ground truth: "), F.coalesce(F.col(truth), F.lit("null"))))))


def classification_metrics(df: DataFrame, truth: str, predicted: str, by: str | None = None, total: str | None = None) -> DataFrame:
    """One row, or one for each value of ``by``; with ``total`` a row of that name over all, in the same pass."""
    counts = [c.alias(k) for k, c in confusion(F.col(truth), F.col(predicted)).items()]
    rows = checked_truth(df, truth)
    if by is None:
        out = rows.agg(*counts)
    elif total is None:
        out = rows.groupBy(by).agg(*counts)
    else:
        out = rows.rollup(by).agg(*counts, F.grouping(by).alias("__all")).withColumn(by, F.when(F.col("__all") == 1, total).otherwise(F.col(by))).drop("__all")
    return out.withColumns(rates())


def cluster_stats(df: DataFrame, cluster: str, truth: str, predicted: str) -> DataFrame:
    """total, correct, accuracy, fn, fp; a false negative is an explicit ``benign`` only."""
    t, p = F.col(truth), F.coalesce(F.col(predicted), F.lit(""))
    out = df.groupBy(cluster).agg(F.count("*").alias("total"), F.count_if(t == p).alias("correct"), F.count_if((t == POSITIVE) & (p == NEGATIVE)).alias("fn"), F.count_if((t == NEGATIVE) & (p == POSITIVE)).alias("fp"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def duplicates(df: DataFrame, text: str, by: str) -> DataFrame:
    """rows, distinct texts and duplicates by key."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col(text), F.lit(""))).alias("n_distinct")).withColumn("duplicates", F.col("n") - F.col("n_distinct"))


def generation_accounting(slots: DataFrame, by: str, success: str, text: str) -> DataFrame:
    """generated, attempts, failures, retries and duplicates of each cluster."""
    done = F.col(success)
    out = slots.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if(done).alias("generated"), F.count_if(~done).alias("failures"), F.count_distinct(F.when(done, F.col(text))).alias("n_distinct"))
    return out.withColumns({"retries": F.greatest(F.lit(0), F.col("attempts") - F.col("generated")), "duplicates": F.col("generated") - F.col("n_distinct")}).drop("n_distinct")


def outcome_stats(df: DataFrame, by: str, status: str) -> DataFrame:
    """attempts, success, failed, duplicates, success_rate from a status column."""
    is_ = lambda v: F.count_if(F.col(status) == v)
    return df.groupBy(by).agg(F.count("*").alias("attempts"), is_("success").alias("success"), is_("failed").alias("failed"), is_("duplicate").alias("duplicates")).withColumn("success_rate", ratio(F.col("success"), F.col("attempts")))


def nearest_rank(p: float, value: Column) -> Column:
    """The value of rank ceil(p n)."""
    return F.percentile_disc(p, value) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `__v`)")


def length_stats(df: DataFrame, length: str, limits: tuple[int, ...] = (2048, 4300), most: int = 4300) -> DataFrame:
    """min, p50, p95, max, mean, counts over limits and truncated; 0 on no rows."""
    v = f"`{length}`"
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t)
    return df.agg(
        F.count(length).alias("n"),
        zero(F.min(length), "long").alias("min_len"),
        zero(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v})"), "long").alias("p50"),
        zero(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {v})"), "long").alias("p95"),
        zero(F.max(length), "long").alias("max_len"),
        zero(F.avg(length), "double").alias("mean_len"),
        *[F.count_if(F.col(length) > x).alias(f"over_{x}") for x in limits],
        F.count_if(F.col(length) > most).alias("truncated"),
    )


def throughput(df: DataFrame, labels: str, epochs: int, seconds: float) -> DataFrame:
    """examples, supervised tokens and rates; a rate is 0 for no seconds."""
    known = F.coalesce(F.size(F.filter(labels, lambda x: x != -100)), F.lit(0))
    out = df.agg((F.count("*") * epochs).alias("examples"), (F.coalesce(F.sum(known), F.lit(0)) * epochs).alias("supervised_tokens"))
    s = F.lit(float(seconds))
    return out.withColumns({"examples_per_second": ratio(F.col("examples"), s), "tokens_per_second": ratio(F.col("supervised_tokens"), s)})
