"""Round reports: nested artefacts to flat rows, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("generate_seconds", "fine_tune_seconds", "merge_seconds", "validation_seconds", "test_seconds")
TRAINING = ("training_examples", "train_examples_per_second", "train_tokens_per_second", "train_steps_per_second", "train_loss")
SCORES = ("accuracy", "precision", "recall", "specificity", "f1", "false_positive_rate", "false_negative_rate", "balanced_accuracy", "mcc")
VALIDATION = ("accuracy", "f1", "false_negative_rate")
TIMING = ("inference_seconds", "samples_per_second", "milliseconds_per_sample")


def joined_rounds(rounds: DataFrame, *parts: DataFrame) -> DataFrame:
    """Each round with what there is of its parts."""
    for p in parts:
        rounds = rounds.join(p, "round", "left")
    return rounds


def metric(block: str, name: str) -> Column:
    return F.try_element_at(F.col(block), F.lit(name)).cast("double")


def flat_rounds(rounds: DataFrame) -> DataFrame:
    """27 columns from (round, round_duration_seconds, stages, training, validation, test, timing: maps, artifact_size_bytes); what is missing is null."""
    return rounds.select(
        "round",
        F.col("round_duration_seconds").cast("double").alias("round_duration_seconds"),
        *[metric("stages", s).alias(s) for s in STAGES],
        *[metric("training", t).alias(t) for t in TRAINING],
        *[metric("validation", v).alias(f"validation_{v}") for v in VALIDATION],
        *[metric("test", s).alias(f"test_{s}") for s in SCORES],
        *[metric("timing", t).alias(t) for t in TIMING[:2]],
        F.col("artifact_size_bytes").cast("long").alias("artifact_size_bytes"),
    )


def four(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("-")


def markdown(rounds: DataFrame, columns: list[str], order: str = "round") -> DataFrame:
    """One row, one column: a Markdown table in order; numbers with four places, gaps as ``-``."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(order).cast("string"), *[four(c) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join([order, *columns])} |\n|{'---|' * (len(columns) + 1)}\n"
    rows = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return rounds.agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("report"))


def final_block(rounds: DataFrame, block: str, order: str = "round") -> DataFrame:
    """The last round's block as JSON."""
    return rounds.agg(F.to_json(F.max_by(block, order)).alias(f"final_{block}"))
