"""Rounds of the feedback loop: each a function of state and predictions, tables written between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import uniform
from ..operators import control, metrics, sampling, taxonomy, templates
from .config import Settings


@dataclass(frozen=True)
class State:
    """weights (cluster, weight); controller: one row (ema, rho)."""

    weights: DataFrame
    controller: DataFrame

    @staticmethod
    def first(spark: SparkSession, arms: DataFrame, settings: Settings) -> State:
        return State(arms.select("cluster", F.lit(1.0).alias("weight")), spark.range(1).select(F.lit(settings["verifier.benign_fpr_target"]).alias("ema"), F.lit(settings["initial_benign_ratio"]).alias("rho")))


def next_state(state: State, predictions: DataFrame, arms: DataFrame, settings: Settings) -> State:
    """After a round's validation predictions (cluster, ground_truth, predicted_answer): new weights and benign ratio."""
    stats = metrics.cluster_stats(predictions, "cluster", "ground_truth", "predicted_answer")
    rewards = control.smoothed_rewards(stats, arms, alpha=settings["verifier.reward_smoothing_alpha"], beta=settings["verifier.reward_smoothing_beta"])
    weights = control.centered_weights(rewards, state.weights, eta=settings["verifier.learning_rate"])
    benign = predictions.where(F.col("cluster") == taxonomy.BENIGN).agg(F.avg((F.col("predicted_answer") != metrics.NEGATIVE).cast("double")).alias("error"))
    d, s, target = (settings[f"verifier.{k}"] for k in ("benign_error_ema_decay", "benign_ratio_step_size", "benign_fpr_target"))
    ema = F.coalesce(d * F.col("ema") + (1 - d) * F.col("error"), F.col("ema"))
    moved = state.controller.crossJoin(benign).select(ema.alias("ema"), F.col("rho"))  # two single rows
    rho = F.least(F.lit(settings["verifier.benign_ratio_max"]), F.greatest(F.lit(settings["verifier.benign_ratio_min"]), F.col("rho") + s * (F.col("ema") - target)))
    return State(weights, moved.select("ema", rho.alias("rho")))


def chosen_clusters(state: State, arms: DataFrame, settings: Settings, round_: int) -> DataFrame:
    """(cluster, ordinal, probability) of the round's arms."""
    n, a, b = settings["num_rounds"], settings["attacker.gamma_start"], settings["attacker.gamma_end"]
    gamma = a + (b - a) * (round_ - 1) / (n - 1) if n > 1 else a
    p = control.sampling_distribution(state.weights, arms, gamma, settings["attacker.weight_exponent"])
    k = settings["attacker.clusters_per_round"]
    if settings["attacker.strategy"] == "top_k":
        return sampling.top_k(p, k, "probability", "ordinal")
    return sampling.weighted_without_replacement(p, k, "probability", settings["random_seed"] + round_, "cluster").drop("u", "wait")


def synthesised(clusters: DataFrame, arms: DataFrame, pool: DataFrame, carriers: DataFrame, notes: DataFrame, n: int, seed: int, tries: int = 4) -> DataFrame:
    """n samples dealt in turn over the clusters; each slot has ``tries`` draws of a template, carrier and note.

    pool (technique, reference_scope, payload), carriers (sql, db, requires_comment_delimiter), notes (comment).
    A slot whose draws all break the contract is left out: compare the count with n.
    """
    picked = clusters.select("cluster", "ordinal").join(arms.drop("ordinal"), "cluster").withColumn("i", F.row_number().over(control.all_rows().orderBy("ordinal")) - 1)
    k = F.count("*").over(control.all_rows())
    slots = picked.withColumn("k", k).withColumn("slot", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda x: F.when(F.pmod(x, F.col("k")) == F.col("i"), x)), lambda x: x.isNotNull())))
    slots = slots.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    u = lambda what: uniform(seed, F.lit(what), F.col("slot"), F.col("attempt"))
    number = lambda df, *by: df.withColumns({"__n": F.row_number().over(sampling.Window.partitionBy(*by).orderBy(*[c for c in df.columns if c not in by])) - 1, "__c": F.count("*").over(sampling.Window.partitionBy(*by))})

    def drawn(df: DataFrame, table: DataFrame, by: list[str], what: str) -> DataFrame:
        numbered = number(table, *by)
        sizes = numbered.select(*by, "__c").distinct()
        return df.join(sizes, by).withColumn("__n", F.floor(u(what) * F.col("__c")).cast("int")).drop("__c").join(numbered.drop("__c"), [*by, "__n"]).drop("__n")

    rows = drawn(slots, pool.select("technique", "reference_scope", "payload").withColumnRenamed("payload", "core"), ["technique", "reference_scope"], "template")
    rows = rows.withColumn("requires", F.col("comment_state") != "no_comment")
    rows = drawn(rows, carriers.select(F.col("sql").alias("carrier"), "db", F.col("requires_comment_delimiter").alias("requires")), ["requires"], "carrier")
    rows = drawn(rows.withColumn("__one", F.lit(1)), notes.select(F.lit(1).alias("__one"), F.col("comment").alias("note")), ["__one"], "note").drop("__one")
    done = templates.assembled(rows.withColumn("prefix", F.lit(X.COMMENT_PREFIXES[0])), "core", "comment_state", "carrier", "requires", "note", "prefix")
    ok = done.where("reject IS NULL").withColumn("difficulty", X.difficulty(F.col("reference_scope"), F.col("comment_state")))
    return sampling.one_per_group(ok, "slot", seed, "slot", "attempt")


def run_rounds(spark: SparkSession, settings: Settings, arms: DataFrame, generate, predict, folder: str, first: State | None = None) -> DataFrame:
    """The loop: generate(round, clusters, controller) -> training table, predict(round, table) -> predictions.

    Every round's state is written under the folder and read back, so lineage doesn't grow and a run can
    go on from the last round. Returns (round, cluster, weight, ema, rho).
    """
    state, log = first or State.first(spark, arms, settings), None
    for r in range(1, settings["num_rounds"] + 1):
        table = generate(r, chosen_clusters(state, arms, settings, r), state.controller)
        new = next_state(state, predict(r, table), arms, settings)
        new.weights.write.mode("overwrite").parquet(f"{folder}/round_{r}/weights")
        new.controller.write.mode("overwrite").parquet(f"{folder}/round_{r}/controller")
        state = State(spark.read.parquet(f"{folder}/round_{r}/weights"), spark.read.parquet(f"{folder}/round_{r}/controller"))
        rows = state.weights.crossJoin(state.controller).withColumn("round", F.lit(r))  # a row for each arm with one row
        log = rows if log is None else log.unionByName(rows)
    return log
