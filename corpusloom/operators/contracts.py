"""Dataset contracts: each broken rule is a row (rule, subject, expected, observed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIOLATION = "rule string, subject string, expected string, observed string"
#: Canonical sizes of the splits.
SPLITS = {"train": (2560, 653), "validation": (1920, 40), "test": (3200, 873)}
CLUSTERS = 48
VERSIONS = (2, 3)


def violation(rule: str, subject: Column, expected: Column, observed: Column) -> list[Column]:
    text = lambda c: c.cast("string")
    return [F.lit(rule).alias("rule"), text(subject).alias("subject"), text(expected).alias("expected"), text(observed).alias("observed")]


def split_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in SPLITS.items()], "split string, attack_count long, benign_count long")


def count_mismatches(actual: DataFrame, declared: DataFrame, key: str, count: str, rule: str) -> DataFrame:
    """Keys whose counts differ, or that are on one side only."""
    a, d = actual.select(F.col(key), F.col(count).alias("observed")), declared.select(F.col(key), F.col(count).alias("expected"))
    j = a.join(d, key, "full_outer").where(~F.col("observed").eqNullSafe(F.col("expected")))
    return j.select(*violation(rule, F.col(key), F.col("expected"), F.col("observed")))


def checksum_mismatches(actual: DataFrame, declared: DataFrame, rule: str = "checksum") -> DataFrame:
    """Both (file, sha256)."""
    return count_mismatches(actual, declared, "file", "sha256", rule)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, length) of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), "length")


def manifest_violations(spark: SparkSession, manifest: dict, split_counts: DataFrame, checksums: DataFrame) -> DataFrame:
    """Version, modes, split sizes and checksums of a build manifest."""
    head = [("version", "schema_version", "2 or 3", str(manifest.get("schema_version")))] if manifest.get("schema_version") not in VERSIONS else []
    modes = set(manifest.get("prompt_modes") or [])
    if modes != set(manifest.get("sft_files") or {}):
        head.append(("prompt_modes", "sft_files", ",".join(sorted(modes)), ",".join(sorted(manifest.get("sft_files") or {}))))
    out = spark.createDataFrame(head, VIOLATION)
    datasets = manifest.get("datasets") or {}
    for kind in ("attack_count", "benign_count"):
        declared = spark.createDataFrame([(k, v[kind]) for k, v in datasets.items()], f"split string, {kind} long")
        out = out.unionByName(count_mismatches(split_counts, declared, "split", kind, kind))
    files = spark.createDataFrame(list((manifest.get("artifact_files_sha256") or {}).items()), "file string, sha256 string")
    return out.unionByName(checksum_mismatches(checksums, files))


def derivation_violations(derived: dict) -> list[tuple[str, str, str, str]]:
    """A derived split's own counts: attacks a positive multiple of the clusters, benign 0 or more, both integers and no booleans."""
    out = []
    attack, benign = derived.get("attack_count"), derived.get("benign_count")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not whole(attack) or attack < CLUSTERS or attack % CLUSTERS:
        out.append(("attack_count", "derivation", f"a multiple of {CLUSTERS}", repr(attack)))
    if not whole(benign) or benign < 0:
        out.append(("benign_count", "derivation", "0 or more", repr(benign)))
    return out


def selection_violations(records: DataFrame, outputs: DataFrame, parents: DataFrame, quota: int) -> DataFrame:
    """records (output_index, parent_index, record_sha256, label, cluster) bind outputs to parents (index, sha256, label, cluster).

    Indexes are unique and not negative, each record's checksum, label and cluster are those of its
    output and its parent, and every cluster has the quota.
    """
    negative = records.where("parent_index < 0").select(*violation("negative", F.col("output_index"), F.lit("0 or more"), F.col("parent_index")))
    twice = records.groupBy("parent_index").agg(F.count("*").alias("n")).where("n > 1").select(*violation("unique", F.col("parent_index"), F.lit(1), F.col("n")))
    out = negative.unionByName(twice)
    for name, table, key in (("output", outputs, "output_index"), ("parent", parents, "parent_index")):
        j = records.alias("r").join(table.alias("t"), F.col(f"r.{key}") == F.col("t.index"), "left")
        for c, of in (("sha256", "record_sha256"), ("label", "label"), ("cluster", "cluster")):
            out = out.unionByName(j.where(~F.col(f"t.{c}").eqNullSafe(F.col(f"r.{of}"))).select(*violation(f"{name}_{c}", F.col(f"r.{key}"), F.col(f"r.{of}"), F.col(f"t.{c}"))))
    return out.unionByName(quota_violations(records.where(~F.col("label")), "cluster", quota))


def quota_violations(df: DataFrame, key: str, quota: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") != quota).select(*violation("quota", F.col(key), F.lit(quota), F.col("n")))


def resume_violations(saved: dict, current: dict) -> list[tuple[str, str, str, str]]:
    """Taxonomy version, arms, prompt mode and mixing of a checkpoint against those of this run."""
    keys = ("taxonomy_version", "attack_clusters", "prompt_mode", "mix_benign_sources")
    return [("resume", k, repr(current.get(k)), repr(saved.get(k))) for k in keys if saved.get(k) != current.get(k)]


def restored_weights(saved: DataFrame, arms: DataFrame, key: str = "cluster") -> DataFrame:
    """Saved weights of exactly the declared arms; a missing or an extra one raises on reading."""
    j = arms.select(key, F.lit(True).alias("__arm")).join(saved, key, "full_outer")
    bad = F.col("__arm").isNull() | F.col("weight").isNull()
    return j.withColumn("weight", F.when(bad, F.raise_error(F.concat(F.lit("weights don't fit the arms: "), F.col(key))).cast("double")).otherwise(F.col("weight"))).drop("__arm")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
