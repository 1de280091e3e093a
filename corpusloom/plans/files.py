"""Queries that write files or tables and read them back, settings, and the loop of rounds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import taxonomy
from ..sources import io
from . import config, rounds
from .queries import config_example, longs
from .registry import Tables, query


@query("s1_json_array", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS tag FROM nation")
def json_array(t: Tables) -> DataFrame:
    """All nations as one JSON array in one file."""
    rows = F.struct("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name")).alias("tags"))
    path = io.scratch_folder(t.spark)
    t.nation.agg(F.to_json(F.collect_list(rows)).alias("value")).write.text(path)
    return io.read_json(t.spark, path, "n_nationkey long, n_name string, tags array<string>").select("n_nationkey", "n_name", F.get("tags", F.lit(0)).alias("tag"))


@query("k1_json_file", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def json_file(t: Tables) -> DataFrame:
    path = io.scratch_folder(t.spark)
    io.write_json(t.region.select("r_regionkey", "r_name"), path)
    return t.spark.read.schema("r_regionkey long, r_name string").json(path)


@query("s4_u5_labelled_csv", "SELECT c_name || ', \"' || c_custkey || '\"' AS sql, TRUE AS label FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 5 <> 0")
def labelled_csv(t: Tables) -> DataFrame:
    """Quoted texts, labels in any case with blanks around them, blank texts, columns that aren't asked for."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, " ").otherwise(F.concat("c_name", F.lit(', "'), k.cast("string"), F.lit('"')))
    label = F.when(k % 3 == 0, "Normal").when(k % 3 == 1, " NORMAL ").otherwise("attack")
    path = io.scratch_folder(t.spark)
    t.customer.select(F.lit("x").alias("more"), text.alias("Query"), label.alias("Label")).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return io.read_labelled_csv(t.spark, path, "Query", "Label", " normal")


@query("k2_k3_s2_event_log", "SELECT event_type, count(*) AS n, 0::BIGINT AS bad FROM events GROUP BY event_type UNION ALL SELECT 'bad', 0, count(*) FROM events WHERE event_type = 'error'")
def event_log(t: Tables) -> DataFrame:
    """Some of the events written, the others appended, and a broken line for each error."""
    path, half = io.scratch_folder(t.spark), F.col("value") < 50
    rows = t.events.select("event_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    io.write_jsonl(rows.where(half), path)
    io.append_events(rows.where(~half), path)
    rows.where("event_type = 'error'").select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    good, bad = io.read_jsonl(t.spark, path, "event_id long, event_type string")
    counted = good.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("bad", F.lit(0).cast("long"))
    return counted.unionByName(bad.agg(F.count("*").alias("bad")).select(F.lit("bad").alias("event_type"), F.lit(0).cast("long").alias("n"), "bad"))


@query("s9_s10_s13_round_folders", "SELECT (r_regionkey + 8)::BIGINT AS round, r_name AS name, (SELECT sum(length(r_name) + 12)::BIGINT FROM region) AS bytes FROM region")
def round_folders(t: Tables) -> DataFrame:
    """A file for each round, listed in the order of the numbers; one of the files asked for is not there."""
    path = io.scratch_folder(t.spark)
    for r in t.region.select("r_regionkey", "r_name").collect():  # five rows
        t.spark.createDataFrame([(json.dumps({"name": r["r_name"]}, separators=(",", ":")),)], "value string").coalesce(1).write.text(f"{path}/round_{r['r_regionkey'] + 8}")
    files = io.round_folders(t.spark, path)
    names = [f["file"] for f in files.collect()]
    found = io.read_optional_json(t.spark, [*names, f"{path}/round_99/none.json"], "name string").withColumn("round", F.regexp_extract(F.input_file_name(), r"/round_(\d+)/", 1).cast("long"))
    return found.join(files.select(F.col("round").cast("long").alias("round")), "round").select("round", "name", F.lit(io.folder_bytes(t.spark, path).first()["bytes"]).alias("bytes"))


@query("k4_csv_file", "SELECT r_name, r_regionkey::VARCHAR AS r_regionkey FROM region")
def csv_file(t: Tables) -> DataFrame:
    path = io.scratch_folder(t.spark)
    io.write_csv(t.region.select("r_name", "r_regionkey"), path)
    return t.spark.read.option("header", True).csv(path)


@query("k8_output_paths", "SELECT * FROM (VALUES ('inside', FALSE), ('below', FALSE), ('beside', TRUE), ('store', TRUE), ('file', FALSE)) v(place, allowed)")
def output_paths(t: Tables) -> DataFrame:
    def allowed(path: str) -> bool:
        try:
            return io.outside_project(path) == path
        except ValueError:
            return False

    places = {"inside": str(io.PROJECT), "below": f"{io.PROJECT}/a/../b", "beside": f"{io.PROJECT}-out", "store": f"store://host{io.PROJECT}", "file": f"file://{io.PROJECT}/x"}
    return t.spark.createDataFrame([(k, allowed(p)) for k, p in places.items()], "place string, allowed boolean")


@query("s6_s7_database", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, (SELECT max(n_nationkey)::VARCHAR FROM nation) AS top, '' AS none FROM nation")
def database(t: Tables) -> DataFrame:
    """A table in a database of its own, sampled and asked for single values over JDBC."""
    url, driver = io.small_database(t.nation.select("n_nationkey", "n_name"), "nation"), {"driver": io.DERBY}
    rows = io.read_table(t.spark, url, "nation", ["n_nationkey", "n_name"], 100, **driver)
    top = io.scalar_query(t.spark, url, 'SELECT max("n_nationkey") AS top FROM nation', **driver)
    none = io.scalar_query(t.spark, url, "SELECT no_such_column FROM nation", **driver)
    return longs(rows.toDF("n_nationkey", "n_name"), "n_nationkey").withColumns({"top": F.lit(top), "none": F.lit(none)})


SETTINGS_ASKED = ("num_rounds", "prompt_mode", "mix_benign_sources", "verifier.benign_ratio_max", "attacker.gamma_start", "synthesis.cepp.llm_max_tokens")


@query("v6_v7_settings", """SELECT * FROM (VALUES ('plain', 'num_rounds', '8'), ('plain', 'prompt_mode', 'query_only'), ('plain', 'mix_benign_sources', 'True'), ('plain', 'verifier.benign_ratio_max', '0.35'), ('plain', 'attacker.gamma_start', '0.7'), ('plain', 'synthesis.cepp.llm_max_tokens', '96'),
('aware', 'num_rounds', '2'), ('aware', 'prompt_mode', 'schema_aware'), ('aware', 'mix_benign_sources', 'False'), ('aware', 'verifier.benign_ratio_max', '0.35'), ('aware', 'attacker.gamma_start', '0.7'), ('aware', 'synthesis.cepp.llm_max_tokens', '96'),
('version', 'refused', 'True'), ('rounds', 'refused', 'True'), ('ratio', 'refused', 'True'), ('flag', 'refused', 'True'), ('section', 'refused', 'True'), ('mode', 'refused', 'True'), ('gamma', 'refused', 'True'), ('lacking', 'refused', 'True')) v(what, name, value)""")
def settings_table(t: Tables) -> DataFrame:
    """Defaults and overrides of a settings file, and files that are refused."""
    example = config_example()
    plain = config.settings(example)
    rows = [(what, n, str(s[n])) for what, s in (("plain", plain), ("aware", plain.overridden(prompt_mode="schema_aware", num_rounds=2))) for n in SETTINGS_ASKED]
    wrong = {
        "version": {"schema_version": 4}, "rounds": {"num_rounds": 0}, "ratio": {"initial_benign_ratio": 0.9}, "flag": {"mix_benign_sources": "yes"}, "section": {"attacker": 3}, "mode": {"prompt_mode": "odd"},
        "gamma": {"attacker": example["attacker"] | {"gamma_end": 0.9}}, "lacking": {"schema_version": 3},
    }
    for what, change in wrong.items():
        try:
            config.settings(example | change)
            rows.append((what, "refused", "False"))
        except ValueError:
            rows.append((what, "refused", "True"))
    return t.spark.createDataFrame(rows, "what string, name string, value string")


@query("l6_rounds_loop", """WITH RECURSIVE s AS (SELECT 0 AS round, 0.05::DOUBLE AS ema, 0.25::DOUBLE AS rho UNION ALL SELECT round + 1, 0.7::DOUBLE * ema + (1 - 0.7::DOUBLE), least(0.35::DOUBLE, greatest(0.15::DOUBLE, rho + 0.5::DOUBLE * ((0.7::DOUBLE * ema + (1 - 0.7::DOUBLE)) - 0.05::DOUBLE))) FROM s WHERE round < 3)
SELECT s.round::BIGINT AS round, c.cluster, round(1.0::DOUBLE, 9) AS weight, round(ema, 9) AS ema, round(rho, 9) AS rho FROM s, (VALUES ('tautology||lor||no_comment'), ('tautology||lor||clean_comment'), ('tautology||lor||cepp')) c(cluster) WHERE s.round > 0""")
def rounds_loop(t: Tables) -> DataFrame:
    """Three rounds in which every attack is told and every harmless row is not: weights stay, the benign share grows to its bound."""
    arms = taxonomy.arms(t.spark).where("ordinal < 3")
    example = config_example()
    settings = config.settings(example | {"num_rounds": 3, "attacker": example["attacker"] | {"clusters_per_round": 2, "strategy": "top_k"}})
    every = arms.select("cluster").unionByName(t.spark.createDataFrame([(taxonomy.BENIGN,)], "cluster string"))

    def predict(r: int, table: DataFrame) -> DataFrame:
        return every.select("cluster", F.when(F.col("cluster") == taxonomy.BENIGN, "benign").otherwise("malicious").alias("ground_truth"), F.lit("malicious").alias("predicted_answer"))

    log = rounds.run_rounds(t.spark, settings, arms, lambda r, clusters, controller: clusters, predict, io.scratch_folder(t.spark))
    return log.select(F.col("round").cast("long").alias("round"), "cluster", *[F.round(c, 9).alias(c) for c in ("weight", "ema", "rho")])
