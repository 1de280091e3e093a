"""Expectations with hand-computed numbers, edge cases and round trips."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.functions import text as X
from corpusloom.operators import contracts, control, memory, metrics, reporting, sampling, sft, taxonomy, telemetry, templates
from corpusloom.plans import config, rounds
from corpusloom.plans.queries import config_example
from corpusloom.sources import io

DATA = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_confusion_counts_invalid_answers_as_wrong(spark):
    rows = [("malicious", "malicious"), ("benign", "benign"), ("benign", "malicious"), ("malicious", "Benign "), ("benign", "unknown")]
    r = metrics.classification_metrics(spark.createDataFrame(rows, "t string, p string"), "t", "p").first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["invalid"]) == (1, 1, 2, 1, 1)
    assert r["accuracy"] == pytest.approx(0.4) and r["precision"] == pytest.approx(1 / 3)
    assert r["support_malicious"] == 2 and r["tp"] + r["fn"] == 2
    only = metrics.classification_metrics(spark.createDataFrame([("malicious", "malicious")], "t string, p string"), "t", "p").first()
    assert (only["specificity"], only["mcc"], only["balanced_accuracy"]) == (0.0, 0.0, 0.5)
    with pytest.raises(Exception, match="unknown ground truth"):
        metrics.classification_metrics(spark.createDataFrame([("odd", "benign")], "t string, p string"), "t", "p").collect()


def test_taxonomy(spark):
    arms = taxonomy.arms(spark).orderBy("ordinal").collect()
    assert len(arms) == 48 and len({a["category"] for a in arms}) == 16
    assert arms[0]["cluster"] == "tautology||lor||no_comment" and arms[-1]["cluster"] == "time_blind||scr||cepp"


def test_distribution_budget_and_schedule(spark):
    arms = spark.createDataFrame([("a", 0), ("b", 1)], "cluster string, ordinal int")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("benign", 10000.0)], "cluster string, weight double")
    p = {r["cluster"]: r["probability"] for r in control.sampling_distribution(weights, arms, 0.7, 2.0).collect()}
    assert p == {"a": pytest.approx(0.38), "b": pytest.approx(0.62)}
    none = control.sampling_distribution(weights.where("false"), arms, 0.7).collect()
    assert [r["probability"] for r in none] == [pytest.approx(0.5)] * 2
    assert one(spark, sampling.split_budget(300, F.lit(0.25)).alias("n"))["n"] == 75
    g = [r["gamma"] for r in sampling.schedule(spark, 0.7, 0.2, 8).collect()]
    assert g[0] == pytest.approx(0.7) and g[-1] == pytest.approx(0.2)
    assert [r["gamma"] for r in sampling.schedule(spark, 0.7, 0.2, 1).collect()] == [0.7]


def test_rewards_and_weights(spark):
    arms = spark.createDataFrame([("A", 0), ("B", 1)], "cluster string, ordinal int")
    stats = spark.createDataFrame([("A", 3, 2), ("B", 2, 0)], "cluster string, total long, fn long")
    rewards = control.smoothed_rewards(stats, arms)
    assert {r["cluster"]: r["reward"] for r in rewards.collect()} == {"A": pytest.approx(0.6), "B": pytest.approx(0.25)}
    w = control.centered_weights(rewards, spark.createDataFrame([], "cluster string, weight double"), eta=0.3)
    assert {r["cluster"]: r["weight"] for r in w.collect()} == {"A": pytest.approx(math.exp(0.0525)), "B": pytest.approx(math.exp(-0.0525))}
    with pytest.raises(Exception, match="no statistics"):
        control.smoothed_rewards(stats.where("cluster = 'A'"), arms).collect()


def test_source_quotas(spark):
    quota = lambda offset: [one(spark, sampling.round_robin_quota(38, 3, F.lit(i), offset).alias("q"))["q"] for i in range(3)]
    assert quota(0) == [13, 13, 12] and quota(1) == [12, 13, 13]
    rows = spark.createDataFrame([(f"{s}{i}", s) for s in "abcd" for i in range(60)], "id string, source string")
    got = sampling.mixed_sources(rows, 75, "source", "a", ["b", "c", "d"], 1, "id").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 37, "b": 13, "c": 13, "d": 12}


def test_sampling_edges(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        sampling.uniform_sample(df, 11, 1, "id", strict=True)
    assert sampling.uniform_sample(df, 4, 1, "id").select("id").distinct().count() == 4
    assert sampling.with_replacement(df.repartition(3), 25, 1, "id").count() == 25
    assert sampling.with_replacement(df, 5, 1, "id").select("id").distinct().count() == 5
    with pytest.raises(ValueError):
        sampling.with_replacement(df.where("false"), 5, 1, "id")
    a, b = (sorted(r["id"] for r in sampling.uniform_sample(x, 4, 7, "id").collect()) for x in (df, df.repartition(7)))
    assert a == b


def test_strategy_boundary(spark):
    assert [one(spark, templates.comment_strategy(F.lit(u)).alias("s"))["s"] for u in (0.19, 0.2)] == ["rational", "local"]


def test_memory(spark, tmp_path):
    mutated = spark.createDataFrame([("c", f"m{i}") for i in range(2)], "category string, text string")
    source = spark.createDataFrame([("c", f"s{i}") for i in range(6)], "category string, text string")
    picked = memory.few_shot(mutated, source, "category", 5, 1, "text").collect()
    assert [r["text"][0] for r in sorted(picked, key=lambda r: r["rank"])] == ["m", "m", "s", "s", "s"]
    rows = memory.checkpoint_rows(source, "category", "text", 3)
    memory.save(rows, f"{tmp_path}/m", "category")
    assert memory.restore(spark, f"{tmp_path}/m", 3).count() == 1
    with pytest.raises(ValueError):
        memory.restore(spark, f"{tmp_path}/m", 4)
    new = memory.new_rows(spark.createDataFrame([("S0 ",), ("other",)], "text string"), memory.known_fingerprints(mutated, source, text="text"), "text")
    assert [r["text"] for r in new.collect()] == ["other"]
    assert memory.recorded(new, new).count() == 1


def test_checkpoint_in_bounded_rows(spark, tmp_path, monkeypatch):
    """A category larger than a row is dealt over several, a frequent text over pieces; nothing is lost."""
    monkeypatch.setattr(memory, "PART_BYTES", 2000)
    monkeypatch.setattr(memory, "TASK_BYTES", 8000)
    texts = {"a": [f"text number {i}" for i in range(900)] + ["Hot  text"] * 300 + ["hot text"] * 300 + [None, None], "b": ["x", "X ", "y", ""], "c": [None], None: ["z", "z"]}
    df = spark.createDataFrame([(c, t) for c, ts in texts.items() for t in ts], "category string, text string").repartition(5)
    memory.save(memory.checkpoint_rows(df, "category", "text", 3), f"{tmp_path}/m", "category")
    rows = memory.restore(spark, f"{tmp_path}/m", 3)
    held = sorted(rows.collect(), key=lambda r: (str(r["category"]), r["part"], r["piece"]))
    assert max(sum(16 + len(t or "") for t in r["templates"]) for r in held) < 3 * 2000 and sum(r["category"] == "b" for r in held) == 1
    fps = {c: sorted({hashlib.md5(" ".join(t.lower().split()).encode()).hexdigest() for t in ts if t is not None}) for c, ts in texts.items()}
    for c, ts in texts.items():
        own = [r for r in held if r["category"] == c]
        assert Counter(t for r in own for t in r["templates"]) == Counter(ts) and list(dict.fromkeys(f for r in own for f in r["fingerprints"])) == fps[c]
        assert all(r["templates"] == sorted(r["templates"], key=lambda t: (t is not None, t or "")) for r in own)
    want = {(c, len(ts), hashlib.md5(",".join(fps[c]).encode()).hexdigest() if fps[c] else None) for c, ts in texts.items()}
    assert {tuple(r) for r in memory.digests(rows, "category").collect()} == want


def test_prompts_and_records(spark):
    df = spark.createDataFrame([("SELECT 1", True, None), ("SELECT 2", False, "hard")], "sql string, label boolean, difficulty string")
    out = sft.sft_records(df.withColumn("technique", F.lit("t")), "Classify.", "sql_only", "sql", "label", ["technique"]).collect()
    assert [m["content"] for m in out[0]["messages"]] == ["Classify.", "SQL:\nSELECT 1", "benign"] and out[0]["technique"] is None
    assert (out[1]["technique"], out[1]["difficulty"], out[1]["messages"][2]["content"]) == ("t", "hard", "malicious")
    with pytest.raises(ValueError):
        sft.user_prompt("other", F.lit(""))
    with pytest.raises(Exception, match="no schema"):
        sft.with_schema(df.withColumn("db", F.lit("x")), spark.createDataFrame([("y", 0)], "db string, ordinal int"), "db", "ordinal", required=True).collect()


def test_chat_prefix_and_masks(spark):
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("system", "s"), ("user", "u"), ("assistant", "a"))])
    r = one(spark, sft.rendered_chat(m).alias("full"), sft.rendered_chat(m, True).alias("open"))
    assert r["full"].startswith(r["open"])
    ids = F.array(*[F.lit(i) for i in range(5)])
    assert one(spark, sft.masked_prompt(ids, F.slice(ids, 1, 2)).alias("x"))["x"] == [-100, -100, 2, 3, 4]
    assert one(spark, sft.masked_prompt(ids, F.array(F.lit(9))).alias("x"))["x"] is None
    stats = metrics.length_stats(spark.createDataFrame([(4,), (12,)], "n int"), "n", (8,), 8).first()
    assert (stats["over_8"], stats["truncated"], stats["p50"], stats["max_len"]) == (1, 1, 4, 12)
    assert metrics.length_stats(spark.createDataFrame([], "n int"), "n").first()["max_len"] == 0


def test_energy_and_stages(spark):
    samples = spark.createDataFrame([(1, 0, 50.0), (1, 5, 70.0)], "gpu int, s long, w double").withColumn("ts", F.timestamp_seconds("s"))
    assert telemetry.energy(samples, ["gpu"], "ts", "s", "w").first()["wh"] == pytest.approx(60 * 5 / 3600)
    ev = [(1, "a", "completed", 0), (1, "a", "started", 1), (1, "a", "started", 2), (1, "a", "completed", 3), (None, "b", "started", 1), (None, "b", "completed", 4), (2, "c", "started", 5)]
    df = spark.createDataFrame(ev, "round int, stage string, event string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["round"], r["stage"], r["started"].second, r["completed"].second) for r in telemetry.paired_stages(df, ["round", "stage"], "ts", "event", "s").collect()}
    assert got == {(1, "a", 2, 3), (None, "b", 1, 4)}
    log = []
    with telemetry.stage_timer(log.append, "x", 3):
        pass
    assert [e["event"] for e in log] == ["started", "completed"] and log[1]["duration_seconds"] >= 0


def test_balance_positions(spark):
    for text, ok in (("a(b[c]{d})", True), ("(]", False), ("'(' ", True), ("'", False), ("\\(", True), ("", True), ('"it\'s"', True), ("())", False)):
        assert one(spark, X.balance(F.lit(text)).alias("b"))["b"]["balanced"] is ok, text
    assert one(spark, X.balance(F.lit("ab)")).alias("b"))["b"]["position"] == 2


def test_text_functions(spark):
    v = lambda c: one(spark, c.alias("v"))["v"]
    assert v(X.answer(F.lit("<answer> Not malicious </answer>"))) == "benign"
    assert v(X.answer(F.lit("it Is malicious"))) == "malicious" and v(X.answer(F.lit("Hm what"))) == "Hm" and v(X.answer(F.lit(""))) == ""
    assert [v(X.ddl_type(F.lit(t))) for t in ("bigint", "datetime", "time", "point", "")] == ["INTEGER", "DATE", "TIME", "INTEGER", "VARCHAR"]
    assert v(X.byte_size(F.lit("2K"))) == 2048 and v(X.byte_size(F.lit("x"))) is None
    assert v(X.sql_literal(F.lit("it's"), F.lit("varchar"))) == "'it''s'" and v(X.sql_literal(F.lit("7"), F.lit("varchar(9)"))) == "7" and v(X.sql_literal(F.lit(None).cast("string"), F.lit("int"))) == "NULL"
    assert v(X.filled(F.lit("a $x$ b $y$"), F.array(F.lit("1"), F.lit(None)))) == "a 1 b $y$"
    assert v(X.cleaned_output(F.lit(" Output: ```sql\n\nhello\nthere```"), ("Output:",))) == "hello"
    ids = X.identified(F.lit("x $sysInfo$"), F.lit("time_blind"), F.lit("odd"))
    assert (v(ids["technique"]), v(ids["reference_scope"])) == ("time_blind", "scr")
    u = v(hashing.uniform(1, F.lit("k")))
    assert 0 < u < 1 and u == v(hashing.uniform(1, F.lit("k")))


def test_contracts(spark, tmp_path):
    assert contracts.derivation_violations({"attack_count": 96, "benign_count": 0}) == []
    assert [r[0] for r in contracts.derivation_violations({"attack_count": True, "benign_count": -1})] == ["attack_count", "benign_count"]
    assert contracts.resume_violations({"taxonomy_version": 2}, {"taxonomy_version": 3})[0][1] == "taxonomy_version"
    (tmp_path / "a.txt").write_text("x")
    sums = contracts.file_checksums(spark, f"{tmp_path}/*.txt").select("file", "sha256")
    good = {"schema_version": 3, "prompt_modes": ["m"], "sft_files": {"m": {}}, "datasets": {"train": {"attack_count": 2, "benign_count": 1}}, "artifact_files_sha256": {sums.first()["file"]: sums.first()["sha256"]}}
    counts = spark.createDataFrame([("train", 2, 1)], "split string, attack_count long, benign_count long")
    assert contracts.manifest_violations(spark, good, counts, sums).count() == 0
    bad = good | {"schema_version": 9, "artifact_files_sha256": {"a.txt": "0"}, "datasets": {"train": {"attack_count": 3, "benign_count": 1}}}
    assert {r["rule"] for r in contracts.manifest_violations(spark, bad, counts, sums).collect()} == {"version", "attack_count", "checksum"}
    arms = spark.createDataFrame([("a",)], "cluster string")
    assert contracts.restored_weights(spark.createDataFrame([("a", 1.0)], "cluster string, weight double"), arms).count() == 1
    with pytest.raises(Exception, match="don't fit"):
        contracts.restored_weights(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "cluster string, weight double"), arms).collect()
    assert contracts.same_set(arms, arms)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = io.read_jsonl(spark, f"{tmp_path}/a.jsonl", "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["value"] for r in bad.collect()] == ["not json"]
    (tmp_path / "b.csv").write_text('Query,Label\n"SELECT ""x"", 1",Normal\n  ,normal\nq2,attack\n')
    assert [r["sql"] for r in io.read_labelled_csv(spark, f"{tmp_path}/b.csv", "Query", "Label", "normal").collect()] == ['SELECT "x", 1']
    with pytest.raises(ValueError, match="missing columns"):
        io.read_labelled_csv(spark, f"{tmp_path}/b.csv", "Query", "Kind", "normal")
    with pytest.raises(ValueError):
        io.outside_project(str(io.PROJECT / "out"))
    io.write_jsonl(good, f"{tmp_path}/out")
    io.append_events(good, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    io.write_csv(good.where("false"), f"{tmp_path}/csv")
    for n in (10, 9):
        (tmp_path / f"runs/round_{n}").mkdir(parents=True)
        (tmp_path / f"runs/round_{n}/m.json").write_text('{"x": %d}' % n)
    assert [r["round"] for r in io.round_folders(spark, f"{tmp_path}/runs").collect()] == [9, 10]
    assert io.folder_bytes(spark, f"{tmp_path}/runs").first()["bytes"] == 17
    assert io.read_optional_json(spark, [f"{tmp_path}/runs/round_9/m.json", f"{tmp_path}/none"], "x int").count() == 1
    assert io.read_optional_json(spark, [f"{tmp_path}/none"], "x int").count() == 0
    assert [r["x"] for r in io.read_json(spark, f"{tmp_path}/runs/round_9/m.json", "x int").collect()] == [9]
    (tmp_path / "t.csv").write_text("g,w\na,1.5\nb,\nc,N/A\n")
    assert [r["w"] for r in io.read_samples(spark, f"{tmp_path}/t.csv", ["g"], ["w"]).orderBy("g").collect()] == [1.5, None, None]


def test_settings():
    s = config.settings(config_example())
    assert s["verifier.benign_ratio_max"] == 0.35 and s["synthesis.cepp.llm_max_tokens"] == 96 and len(s.values) == 37
    assert s.overridden(prompt_mode="schema_aware")["mix_benign_sources"] is False
    assert s.overridden(num_rounds=2)["num_rounds"] == 2 and s.sha256() != s.overridden(num_rounds=2).sha256()
    for change in ({"schema_version": 4}, {"num_rounds": 0}, {"initial_benign_ratio": 0.9}, {"mix_benign_sources": "yes"}, {"attacker": 3}, {"prompt_mode": "odd"}, {"schema_version": 3}):
        with pytest.raises(ValueError):
            config.settings(config_example() | change)


def test_round_samples_keep_their_contracts(spark):
    from corpusloom.plans.registry import QUERIES

    rows = QUERIES["l5_l7_round"](spark, DATA).collect()
    assert len(rows) == 48 and len({r["slot"] for r in rows}) == 48
    per = {}
    for r in rows:
        per[r["cluster"]] = per.get(r["cluster"], 0) + 1
        assert ("-- " in r["sql"]) == (not r["cluster"].endswith("no_comment"))
    assert len(per) == 8 and set(per.values()) == {6}


def test_rounds_loop(spark, tmp_path):
    arms = taxonomy.arms(spark).limit(4)
    settings = config.settings(config_example() | {"num_rounds": 2, "attacker": config_example()["attacker"] | {"clusters_per_round": 2, "strategy": "top_k"}})
    every = arms.select("cluster").unionByName(spark.createDataFrame([("benign",)], "cluster string"))

    def predict(r, table):
        return every.select("cluster", F.when(F.col("cluster") == "benign", "benign").otherwise("malicious").alias("ground_truth"), F.lit("benign").alias("predicted_answer"))

    log = rounds.run_rounds(spark, settings, arms, lambda r, clusters, c: clusters, predict, str(tmp_path))
    assert log.count() == 8 and {r["round"] for r in log.collect()} == {1, 2}
    assert all(0.15 <= r["rho"] <= 0.35 and r["weight"] == pytest.approx(1.0) for r in log.collect())


def test_flat_rounds_have_27_columns(spark):
    from corpusloom.plans.queries import rounds_table
    from corpusloom.plans.registry import Tables

    assert len(reporting.flat_rounds(rounds_table(Tables(spark, DATA))).columns) == 27


def test_assigned_columns_fit_where_they_can(spark):
    from corpusloom.plans.registry import QUERIES

    rows = QUERIES["f11_f12_c13_assigned_columns"](spark, DATA).collect()
    assert rows and all((r["db"] == "shop") == (r["table_name"] in ("part", "orders")) for r in rows)
    assert all(r["column_type"] == "int" or r["column_type"] == "double" for r in rows if r["db"] == "shop" and r["table_id"] == 1)


def balanced(text):
    stack, quote, hidden = [], "", False
    for c in text:
        if not hidden:
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c in "([{":
                stack.append(c)
            elif c in ")]}" and (not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[c]):
                return False
        hidden = c == "\\"
    return not stack and not quote


def test_balanced_symbols_reads_whole_pages(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    pages = ["x" * 400, "x" * 400 + ")", "(" + "x" * 400 + ")", "x" * 299 + "'a'", "x" * 350 + "[(])", "(" * 10, "a" * 500 + "\\(", "x" * 400 + "'"]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["balanced"] for r in QUERIES["f17_balanced_symbols"](spark, str(tmp_path)).collect()}
    assert got == {i: balanced(h) for i, h in enumerate(pages)}


def test_token_selection_takes_all_vectors(spark, tmp_path):
    from corpusloom.functions import hashing
    from corpusloom.plans.registry import QUERIES

    spark.createDataFrame([(i, [0.5] * 8) for i in range(150)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spots = spark.range(150).selectExpr("id AS v", "explode(sequence(0, 7)) AS pos").select("v", "pos", hashing.uniform(42, F.col("v"), F.col("pos")).alias("u")).collect()
    want = dict.fromkeys(range(150), 0)
    for r in sorted(spots, key=lambda r: (r["u"], r["v"], r["pos"]))[: 150 * 8 * 3 // 10]:
        want[r["v"]] += 1
    got = {r["vec_id"]: r["kept"] for r in QUERIES["c10_token_selection"](spark, str(tmp_path)).collect()}
    assert got == want


def test_cleaned_output_keeps_texts_with_fences(spark, tmp_path):
    from corpusloom.plans.registry import QUERIES

    rows = [(0, "plain\nmore"), (1, "```sql\n\n hello\nthere```"), (2, "```")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["line"] for r in QUERIES["f22_cleaned_output"](spark, str(tmp_path)).collect()}
    assert got == {0: "plain", 1: "hello", 2: ""}
