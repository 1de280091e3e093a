"""Queries of the operators over the standard tables; names begin with the inventory ids that they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as X
from ..operators import contracts, control, memory, metrics, reporting, sampling, sft, taxonomy, telemetry, templates
from .registry import Tables, query

SEED = 42


def rounded(c: Column | str, places: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def r9(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Predictions: a truth from labels and a toy answer from the text's length.
P = """p AS (SELECT d.doc_id, d.lang AS cluster, d.source, d.n_chars, d.text, CASE WHEN toxic = 1 THEN 'malicious' ELSE 'benign' END AS ground_truth,
CASE WHEN d.n_chars % 7 = 0 THEN 'unknown' WHEN d.n_chars % 3 = 0 THEN 'malicious' ELSE 'benign' END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def predictions(t: Tables) -> DataFrame:
    answer = F.when(F.col("n_chars") % 7 == 0, "unknown").when(F.col("n_chars") % 3 == 0, "malicious").otherwise("benign")
    docs = t.documents.select("doc_id", F.col("lang").alias("cluster"), "source", "n_chars")
    return t.labels.join(docs, "doc_id").select("doc_id", "cluster", "source", "n_chars", F.when(F.col("toxic") == 1, "malicious").otherwise("benign").alias("ground_truth"), answer.alias("predicted"))


COUNTS = "count(*) AS total, count(*) FILTER (ground_truth='malicious' AND predicted='malicious') AS tp, count(*) FILTER (ground_truth='malicious' AND predicted<>'malicious') AS fn, count(*) FILTER (ground_truth='benign' AND predicted='benign') AS tn, count(*) FILTER (ground_truth='benign' AND predicted<>'benign') AS fp, count(*) FILTER (predicted NOT IN ('malicious','benign')) AS invalid"


def z(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


RATES = f"""a AS (SELECT *, tp + fn AS support_malicious, tn + fp AS support_benign, {z('tp+tn', 'total')} AS accuracy, {z('tp', 'tp+fp')} AS precision, {z('tp', 'tp+fn')} AS recall, {z('tn', 'tn+fp')} AS specificity, {z('fp', 'fp+tn')} AS fpr, {z('fn', 'fn+tp')} AS fnr,
{z('tp::DOUBLE*tn-fp::DOUBLE*fn', 'sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn))')} AS mcc, {z('total-invalid', 'total')} AS validity_rate FROM c),
b AS (SELECT *, {z('2*precision*recall', 'precision+recall')} AS f1, (recall+specificity)/2 AS balanced_accuracy FROM a)"""
RATE_NAMES = ("accuracy", "precision", "recall", "specificity", "f1", "fpr", "fnr", "balanced_accuracy", "mcc", "validity_rate")
RATE_COLS = "total, tp, fn, tn, fp, invalid, support_malicious, support_benign, " + ", ".join(f"round({n}, 9) AS {n}" for n in RATE_NAMES)


@query("a4_a5_a7_classification_metrics", f"WITH {P}, c AS (SELECT {COUNTS} FROM p), {RATES} SELECT {RATE_COLS} FROM b")
def classification_metrics(t):
    return r9(metrics.classification_metrics(predictions(t), "ground_truth", "predicted"), *RATE_NAMES)


@query("a6_metrics_rollup", f"WITH {P}, c AS (SELECT CASE WHEN grouping(cluster) = 1 THEN '__all__' ELSE cluster END AS cluster, {COUNTS} FROM p GROUP BY GROUPING SETS ((cluster), ())), {RATES} SELECT cluster, {RATE_COLS} FROM b")
def metrics_rollup(t):
    return r9(metrics.classification_metrics(predictions(t), "ground_truth", "predicted", "cluster", "__all__"), *RATE_NAMES)


@query("a1_a3_cluster_stats", f"WITH {P} SELECT cluster, count(*) AS total, count(*) FILTER (ground_truth = predicted) AS correct, count(*) FILTER (ground_truth='malicious' AND predicted='benign') AS fn, count(*) FILTER (ground_truth='benign' AND predicted='malicious') AS fp, round(count(*) FILTER (ground_truth = predicted)::DOUBLE / count(*), 9) AS accuracy FROM p GROUP BY cluster")
def cluster_stats(t):
    return r9(metrics.cluster_stats(predictions(t), "cluster", "ground_truth", "predicted"), "accuracy")


@query("a8_duplicate_counts", "SELECT source, count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY source")
def duplicate_counts(t):
    return metrics.duplicates(t.documents, "text", "source")


@query("a9_generation_accounting", "SELECT source, count(*) AS attempts, count(*) FILTER (n_chars > 500) AS generated, count(*) FILTER (NOT n_chars > 500) AS failures, greatest(0, count(*) - count(*) FILTER (n_chars > 500)) AS retries, count(*) FILTER (n_chars > 500) - count(DISTINCT CASE WHEN n_chars > 500 THEN text END) AS duplicates FROM documents GROUP BY source")
def generation_accounting(t):
    return metrics.generation_accounting(t.documents.withColumn("ok", F.col("n_chars") > 500), "source", "ok", "text")


@query("a17_a18_outcome_stats", "SELECT lang, count(*) AS attempts, count(*) FILTER (n_chars % 3 = 0) AS success, count(*) FILTER (n_chars % 3 = 1) AS failed, count(*) FILTER (n_chars % 3 = 2) AS duplicates, round(count(*) FILTER (n_chars % 3 = 0)::DOUBLE / count(*), 9) AS success_rate FROM documents GROUP BY lang")
def outcome_stats(t):
    status = F.when(F.col("n_chars") % 3 == 0, "success").when(F.col("n_chars") % 3 == 1, "failed").otherwise("duplicate")
    return r9(metrics.outcome_stats(t.documents.withColumn("status", status), "lang", "status"), "success_rate")


@query("a10_a12_length_stats", "WITH d AS (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n FROM documents) SELECT count(n) AS n, min(n) AS min_len, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, max(n) AS max_len, round(avg(n), 9) AS mean_len, count(*) FILTER (n > 2048) AS over_2048, count(*) FILTER (n > 4300) AS over_4300, count(*) FILTER (n > 4300) AS truncated FROM d")
def length_stats(t):
    words = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    return r9(metrics.length_stats(t.documents.select(words.alias("n")), "n"), "mean_len")


@query("a11_a15_percentiles", "SELECT event_type, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.95), 6) AS value_p95, max(value) AS value_max FROM events GROUP BY event_type")
def percentiles(t):
    return t.events.groupBy("event_type").agg(*telemetry.summary("value")).withColumns({c: rounded(c, 6) for c in ("value_mean", "value_p50", "value_p95")})


@query("w4_a13_energy_trapezoid", "WITH x AS (SELECT user_id, (value + lag(value) OVER w) / 2 * ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6) AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(coalesce(sum(e), 0) / 3600, 6) AS wh FROM x GROUP BY user_id")
def energy(t):
    return telemetry.energy(t.events, ["user_id"], "ts", "event_id", "value").withColumn("wh", rounded("wh", 6))


STAGES = "s AS (SELECT event_id, ts, user_id % 10 AS round, 'u' || (user_id % 3) AS stage, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' ELSE event_type END AS event, value FROM events)"
PAIRS = f"""{STAGES}, seg AS (SELECT *, coalesce(sum(CASE WHEN event = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY round, stage ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM s WHERE event IN ('started', 'completed')),
whole AS (SELECT round, stage, segment, max(ts) FILTER (event = 'started') AS started, max(ts) FILTER (event = 'completed') AS completed FROM seg GROUP BY ALL),
pairs AS (SELECT round, stage, started, completed FROM whole WHERE started IS NOT NULL AND completed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY round, stage ORDER BY segment DESC) = 1)"""


def stage_events(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    return t.events.select("event_id", "ts", (F.col("user_id") % 10).alias("round"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("stage"), kind.alias("event"), "value")


def pairs(t: Tables) -> DataFrame:
    return telemetry.paired_stages(stage_events(t), ["round", "stage"], "ts", "event", "event_id")


@query("t2_j10_stage_pairing", f"WITH {PAIRS} SELECT round, stage, epoch_us(started) AS started, epoch_us(completed) AS completed FROM pairs")
def stage_pairing(t):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return pairs(t).select("round", "stage", micros("started"), micros("completed"))


@query("t4_wall_times", f"WITH {PAIRS} SELECT round, count(*) AS n, round(sum((epoch_us(completed) - epoch_us(started)) / 1e6), 3) AS seconds FROM pairs GROUP BY round")
def wall_times(t):
    return telemetry.wall_times(pairs(t), "round", "stage", "started", "completed").select("round", F.size("stages").cast("long").alias("n"), F.round(F.aggregate(F.map_values("stages"), F.lit(0.0), lambda a, x: a + x), 3).alias("seconds"))


@query("j7_a14_t3_resource_slices", f"""WITH {PAIRS}, x AS (SELECT stage, value, user_id, event_id, ts FROM pairs JOIN events ON ts BETWEEN started AND completed UNION ALL SELECT '__all__', value, user_id, event_id, ts FROM events),
e AS (SELECT stage, (value + lag(value) OVER w) / 2 * ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6) AS e FROM x WINDOW w AS (PARTITION BY stage, user_id ORDER BY ts, event_id)), wh AS (SELECT stage, round(coalesce(sum(e), 0) / 3600, 3) AS energy_wh FROM e GROUP BY stage)
SELECT stage, count(*) AS n, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.95), 6) AS value_p95, max(value) AS value_max, max(event_id) AS peak, any_value(energy_wh) AS energy_wh FROM x JOIN wh USING (stage) GROUP BY stage""")
def resource_slices(t):
    out = telemetry.resource_slices(t.events.select("ts", "value", "user_id", "event_id"), pairs(t), "stage", ["value"], "ts", "started", "completed", device="user_id", power="value", order="event_id", peak="event_id")
    return out.withColumns({c: rounded(c, 6) for c in ("value_mean", "value_p50", "value_p95")}).withColumn("energy_wh", rounded("energy_wh", 3))


def U(seed: int, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)"


# Event types as arms: errors missed are large values.
ARMS = """ev AS (SELECT event_type AS cluster, count(*) AS total, count(*) FILTER (value > 60) AS fn FROM events GROUP BY 1),
arms AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS ordinal FROM ev),
rw AS (SELECT cluster, (fn + 1.0::DOUBLE) / (total + 2.0::DOUBLE) AS reward FROM ev),
wt AS (SELECT cluster, exp(0.3::DOUBLE * (reward - avg(reward) OVER ())) AS weight FROM rw),
pr AS (SELECT cluster, 0.3::DOUBLE * pow(weight, 2) / sum(pow(weight, 2)) OVER () + 0.7::DOUBLE / count(*) OVER () AS m FROM wt),
dist AS (SELECT cluster, ordinal, m / sum(m) OVER () AS probability FROM pr JOIN arms USING (cluster))"""


def arm_stats(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("cluster")).agg(F.count("*").alias("total"), F.count_if(F.col("value") > 60).alias("fn"))


def event_arms(t: Tables) -> DataFrame:
    return arm_stats(t).select("cluster", (F.row_number().over(control.all_rows().orderBy("cluster")) - 1).alias("ordinal"))


def event_weights(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "cluster string, weight double")
    return control.centered_weights(control.smoothed_rewards(arm_stats(t), event_arms(t)), none)


def distribution(t: Tables) -> DataFrame:
    return control.sampling_distribution(event_weights(t), event_arms(t), 0.7, 2.0)


@query("l1_smoothed_rewards", f"WITH {ARMS} SELECT cluster, round(reward, 9) AS reward FROM rw")
def smoothed_rewards(t):
    return r9(control.smoothed_rewards(arm_stats(t), event_arms(t)), "reward")


@query("l2_w1_w2_j13_centered_weights", f"WITH {ARMS} SELECT cluster, round(weight, 9) AS weight FROM wt")
def centered_weights(t):
    return r9(event_weights(t), "weight")


@query("l4_w3_sampling_distribution", f"WITH {ARMS} SELECT cluster, ordinal, round(probability, 9) AS probability FROM dist")
def sampling_distribution(t):
    return longs(r9(distribution(t), "probability"), "ordinal")


@query("w10_mutation_probability", f"WITH {ARMS} SELECT cluster, round(least(0.8::DOUBLE, greatest(0.25 * 0.5::DOUBLE, 0.25::DOUBLE * weight / avg(weight) OVER ())), 9) AS p FROM wt")
def mutation_probability(t):
    return event_weights(t).select("cluster", rounded(control.mutation_probability(0.25, F.col("weight"), 0.5, 0.8)).alias("p"))


@query("c1_top_clusters", f"WITH {ARMS} SELECT cluster FROM dist ORDER BY probability DESC, ordinal LIMIT 3")
def top_clusters(t):
    return sampling.top_k(distribution(t), 3, "probability", "ordinal").select("cluster")


@query("c2_weighted_clusters", f"WITH {ARMS} SELECT cluster FROM dist ORDER BY -ln({U(SEED, 'cluster')}) / probability LIMIT 3")
def weighted_clusters(t):
    return sampling.weighted_without_replacement(distribution(t), 3, "probability", SEED, "cluster").select("cluster")


@query("c3_c11_uniform_sample", f"SELECT doc_id FROM documents ORDER BY {U(SEED, 'doc_id')}, doc_id LIMIT 100")
def uniform_sample(t):
    return sampling.uniform_sample(t.documents.select("doc_id"), 100, SEED, "doc_id").select("doc_id")


@query("c4_with_replacement", f"WITH n AS (SELECT r_regionkey, row_number() OVER (ORDER BY {U(SEED, 'r_regionkey')}, r_regionkey) - 1 AS i FROM region) SELECT slot, r_regionkey::BIGINT AS region FROM (SELECT s AS slot, floor({U(SEED, 's')} * (SELECT count(*) FROM region))::BIGINT AS i FROM range(20) t(s)) JOIN n USING (i)")
def with_replacement(t):
    return sampling.with_replacement(t.region, 20, SEED, "r_regionkey").select("slot", F.col("r_regionkey").cast("long").alias("region"))


@query("c5_mixed_sources", f"WITH u AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {U(SEED, 'doc_id')}, doc_id) AS k FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')) SELECT doc_id, source FROM u WHERE k <= CASE source WHEN 'src0' THEN 18 WHEN 'src1' THEN 6 WHEN 'src2' THEN 7 ELSE 6 END")
def mixed_sources(t):
    return sampling.mixed_sources(t.documents.select("doc_id", "source"), 37, "source", "src0", ["src1", "src2", "src3"], SEED, "doc_id", offset=1).select("doc_id", "source")


@query("c6_budget_split", "SELECT n_nationkey::BIGINT AS nation, round_even(n_nationkey * 0.5, 0)::BIGINT AS budget FROM nation")
def budget_split(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("nation"), F.bround(F.col("n_nationkey") * F.lit(0.5)).cast("long").alias("budget"))


@query("c7_w9_one_per_group", f"SELECT source, arg_min(doc_id, {U(SEED, 'doc_id')}) AS doc_id FROM documents GROUP BY source")
def one_per_group(t):
    return sampling.one_per_group(t.documents.select("source", "doc_id"), "source", SEED, "doc_id").select("source", "doc_id")


@query("c8_bernoulli", f"SELECT lang, count(*) FILTER ({U(SEED, 'doc_id')} < 0.2) AS hits FROM documents GROUP BY lang")
def bernoulli(t):
    return t.documents.groupBy("lang").agg(F.count_if(sampling.bernoulli(0.2, SEED, F.col("doc_id"))).alias("hits"))


@query("c9_stratified_quota", f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {U(SEED, 'doc_id')}, doc_id) <= 20")
def stratified_quota(t):
    return sampling.per_group(t.documents.select("doc_id", "lang"), "lang", 20, SEED, "doc_id").select("doc_id", "lang")


@query("c10_token_selection", f"WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS pos FROM embeddings), k AS (SELECT vec_id, pos FROM x ORDER BY {U(SEED, 'vec_id || chr(58) || pos')}, vec_id, pos LIMIT (SELECT floor(count(*) * 0.3)::BIGINT FROM x)) SELECT e.vec_id, count(k.pos) AS kept FROM embeddings e LEFT JOIN k USING (vec_id) GROUP BY 1")
def token_selection(t):
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda x, i: i).alias("labels"))
    out = sampling.token_selection(rows, "labels", "vec_id", 0.3, SEED)
    return out.select("vec_id", F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("kept"))


@query("c12_few_shot", f"SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, {U(SEED, 'doc_id')}, doc_id) <= 5")
def few_shot(t):
    docs = t.documents.select("doc_id", "lang", "source")
    return memory.few_shot(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "lang", 5, SEED, "doc_id").select("lang", "doc_id")


@query("c14_s3_first_lines", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def first_lines(t):
    from ..sources.io import first_lines

    return first_lines(t.documents.select("doc_id"), "doc_id", 50)


@query("w7_round_robin", "SELECT n_nationkey::BIGINT AS i, (38 // 25 + CASE WHEN ((n_nationkey - 2) % 25 + 25) % 25 < 38 % 25 THEN 1 ELSE 0 END)::BIGINT AS quota FROM nation")
def round_robin(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("i"), sampling.round_robin_quota(38, 25, F.col("n_nationkey"), 2).cast("long").alias("quota"))


@query("w8_cyclic_allocation", "SELECT n_nationkey::BIGINT AS i, greatest(0, ceil((61 - n_nationkey) / 25.0))::BIGINT AS quota FROM nation")
def cyclic_allocation(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("i"), sampling.cyclic_allocation(61, 25, F.col("n_nationkey")).alias("quota"))


@query("w8_first_successes", "SELECT event_id FROM events WHERE value > 100 ORDER BY event_id, user_id LIMIT 40")
def first_successes(t):
    return sampling.first_successes(t.events.withColumn("ok", F.col("value") > 100), 40, "event_id", "user_id", "ok").select("event_id")


@query("w6_gamma_schedule", "SELECT r AS round, round(0.7::DOUBLE + (0.2::DOUBLE - 0.7) / 7 * (r - 1), 9) AS gamma FROM range(1, 9) t(r)")
def gamma_schedule(t):
    return r9(sampling.schedule(t.spark, 0.7, 0.2, 8), "gamma")


@query("w5_l3_benign_controller", """WITH RECURSIVE h AS (SELECT row_number() OVER (ORDER BY hr) AS i, e FROM (SELECT date_trunc('hour', ts) AS hr, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS e FROM events GROUP BY 1)),
f AS (SELECT 0::BIGINT AS i, 0.05::DOUBLE AS ema, 0.25::DOUBLE AS rho UNION ALL SELECT h.i, 0.7::DOUBLE * ema + (1 - 0.7::DOUBLE) * e, least(0.35::DOUBLE, greatest(0.15::DOUBLE, rho + 0.5::DOUBLE * ((0.7::DOUBLE * ema + (1 - 0.7::DOUBLE) * e) - 0.05::DOUBLE))) FROM f JOIN h ON h.i = f.i + 1)
SELECT round(ema, 9) AS ema, round(rho, 9) AS rho FROM f ORDER BY i DESC LIMIT 1""")
def benign_controller(t):
    hours = t.events.groupBy(F.date_trunc("hour", "ts").alias("round")).agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error"))
    return r9(control.benign_ratio_controller(hours, "round", "error", 0.25, 0.05, 0.7, 0.5, 0.05, 0.15, 0.35), "ema", "rho")


TAXONOMY = "ax AS (SELECT t.i * 9 + s.i * 3 + c.i AS ordinal, t.v AS technique, s.v AS reference_scope, c.v AS comment_state FROM (VALUES (0,'tautology'),(1,'union_query'),(2,'piggy_backed'),(3,'error_based'),(4,'boolean_blind'),(5,'time_blind')) t(i,v), (VALUES (0,'lor'),(1,'tsr'),(2,'scr')) s(i,v), (VALUES (0,'no_comment'),(1,'clean_comment'),(2,'cepp')) c(i,v) WHERE NOT (t.v IN ('boolean_blind','piggy_backed') AND s.v = 'lor'))"


@query("p8_p9_taxonomy_arms", f"WITH {TAXONOMY} SELECT ordinal::BIGINT AS ordinal, technique, reference_scope, comment_state, technique || '||' || reference_scope AS category, technique || '||' || reference_scope || '||' || comment_state AS cluster FROM ax")
def taxonomy_arms(t):
    return longs(taxonomy.arms(t.spark), "ordinal")


@query("p9_parsed_keys", f"WITH {TAXONOMY} SELECT technique, reference_scope, count(*) AS states FROM ax GROUP BY ALL")
def parsed_keys(t):
    return taxonomy.arms(t.spark).select(taxonomy.parsed_key(F.col("cluster")).alias("k")).groupBy("k.technique", "k.reference_scope").agg(F.count("*").alias("states"))


@query("p8_p10_cluster_key", "SELECT CASE WHEN toxic = 0 THEN 'benign' ELSE lang || '||' || source END AS cluster, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic <> 0 GROUP BY 1")
def cluster_keys(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").withColumn("cluster", taxonomy.cluster_key(F.col("toxic") == 0, F.col("lang"), F.col("source")))
    return taxonomy.without_benign(rows).groupBy("cluster").agg(F.count("*").alias("n"))


@query("j5_u2_v5_coverage", "WITH e AS (SELECT DISTINCT lang || '||' || s AS cluster FROM documents, (VALUES ('src0'), ('src1'), ('src99')) t(s)), o AS (SELECT DISTINCT lang || '||' || source AS cluster FROM documents) SELECT cluster, 'missing' AS status FROM e ANTI JOIN o USING (cluster) UNION ALL SELECT cluster, 'extra' FROM o ANTI JOIN e USING (cluster)")
def coverage(t):
    key = lambda s: F.concat_ws("||", "lang", s)
    expected = t.documents.select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, ("src0", "src1", "src99")))).alias("s")).select(key("s").alias("cluster"))
    return taxonomy.coverage(t.documents.select(key("source").alias("cluster")), expected)


FP = "md5(lower(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ')))"


@query("f1_fingerprint_dedup", f"SELECT {FP} AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def fingerprint_dedup(t):
    return memory.first_of_each(t.documents.select("doc_id", "text"), "text", "doc_id").select("fingerprint", "doc_id", "copies")


@query("j8_l8_new_documents", f"SELECT doc_id FROM documents WHERE {FP} NOT IN (SELECT {FP} FROM benchmark UNION SELECT {FP} FROM (SELECT html AS text FROM pages) UNION SELECT {FP} FROM conversations)")
def new_documents(t):
    known = memory.known_fingerprints(t.benchmark, t.pages.select(F.col("html").alias("text")), t.conversations, text="text")
    return memory.new_rows(t.documents.select("doc_id", "text"), known, "text").select("doc_id")


@query("u4_fingerprint_union", f"SELECT count(*) AS n FROM (SELECT {FP} FROM benchmark UNION SELECT {FP} FROM documents)")
def fingerprint_union(t):
    return memory.known_fingerprints(t.benchmark, t.documents, text="text").agg(F.count("*").alias("n"))


@query("a16_memory_stats", f"SELECT source, count(*) AS templates, count(DISTINCT {FP}) AS fingerprints FROM documents GROUP BY source")
def memory_stats(t):
    return memory.stats(t.documents, "source", "text")


@query("k7_v10_checkpoint_rows", f"SELECT lang, count(*) AS n, md5(string_agg(DISTINCT {FP}, ',' ORDER BY {FP})) AS digest FROM documents GROUP BY lang")
def checkpoint_rows(t):
    rows = memory.checkpoint_rows(t.documents.select("lang", "text"), "lang", "text", taxonomy.VERSION)
    return memory.digests(rows, "lang")


# Placeholder texts made of words of the documents; no template is built in.
TPL = "tpl AS (SELECT doc_id, 'x $table_1$ = $column_t1_' || (doc_id % 3) || '$ ' || CASE doc_id % 4 WHEN 0 THEN '$int$' WHEN 1 THEN '$sample_t2_1$' WHEN 2 THEN '$date$' ELSE '$other$' END || ' (' || CASE WHEN doc_id % 5 = 0 THEN ')' ELSE '' END AS payload FROM documents)"


def toy_templates(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    last = F.when(d % 4 == 0, "$int$").when(d % 4 == 1, "$sample_t2_1$").when(d % 4 == 2, "$date$").otherwise("$other$")
    return t.documents.select("doc_id", F.concat(F.lit("x $table_1$ = $column_t1_"), (d % 3).cast("string"), F.lit("$ "), last, F.lit(" ("), F.when(d % 5 == 0, ")").otherwise("")).alias("payload"))


@query("f5_f6_placeholders", f"WITH {TPL}, x AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS name FROM (SELECT doc_id, regexp_extract_all(payload, '\\$(\\w+)\\$', 1) AS p FROM tpl)) SELECT doc_id, pos, name, CASE WHEN regexp_matches(name, '^table_\\d+') THEN 'table' WHEN regexp_matches(name, '^column_t\\d+_\\d+') THEN 'column' WHEN regexp_matches(name, '^sample_t\\d+_\\d+') THEN 'sample' ELSE name END AS kind, try_cast(nullif(regexp_extract(name, '^(?:table_|column_t|sample_t)(\\d+)', 1), '') AS BIGINT) AS table_id, try_cast(nullif(regexp_extract(name, '^(?:column|sample)_t\\d+_(\\d+)', 1), '') AS BIGINT) AS column_id FROM x")
def placeholders(t):
    return longs(templates.spots(toy_templates(t), "doc_id", "payload"), "pos", "table_id", "column_id")


@query("f3_scope_counts", f"WITH {TPL} SELECT CASE WHEN regexp_matches(payload, '\\$(?:table_\\d+|column_t\\d+_\\d+|sample_t\\d+_\\d+)\\$') THEN 'tsr' ELSE 'lor' END AS scope, count(*) AS n FROM (SELECT payload FROM tpl UNION ALL SELECT text FROM documents) GROUP BY 1")
def scope_counts(t):
    both = toy_templates(t).select("payload").unionByName(t.documents.select(F.col("text").alias("payload")))
    return both.groupBy(X.scope(F.col("payload")).alias("scope")).agg(F.count("*").alias("n"))


CASCADE = "CASE WHEN regexp_matches(u, ';\\s*(SELECT|DELETE|INSERT|UPDATE|DROP|TRUNCATE|CREATE)\\b') THEN 'piggy_backed' WHEN regexp_matches(u, '(SLEEP|BENCHMARK)\\s*\\(') THEN 'time_blind' WHEN regexp_matches(u, '\\b(UNION|ORDER\\s+BY\\s+\\d|GROUP\\s+BY\\s+\\d)') THEN 'union_query' WHEN regexp_matches(u, '(CAST|CONVERT|SQRT|LOG\\d*|MOD|EXTRACTVALUE|UPDATEXML|GTID_SUBSET|GTID_SUBTRACT)\\s*\\(') THEN 'error_based' WHEN contains(u, 'AND') AND regexp_matches(u, 'SUBSTR|ASCII|ORD|LENGTH') THEN 'boolean_blind' WHEN regexp_matches(u, '''\\s+(OR|AND)\\s+') THEN 'tautology' ELSE 'unknown' END"


@query("f2_f4_technique_cascade", f"WITH x AS (SELECT doc_id, upper(text) AS u FROM documents) SELECT doc_id, {CASCADE} AS technique FROM x")
def technique_cascade(t):
    return t.documents.select("doc_id", X.technique(F.col("text")).alias("technique"))


@query("f2_page_techniques", f"WITH x AS (SELECT page_id, upper(html) AS u FROM pages) SELECT {CASCADE} AS technique, count(*) AS n FROM x GROUP BY 1")
def page_techniques(t):
    return t.pages.groupBy(X.technique(F.col("html")).alias("technique")).agg(F.count("*").alias("n"))


@query("f26_p3_p4_text_predicates", "SELECT doc_id, len(regexp_extract_all(text, '\\(')) = len(regexp_extract_all(text, '\\)')) AS even, (regexp_matches(text, '\\S') AND NOT regexp_matches(text, '[\\n\\r#]|--')) AS safe, contains(text, '--') OR contains(text, '#') AS marked FROM documents")
def text_predicates(t):
    x = F.col("text")
    return t.documents.select("doc_id", X.parens_even(x).alias("even"), X.single_line_safe(x).alias("safe"), X.has_comment_marker(x).alias("marked"))


@query("f17_balanced_symbols", """WITH RECURSIVE s AS (SELECT page_id, 0 AS i, '' AS stack, '' AS quote, FALSE AS hidden, 0 AS bad FROM pages UNION ALL
SELECT page_id, i + 1, CASE WHEN NOT hidden AND quote = '' AND c IN ('(','[','{') THEN stack || c WHEN NOT hidden AND quote = '' AND c IN (')',']','}') AND right(stack, 1) = translate(c, ')]}', '([{') THEN left(stack, length(stack) - 1) ELSE stack END,
CASE WHEN NOT hidden AND c IN ('''', '"', '`') AND quote = '' THEN c WHEN NOT hidden AND c = quote THEN '' ELSE quote END, c = '\\',
CASE WHEN bad = 0 AND NOT hidden AND quote = '' AND c IN (')',']','}') AND right(stack, 1) <> translate(c, ')]}', '([{') THEN i + 1 ELSE bad END
FROM (SELECT s.*, substr(html, i + 1, 1) AS c FROM s JOIN pages USING (page_id) WHERE i < length(html)))
SELECT page_id, bad = 0 AND stack = '' AND quote = '' AS balanced FROM s JOIN pages USING (page_id) WHERE i = length(html)""")
def balanced_symbols(t):
    return t.pages.select("page_id", X.balance(F.col("html"))["balanced"].alias("balanced"))


@query("f30_f31_answers", "WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS x FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN contains(lower(x), 'not malicious') OR contains(lower(x), 'is benign') THEN 'benign' WHEN contains(lower(x), 'malicious') THEN 'malicious' WHEN contains(lower(x), 'benign') THEN 'benign' ELSE regexp_extract(x, '^(\\S*)', 1) END AS answer FROM c")
def answers(t):
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", X.answer(F.col("text")).alias("answer"))


CHAT = "m AS (SELECT conv_id, list(role ORDER BY turn) AS roles, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat, count(*) AS turns, arg_min(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY 1)"


@query("f35_f36_p17_chat", f"WITH {CHAT} SELECT conv_id, turns, md5(chat) AS chat, roles[1:3] = ['system', 'user', 'assistant'] AS well_formed, lower(trim(coalesce(answer, ''), ' ' || chr(9) || chr(10) || chr(13))) AS truth FROM m")
def chat(t):
    rows = sft.conversations(t.conversations, "conv_id", "turn", "role", "text")
    m = F.col("messages")
    return rows.select("conv_id", F.size(m).cast("long").alias("turns"), F.md5(sft.rendered_chat(m).cast("binary")).alias("chat"), sft.well_formed(m).alias("well_formed"), X.ground_truth(m).alias("truth"))


@query("f34_f35_sft_records", "SELECT doc_id, 'SQL:' || chr(10) || source AS prompt, CASE WHEN toxic = 0 THEN 'benign' ELSE 'malicious' END AS answer, CASE WHEN toxic <> 0 THEN lang END AS lang, CASE WHEN toxic <> 0 THEN 'medium' END AS difficulty FROM labels JOIN documents USING (doc_id)")
def sft_records(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select(F.col("source").alias("sql"), (F.col("toxic") == 0).alias("label"), "lang", "doc_id", F.lit(None).cast("string").alias("difficulty"))
    out = sft.sft_records(rows.withColumn("sql", F.concat_ws("\u0001", "sql", F.col("doc_id").cast("string"))), "Tell.", "sql_only", "sql", "label", ["lang"])
    said = F.col("messages")[1]["content"]
    return out.select(F.substring_index("sql", "\u0001", -1).cast("long").alias("doc_id"), F.substring_index(said, "\u0001", 1).alias("prompt"), F.col("messages")[2]["content"].alias("answer"), "lang", "difficulty")


@query("f37_p12_a19_masking", "SELECT (2 * count(*))::BIGINT AS examples, (2 * sum(greatest(0, len(embedding) - 1 - vec_id % 5)))::BIGINT AS supervised_tokens, round(2 * count(*) / 4.0, 9)::DOUBLE AS examples_per_second, round(2 * sum(greatest(0, len(embedding) - 1 - vec_id % 5)) / 4.0, 9)::DOUBLE AS tokens_per_second FROM embeddings")
def masking(t):
    ids = F.transform("embedding", lambda x, i: i)
    prompt = F.slice(ids, F.lit(1), (1 + F.col("vec_id") % 5).cast("int"))
    rows = sft.supervised(t.embeddings.select(sft.masked_prompt(ids, prompt).alias("labels")), "labels")
    return r9(longs(metrics.throughput(rows, "labels", 2, 4.0), "examples", "supervised_tokens"), "examples_per_second", "tokens_per_second")


@query("f38_joined_completion", "SELECT n_name || ' ' || 'done.' || '</s>' AS text FROM nation")
def joined_completion(t):
    return t.nation.select(sft.joined_completion(F.col("n_name"), F.lit("done."), "</s>").alias("text"))


DDL_TYPE = "CASE WHEN contains(lower(ty), 'text') OR contains(lower(ty), 'char') OR contains(lower(ty), 'string') THEN 'VARCHAR' WHEN contains(lower(ty), 'int') THEN 'INTEGER' WHEN contains(lower(ty), 'real') OR contains(lower(ty), 'float') THEN 'REAL' WHEN contains(lower(ty), 'double') THEN 'DOUBLE' WHEN contains(lower(ty), 'decimal') THEN 'DECIMAL' WHEN contains(lower(ty), 'date') THEN 'DATE' WHEN contains(lower(ty), 'timestamp') THEN 'TIMESTAMP' ELSE upper(ty) END"
TYPES = ("varchar(255)", "int", "bigint", "double", "date", "datetime", "timestamp", "time", "text", "decimal(9,2)", "interval", "float")


@query("f32_ddl_types", f"SELECT ty AS declared, {DDL_TYPE} AS name FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in TYPES)}) v(ty)")
def ddl_types(t):
    rows = t.spark.range(1).select(F.explode(F.array(*map(F.lit, TYPES))).alias("declared"))
    return rows.select("declared", X.ddl_type(F.col("declared")).alias("name"))


@query("j1_j2_f33_schema_prompt", "SELECT r_name AS db, md5('-- Database: ' || r_name || chr(10) || chr(10) || string_agg('CREATE TABLE `' || n_name || '` (' || chr(10) || '    key INTEGER,' || chr(10) || '    `n name` VARCHAR' || chr(10) || ');' || chr(10), chr(10) ORDER BY n_nationkey)) AS ddl FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def schema_prompt(t):
    cols = F.array(F.struct(F.lit("key").alias("column_name"), F.lit("int").alias("data_type")), F.struct(F.lit("n name").alias("column_name"), F.lit("varchar(25)").alias("data_type")))
    tables = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("table_name"), cols.alias("columns")))).alias("tables"))
    schemas = tables.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("db"), "tables", F.lit(0).alias("ordinal"))
    found = sft.with_schema(t.region.select(F.col("r_name").alias("db")), schemas, "db", "ordinal", required=True)
    return found.select("db", F.md5(sft.ddl(F.col("db"), F.col("tables")).cast("binary")).alias("ddl"))


@query("f13_sql_literals", "SELECT c_custkey, '''' || replace(c_name, '''', '''''') || '''' AS name, c_nationkey::VARCHAR AS nation FROM customer")
def sql_literals(t):
    return t.customer.select("c_custkey", X.sql_literal(F.col("c_name"), F.lit("varchar")).alias("name"), X.sql_literal(F.col("c_nationkey").cast("string"), F.lit("varchar(25)")).alias("nation"))


@query("f15_f16_markers", "SELECT n_nationkey::BIGINT AS k, 'name = ''' || n_name || ' or' AS in_string, 'key = 1' AS in_number, 'key = ' AS head FROM nation")
def markers(t):
    carrier = F.lit("name = '$$")
    quoted = X.marker_inserted(F.lit("name = $$'"), F.concat(F.lit("'"), F.col("n_name"), F.lit(" or")))
    bare = X.marker_inserted(F.lit("key = $$"), F.lit("'1"))
    return t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.substring_index(quoted, "'", 2).alias("in_string"), bare.alias("in_number"), X.before_comment(F.concat(F.lit("key = -- "), carrier), F.lit("-- ")).alias("head"))


@query("p5_comment_states", "SELECT state, code, count(*) AS n FROM (SELECT state, CASE WHEN state = 'no_comment' AND req THEN 'no_comment_needs_no_delimiter' WHEN state <> 'no_comment' AND NOT req THEN 'delimiter_required' WHEN state = 'cepp' THEN 'note_missing' END AS code FROM (SELECT o_orderkey % 2 = 0 AS req, CASE o_orderkey % 3 WHEN 0 THEN 'no_comment' WHEN 1 THEN 'clean_comment' ELSE 'cepp' END AS state FROM orders)) GROUP BY ALL")
def comment_states(t):
    k = F.col("o_orderkey")
    state = F.when(k % 3 == 0, "no_comment").when(k % 3 == 1, "clean_comment").otherwise("cepp")
    payload = F.when(k % 3 == 0, "1").otherwise("1-- ")
    code = X.comment_state_violation(state, k % 2 == 0, F.lit("1"), payload, F.lit(""), F.lit("-- "))
    return t.orders.select(state.alias("state"), code.alias("code")).groupBy("state", "code").agg(F.count("*").alias("n"))


@query("p7_difficulty", f"WITH {TAXONOMY} SELECT cluster, CASE WHEN s = 'lor' THEN 'simple' WHEN s = 'scr' THEN 'medium' WHEN c = 'cepp' THEN 'hard' ELSE 'medium' END AS difficulty FROM (SELECT technique || '||' || reference_scope || '||' || comment_state AS cluster, reference_scope AS s, comment_state AS c FROM ax)")
def difficulty(t):
    return taxonomy.arms(t.spark).select("cluster", X.difficulty(F.col("reference_scope"), F.col("comment_state")).alias("difficulty"))


@query("f9_f10_constraints", f"WITH {TPL}, x AS (SELECT doc_id, (doc_id % 3)::BIGINT AS column_id, CASE WHEN doc_id % 2 = 0 THEN 'number' ELSE 'all' END AS expected FROM tpl UNION ALL SELECT doc_id, 1, 'string' FROM tpl WHERE doc_id % 4 = 1) SELECT doc_id, CASE WHEN n = 2 THEN 2 ELSE 1 END::BIGINT AS table_id, column_id, expected FROM (SELECT doc_id, column_id, expected, 1 AS n FROM (SELECT doc_id, column_id, CASE WHEN doc_id % 2 = 0 THEN 'number' ELSE 'all' END AS expected FROM x WHERE expected <> 'string') UNION ALL SELECT doc_id, column_id, expected, 2 FROM x WHERE expected = 'string')")
def constraints(t):
    d = F.col("doc_id")
    typed = toy_templates(t).withColumn("types", F.array(F.lit("all"), F.when(d % 2 == 0, "number").otherwise("all"), F.lit("string")))
    return longs(templates.merged_constraints(templates.spots(typed, "doc_id", "payload", "types"), "doc_id"), "table_id", "column_id")


@query("f7_f14_filled_templates", f"WITH {TPL} SELECT doc_id, 'x T = C' || (doc_id % 3) || ' ' || CASE doc_id % 4 WHEN 0 THEN '7' WHEN 1 THEN '$sample_t2_1$' WHEN 2 THEN '7' ELSE '7' END || ' (' || CASE WHEN doc_id % 5 = 0 THEN ')' ELSE '' END AS filled FROM tpl")
def filled_templates(t):
    rows = toy_templates(t)
    spots = templates.spots(rows, "doc_id", "payload")
    value = F.when(F.col("kind") == "table", "T").when(F.col("kind") == "column", F.concat(F.lit("C"), F.col("column_id").cast("string"))).when(F.col("kind") != "sample", "7")
    return templates.filled_templates(rows, spots.select("doc_id", "pos", value.alias("value")), "doc_id", "payload").select("doc_id", "filled")


ASSIGNED = f"""WITH c AS (SELECT * FROM (VALUES ('shop', 'part', 'p_name', 'varchar(55)', FALSE), ('shop', 'part', 'p_size', 'int', TRUE), ('shop', 'orders', 'o_total', 'double', TRUE), ('world', 'nation', 'n_name', 'text', FALSE), ('world', 'region', 'r_key', 'bigint', TRUE), ('world', 'region', 'r_name', 'nchar(9)', FALSE)) v(db, tab, col, kind, number)),
w AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'shop' ELSE 'world' END AS db, 1 AS id, doc_id % 3 AS column_id, doc_id % 2 = 0 AS number FROM documents UNION ALL SELECT doc_id, 'world', 2, 1, FALSE FROM documents WHERE doc_id % 4 = 1),
one AS (SELECT doc_id, arg_min(tab, {U(SEED, "doc_id || ':1:' || tab")}) AS tab FROM (SELECT DISTINCT doc_id, tab FROM w JOIN c ON c.db = w.db AND c.number = w.number WHERE id = 1) GROUP BY doc_id),
two AS (SELECT doc_id, arg_min(tab, {U(SEED, "doc_id || ':2:' || tab")}) AS tab FROM (SELECT DISTINCT w.doc_id, c.tab FROM w JOIN c ON c.db = w.db AND NOT c.number JOIN one f ON f.doc_id = w.doc_id AND f.tab <> c.tab WHERE id = 2) GROUP BY doc_id),
chosen AS (SELECT doc_id, 1 AS id, tab FROM one UNION ALL SELECT doc_id, 2, tab FROM two),
each AS (SELECT doc_id, w.db, id, column_id, tab, col, kind, CASE WHEN c.number = w.number THEN 0 ELSE 10 END + {U(SEED, "doc_id || ':' || id || ':' || column_id || ':' || col")} AS u FROM w JOIN chosen USING (doc_id, id) JOIN c USING (tab))
SELECT doc_id, db, id::BIGINT AS table_id, column_id::BIGINT AS column_id, tab AS table_name, arg_min(col, u) AS column_name, arg_min(kind, u) AS column_type FROM each GROUP BY ALL"""


@query("f11_f12_c13_assigned_columns", ASSIGNED)
def assigned_columns(t):
    """Templates' columns against the columns of the tables of two small databases."""
    d = F.col("doc_id")
    typed = toy_templates(t).withColumn("types", F.array(F.lit("all"), F.when(d % 2 == 0, "number").otherwise("string"), F.lit("string")))
    db = F.when(d % 2 == 0, "shop").otherwise("world")
    spots = templates.spots(typed, "doc_id", "payload", "types")
    want = templates.merged_constraints(spots, "doc_id").withColumn("db", db)
    rows = [("shop", "part", "p_name", "varchar(55)"), ("shop", "part", "p_size", "int"), ("shop", "orders", "o_total", "double"), ("world", "nation", "n_name", "text"), ("world", "region", "r_key", "bigint"), ("world", "region", "r_name", "nchar(9)")]
    cols = t.spark.createDataFrame(rows, "db string, table_name string, column_name string, column_type string")
    tables = templates.assigned_tables(spots.where("table_id IS NOT NULL").withColumn("db", db), want, cols, "doc_id", "db", SEED)
    return longs(templates.assigned_columns(want, tables, cols, "doc_id", "db", SEED), "table_id", "column_id")


FIXED_TEXT = "a $int$ b $time$ $hex$ $float$ $date$ $character$ $int$"


def scalar(kind: str, pos: int) -> str:
    """The SQL of a random scalar at a place of a document's template."""
    u = lambda what: U(SEED, f"'{what}:' || doc_id || ':{pos}'")
    return {
        "int": f"floor({u('int')} * 101)::BIGINT::VARCHAR",
        "time": f"printf('%02d:%02d:%02d', floor({u('hour')} * 24)::BIGINT, floor({u('minute')} * 60)::BIGINT, floor({u('second')} * 60)::BIGINT)",
        "hex": f"'0x' || lower(hex(floor({u('hex')} * 65536)::BIGINT))",
        "float": f"printf('%.2f', round({u('float')} * 10, 2))",
        "date": f"strftime(DATE '2000-01-01' + floor({u('date')} * 9497)::INTEGER, '%Y-%m-%d')",
        "character": f"chr(97 + floor({u('char')} * 26)::INTEGER)",
    }[kind]


@query("f7_f18_fixed_values", f"SELECT doc_id, 'a ' || {scalar('int', 0)} || ' b ' || {scalar('time', 1)} || ' ' || {scalar('hex', 2)} || ' ' || {scalar('float', 3)} || ' ' || {scalar('date', 4)} || ' ' || {scalar('character', 5)} || ' ' || {scalar('int', 6)} AS filled FROM documents")
def fixed_values(t):
    """Scope tsr: every occurrence drawn on its own, nothing quoted."""
    rows = t.documents.select("doc_id", F.lit(FIXED_TEXT).alias("payload"))
    spots = templates.spots(rows, "doc_id", "payload")
    value = templates.fixed_value(F.col("kind"), hashing.random_scalars(SEED, F.col("doc_id"), F.col("pos")), F.lit(False))
    return templates.filled_templates(rows, spots.select("doc_id", "pos", value.alias("value")), "doc_id", "payload").select("doc_id", "filled")


@query("f8_system_filled", f"""WITH pool AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' ELSE 'other' END AS kind, n_name || '()' AS v, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '12.5' WHEN 2 THEN n_name END AS s FROM nation UNION ALL SELECT 'all', n_name || '()', CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '12.5' WHEN 2 THEN n_name END FROM nation),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY kind) AS c FROM pool),
w AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 2 THEN 'all' ELSE CASE pos WHEN 1 THEN CASE doc_id % 3 WHEN 0 THEN 'string' ELSE 'odd' END ELSE CASE doc_id % 3 WHEN 0 THEN 'integer' ELSE 'string' END END END AS kind FROM documents, (VALUES (1), (2)) p(pos)),
d AS (SELECT doc_id, pos, coalesce(v, '1') AS v, s FROM w LEFT JOIN n ON n.kind = w.kind AND i = floor({U(SEED, "doc_id || ':' || pos")} * c)::BIGINT)
SELECT doc_id, {scalar('int', 0)} || ' = ' || a.v || ' or ' || b.v || ' = ' || CASE WHEN coalesce(b.s, '') = '' THEN '0' WHEN b.s = '12.5' THEN b.s ELSE chr(39) || b.s || chr(39) END || ' ' || chr(39) || {scalar('time', 4)} || chr(39) || ' $odd$' AS filled FROM (SELECT * FROM d WHERE pos = 1) a JOIN (SELECT * FROM d WHERE pos = 2) b USING (doc_id)""")
def system_filled(t):
    d, n = F.col("doc_id"), F.col("n_nationkey")
    types = F.when(d % 3 == 0, F.array(*map(F.lit, ("integer", "string", "integer")))).when(d % 3 == 1, F.array(*map(F.lit, ("x", "odd", "string")))).otherwise(F.array(F.lit("all")))
    rows = t.documents.select("doc_id", F.lit("$int$ = $sysInfo$ or $sysInfo$ = $sample$ $time$ $odd$").alias("payload"), types.alias("types"))
    sample = F.when(n % 4 == 0, "").when(n % 4 == 1, "12.5").when(n % 4 == 2, F.col("n_name"))
    own = t.nation.select(F.when(n % 3 == 0, "string").when(n % 3 == 1, "integer").otherwise("other").alias("type"), F.concat("n_name", F.lit("()")).alias("variable"), sample.alias("sample"))
    return templates.system_filled(rows, own.unionByName(own.withColumn("type", F.lit("all"))), "doc_id", "payload", "types", SEED).select("doc_id", "filled")


@query("f18_random_scalars", f"SELECT doc_id, strftime(DATE '2000-01-01' + floor({U(SEED, chr(39) + 'date:' + chr(39) + ' || doc_id')} * 9497)::INTEGER, '%Y-%m-%d') AS d, floor({U(SEED, chr(39) + 'int:' + chr(39) + ' || doc_id')} * 101)::BIGINT::VARCHAR AS i FROM documents")
def random_scalars(t):
    s = hashing.random_scalars(SEED, F.col("doc_id"))
    return t.documents.select("doc_id", s["date"].alias("d"), s["int"].alias("i"))


STOP = ("THE", "OF", "AND", "TO")


@query("f19_contextual_sentence", "SELECT doc_id, 'Validate the requested ' || coalesce(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'), lambda x: upper(x) NOT IN ('THE', 'OF', 'AND', 'TO'))[-1] || ' operation', 'condition') || ' for the current query.' AS sentence FROM documents")
def contextual_sentence(t):
    return t.documents.select("doc_id", X.contextual_sentence(F.col("text"), F.lit("tautology"), STOP).alias("sentence"))


@query("f22_cleaned_output", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(regexp_replace(text, '```\\w*', '', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')[1], '') AS line FROM documents")
def cleaned_output(t):
    return t.documents.select("doc_id", X.cleaned_output(F.col("text"), ("Output:", "Answer:")).alias("line"))


@query("f23_f24_f25_f27_rejections", f"WITH {TPL} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'empty' WHEN doc_id % 7 = 1 THEN 'placeholder' WHEN doc_id % 5 <> 0 THEN 'paren' END AS code FROM tpl")
def rejections(t):
    d = F.col("doc_id")
    new = F.when(d % 7 == 0, " ").when(d % 7 == 1, "nothing here").otherwise(F.col("payload"))
    return toy_templates(t).select("doc_id", X.rejection(F.col("payload"), new, F.lit("tautology"), F.lit("tsr")).alias("code"))


@query("f28_f29_type_lists", "SELECT n_nationkey::BIGINT AS k, 'string,all,number' AS types, 'all,all' AS none FROM nation")
def type_lists(t):
    some = X.type_list(F.concat(F.lit("Types: [\"String\", \"odd\", \"number\"] of "), F.col("n_name")), F.lit(3))
    return t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.array_join(some, ",").alias("types"), F.array_join(X.type_list(F.col("n_name"), F.lit(2)), ",").alias("none"))


SENTENCE = "'Validate the requested ' || coalesce(replace(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*'), lambda x: upper(x) NOT IN ('THE', 'OF', 'AND', 'TO'))[-1], '_', ' ') || ' operation', 'condition') || ' for the current query.'"


def comment_sql(model: bool) -> str:
    rational = f"CASE WHEN doc_id % 5 = 0 THEN 'fine note' ELSE {SENTENCE} END" if model else SENTENCE
    name = "CASE doc_id % 5 WHEN 3 THEN 'rational_fallback_exception_Timeout' WHEN 0 THEN 'rational_explanation' ELSE 'rational_fallback_invalid_response' END" if model else "'rational_template_explanation'"
    return f"""WITH pool AS (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'Irrelevant Text' ELSE 'Authoritative' END AS kind, r_name AS c FROM region), n AS (SELECT *, row_number() OVER (ORDER BY kind, c) - 1 AS i FROM pool)
SELECT doc_id, CASE WHEN {U(SEED, 'doc_id')} < 0.5 THEN {rational} ELSE c END AS comment, CASE WHEN {U(SEED, 'doc_id')} < 0.5 THEN {name} ELSE CASE WHEN kind = 'Authoritative' THEN 'local_authoritative' ELSE 'local_irrelevant_text' END END AS strategy
FROM documents JOIN n ON i = floor({U(SEED, "'comment:' || doc_id")} * (SELECT count(*) FROM pool))::BIGINT"""


def comments(t, model: bool):
    d = F.col("doc_id")
    rows = t.documents.select("doc_id", "text", F.lit("tautology").alias("technique"), F.when(d % 5 == 0, " fine note ").when(d % 5 == 1, "bad -- note").alias("said"), F.when(d % 5 == 3, "Timeout").alias("error"))
    pool = t.region.select(F.when(F.col("r_regionkey") % 2 == 0, "Irrelevant Text").otherwise("Authoritative").alias("type"), F.explode(F.array(F.concat(F.lit(" "), "r_name"), F.concat("r_name", F.lit(" # unsafe")))).alias("comment"))
    out = templates.with_comment(rows, pool, "doc_id", "text", "technique", "said", "error", model, SEED, 0.5, STOP)
    return out.select("doc_id", "comment", F.col("comment_strategy").alias("strategy"))


@query("f20_model_comments", comment_sql(True))
def model_comments(t):
    return comments(t, True)


@query("f20_local_comments", comment_sql(False))
def template_comments(t):
    return comments(t, False)


@query("f41_routing", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN {U(SEED, 'doc_id')} < 0.3 THEN 'sql_structure' ELSE 'attack_form' END WHEN 1 THEN 'system_context' ELSE 'attack_form' END AS kind FROM documents")
def routing(t):
    d = F.col("doc_id")
    return t.documents.select("doc_id", memory.routed(F.when(d % 3 == 0, "tsr").when(d % 3 == 1, "scr").otherwise("lor"), SEED, d).alias("kind"))


@query("f42_few_shot_text", "WITH x AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) SELECT lang, string_agg(k || '. ' || doc_id, chr(10) ORDER BY k) AS prompt FROM x WHERE k <= 3 GROUP BY lang")
def few_shot_text(t):
    w = sampling.Window.partitionBy("lang").orderBy("doc_id")
    picked = t.documents.select("lang", F.col("doc_id").cast("string").alias("text"), F.row_number().over(w).alias("rank")).where("rank <= 3")
    return memory.few_shot_text(picked, "lang", "text")


@query("f43_f44_rendered", "SELECT n_nationkey::BIGINT AS k, 'Of ' || n_name || ' say ' || n_nationkey || '.' AS text FROM nation")
def rendered(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("k"), X.rendered("Of {{ name }} say {{key}}.", {"name": F.col("n_name"), "key": F.col("n_nationkey")}).alias("text"))


@query("f39_f40_patterns", "SELECT n_nationkey::BIGINT AS k, regexp_matches(n_name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS run_id, FALSE AS sha, (n_nationkey * 1024.0)::DOUBLE AS bytes FROM nation")
def patterns(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("k"), X.run_id_valid(F.col("n_name")).alias("run_id"), X.sha256_valid(F.col("n_name")).alias("sha"), X.byte_size(F.concat(F.col("n_nationkey").cast("string"), F.lit("K"))).alias("bytes"))


@query("a21_rollup_index", "SELECT coalesce(p_brand, 'all') AS kind, count(*) AS n FROM part GROUP BY ROLLUP (p_brand)")
def rollup_index(t):
    return t.part.rollup("p_brand").agg(F.count("*").alias("n")).select(F.coalesce("p_brand", F.lit("all")).alias("kind"), "n")


@query("a22_canonical_sha256", "SELECT n_nationkey::BIGINT AS k, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"none\":null}') AS sha FROM nation")
def canonical_sha256(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("k"), hashing.canonical_json_sha256({"name": F.col("n_name"), "key": F.col("n_nationkey"), "none": F.lit(None).cast("string")}).alias("sha"))


@query("a23_quota_violations", "SELECT 'quota' AS rule, o_orderpriority AS subject, '3000' AS expected, count(*)::VARCHAR AS observed FROM orders GROUP BY 2 HAVING count(*) <> 3000")
def quota_violations(t):
    return contracts.quota_violations(t.orders, "o_orderpriority", 3000)


@query("v1_j12_count_mismatches", "WITH a AS (SELECT l_returnflag AS split, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT o_orderstatus AS split, count(*) AS n FROM orders GROUP BY 1) SELECT 'count' AS rule, split AS subject, d.n::VARCHAR AS expected, a.n::VARCHAR AS observed FROM a FULL JOIN d USING (split) WHERE a.n IS DISTINCT FROM d.n")
def count_mismatches(t):
    a = t.lineitem.groupBy(F.col("l_returnflag").alias("split")).agg(F.count("*").alias("n"))
    d = t.orders.groupBy(F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("n"))
    return contracts.count_mismatches(a, d, "split", "n", "count")


@query("v3_j6_a24_selection", """WITH r AS (SELECT l.doc_id AS o, n_chars::BIGINT AS p, toxic = 0 AS label, quality::VARCHAR AS cluster, lang AS sha FROM labels l JOIN documents USING (doc_id)), par AS (SELECT doc_id AS p, lang AS sha, doc_id % 2 = 0 AS label, (doc_id % 3)::VARCHAR AS cluster FROM documents)
SELECT 'unique' AS rule, p::VARCHAR AS subject, '1' AS expected, count(*)::VARCHAR AS observed FROM r GROUP BY p HAVING count(*) > 1
UNION ALL SELECT 'quota', cluster, '50', count(*)::VARCHAR FROM r WHERE NOT label GROUP BY cluster HAVING count(*) <> 50
UNION ALL SELECT 'parent_sha256', r.p::VARCHAR, r.sha, par.sha FROM r LEFT JOIN par ON par.p = r.p WHERE par.sha IS DISTINCT FROM r.sha
UNION ALL SELECT 'parent_label', r.p::VARCHAR, r.label::VARCHAR, par.label::VARCHAR FROM r LEFT JOIN par ON par.p = r.p WHERE par.label IS DISTINCT FROM r.label
UNION ALL SELECT 'parent_cluster', r.p::VARCHAR, r.cluster, par.cluster FROM r LEFT JOIN par ON par.p = r.p WHERE par.cluster IS DISTINCT FROM r.cluster""")
def selection(t):
    """A record names its document's number of characters as its parent: some of these documents are there, some are named twice."""
    d = F.col("doc_id")
    rows = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(d.alias("output_index"), F.col("n_chars").cast("long").alias("parent_index"), F.col("lang").alias("record_sha256"), (F.col("toxic") == 0).alias("label"), F.col("quality").cast("string").alias("cluster"))
    outputs = rows.select(F.col("output_index").alias("index"), F.col("record_sha256").alias("sha256"), "label", "cluster")
    parents = t.documents.select(d.alias("index"), F.col("lang").alias("sha256"), (d % 2 == 0).alias("label"), (d % 3).cast("string").alias("cluster"))
    return contracts.selection_violations(rows, outputs, parents, 50)


@query("v4_split_specs", "SELECT * FROM (VALUES ('train', 2560::BIGINT, 653::BIGINT), ('validation', 1920, 40), ('test', 3200, 873)) v(split, attack_count, benign_count)")
def split_specs(t):
    return contracts.split_specs(t.spark)


@query("j3_j4_template_carriers", f"WITH {TAXONOMY} SELECT comment_state, count(*) AS n FROM ax JOIN (SELECT n_nationkey % 2 = 0 AS req FROM nation) ON req = (comment_state <> 'no_comment') GROUP BY 1")
def template_carriers(t):
    carriers = t.nation.select((F.col("n_nationkey") % 2 == 0).alias("req"))
    arms = taxonomy.arms(t.spark)
    return arms.join(carriers, (F.col("comment_state") != "no_comment").eqNullSafe(F.col("req"))).groupBy("comment_state").agg(F.count("*").alias("n"))


@query("j9_positional_types", f"WITH {TPL}, x AS (SELECT doc_id, regexp_extract_all(payload, '\\$(\\w+)\\$', 1) AS p FROM tpl) SELECT doc_id, CASE WHEN p[3] IN ('int', 'date') THEN 'a,b' ELSE 'a,b,all' END AS types FROM x")
def positional_types(t):
    types = X.aligned_types(F.array(F.lit("a"), F.lit("b")), X.placeholders(F.col("payload")), templates.FIXED)
    return toy_templates(t).select("doc_id", F.array_join(types, ",").alias("types"))


@query("p1_p2_p6_projection", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND (o_custkey % 2 = 0) IS NOT DISTINCT FROM TRUE")
def projection(t):
    from ..sources.io import without_private

    flag = (F.col("o_custkey") % 2 == 0).eqNullSafe(F.lit(True))
    return without_private(t.orders.where((F.col("o_orderstatus") == "F") & flag).select("o_orderkey", "o_orderstatus", F.lit(1).alias("_debug")))


@query("p11_s6_sample_values", "SELECT \"column\", count(*) AS n FROM (UNPIVOT (SELECT c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100) ON c_name, c_mktsegment INTO NAME \"column\" VALUE v) WHERE v <> '' GROUP BY 1")
def sampled_values(t):
    from ..sources.io import sample_values

    return sample_values(t.customer.orderBy("c_custkey").select("c_name", "c_mktsegment"), 100).groupBy("column").agg(F.count("*").alias("n"))


@query("p13_local_comments", "SELECT doc_id, trim(text) AS comment FROM documents WHERE lang IN ('en', 'de') AND regexp_matches(text, '\\S') AND NOT regexp_matches(text, '[\\n\\r#]|--')")
def local_comments(t):
    x = F.col("text")
    return t.documents.where(F.col("lang").isin("en", "de") & X.single_line_safe(x)).select("doc_id", F.trim(x).alias("comment"))


@query("p15_p16_numbered", "SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, doc_id, source FROM documents")
def numbered(t):
    return t.documents.select((F.row_number().over(sampling.Window.partitionBy("lang").orderBy("doc_id")) - 1).cast("long").alias("i"), "doc_id", "source")


ROUNDS = "r AS (SELECT (user_id % 4)::BIGINT AS round, avg(value) AS acc, max(value) AS secs FROM events GROUP BY 1)"


def rounds_table(t: Tables) -> DataFrame:
    base = t.events.groupBy((F.col("user_id") % 4).alias("round")).agg(F.avg("value").alias("acc"), F.max("value").alias("secs"))
    one = lambda name, c: base.select("round", F.create_map(F.lit(name), F.col(c)).alias("m"))
    parts = [one(n, c).withColumnRenamed("m", b) for b, n, c in (("test", "accuracy", "acc"), ("stages", "fine_tune_seconds", "secs"), ("training", "training_examples", "secs"), ("validation", "f1", "acc"), ("timing", "inference_seconds", "secs"))]
    return reporting.joined_rounds(base.select("round", F.col("secs").alias("round_duration_seconds"), F.lit(1).alias("artifact_size_bytes")), *parts)


@query("p14_j11_k4_flat_rounds", f"WITH {ROUNDS} SELECT round, round(acc, 9) AS test_accuracy, secs AS fine_tune_seconds, secs AS inference_seconds, round(acc, 9) AS validation_f1, NULL::DOUBLE AS test_mcc FROM r")
def flat_rounds(t):
    flat = reporting.flat_rounds(rounds_table(t))
    return r9(flat, "test_accuracy", "validation_f1").select("round", "test_accuracy", "fine_tune_seconds", "inference_seconds", "validation_f1", "test_mcc")


@query("k5_markdown", f"WITH {ROUNDS} SELECT '| round | test_accuracy | test_mcc |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || round || ' | ' || printf('%.4f', acc) || ' | - |', chr(10) ORDER BY round) AS report FROM r")
def markdown(t):
    return reporting.markdown(reporting.flat_rounds(rounds_table(t)), ["test_accuracy", "test_mcc"])


@query("k6_final_block", f"WITH {ROUNDS} SELECT round(arg_max(acc, round), 6) AS accuracy FROM r")
def final_block(t):
    out = reporting.final_block(rounds_table(t), "test")
    return out.select(F.round(F.get_json_object("final_test", "$.accuracy").cast("double"), 6).alias("accuracy"))


@query("u1_union", "SELECT source, count(*) AS n, count(item_id) AS items FROM (SELECT doc_id, source, NULL AS item_id FROM documents UNION ALL SELECT NULL, 'benchmark', item_id FROM benchmark) GROUP BY source")
def union(t):
    both = t.documents.select("doc_id", "source").unionByName(t.benchmark.select("item_id", F.lit("benchmark").alias("source")), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("item_id").alias("items"))


@query("a20_rates", "SELECT event_type, round(count(*) / 60.0, 9)::DOUBLE AS per_second, round(60000.0 / count(*), 9)::DOUBLE AS ms_each FROM events GROUP BY 1")
def rates(t):
    n = F.count("*")
    return t.events.groupBy("event_type").agg(rounded(metrics.ratio(n, F.lit(60.0))).alias("per_second"), rounded(metrics.ratio(F.lit(60000.0), n)).alias("ms_each"))


@query("s2_s12_parsed_lines", "SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_valid(props) GROUP BY 1")
def parsed_lines(t):
    from ..sources.io import parsed_lines

    good, _ = parsed_lines(t.events, "props", "k long")
    return good.groupBy("k").agg(F.count("*").alias("n"))


@query("p1_training_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def training_rows(t):
    from ..sources.io import training_rows

    return training_rows(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("set")), value="O").select("o_orderkey")


@query("f8_pooled_values", f"WITH w AS (SELECT doc_id, p AS pos, CASE WHEN doc_id % 3 = 0 THEN 'odd' WHEN doc_id % 3 = 1 THEN 'even' ELSE 'all' END AS kind FROM documents, range(2) r(p)), pool AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, n_name AS v FROM nation UNION ALL SELECT 'all', n_name FROM nation), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY kind) AS c FROM pool) SELECT doc_id, pos::BIGINT AS pos, w.kind, v AS value FROM w JOIN n ON n.kind = w.kind AND i = floor({U(SEED, 'doc_id || chr(58) || pos')} * c)")
def pooled_values(t):
    d = F.col("doc_id")
    wanted = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("pos"), F.when(d % 3 == 0, "odd").when(d % 3 == 1, "even").otherwise("all").alias("kind"))
    pool = t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("kind"), F.col("n_name").alias("value"))
    return longs(templates.pooled_values(wanted, pool, "doc_id", "pos", "kind", "value", SEED), "pos")


@query("f12_resolved_names", "SELECT n_nationkey::BIGINT AS k, n_name AS alone, r_name || '.' || n_name AS full_name, CASE WHEN contains(r_name, ' ') THEN '`' || r_name || '`' ELSE r_name END AS column_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def resolved_names(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    table = lambda scope: templates.table_text(F.col("r_name"), F.col("n_name"), F.lit(scope))
    return rows.select(F.col("n_nationkey").cast("long").alias("k"), table("tsr").alias("alone"), table("lor").alias("full_name"), templates.column_text(F.col("r_name")).alias("column_name"))


@query("l9_judged_candidates", f"WITH {TPL} SELECT CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 5 <> 0 THEN 'failed' WHEN doc_id % 7 = 1 THEN 'duplicate' ELSE 'new' END AS status, count(*) AS n FROM tpl GROUP BY 1")
def judged_candidates(t):
    d = F.col("doc_id")
    new = F.when(d % 7 == 0, " ").when(d % 7 == 1, F.col("payload")).otherwise(F.concat("payload", F.lit(" "), d.cast("string")))
    rows = toy_templates(t).withColumns({"new": new, "technique": F.lit("tautology"), "scope": F.lit("tsr")})
    known = memory.known_fingerprints(toy_templates(t), text="payload")
    out = memory.judged(rows, known, "payload", "new", "technique", "scope")
    return out.groupBy(F.when(F.col("status") == "success", "new").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("j6_positional_records", "SELECT a.doc_id AS output_id, b.doc_id AS parent_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, lang FROM documents) a JOIN (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS i, lang FROM documents) b USING (lang, i)")
def positional_records(t):
    at = lambda *o: F.row_number().over(sampling.Window.partitionBy("lang").orderBy(*o)).alias("i")
    a = t.documents.select("lang", F.col("doc_id").alias("output_id"), at("doc_id"))
    b = t.documents.select("lang", F.col("doc_id").alias("parent_id"), at(F.desc("doc_id")))
    return a.join(b, ["lang", "i"]).select("output_id", "parent_id")


@query("u3_set_equality", "SELECT TRUE AS same, FALSE AS other")
def set_equality(t):
    keys = t.nation.select("n_regionkey").distinct()
    regions = t.region.select(F.col("r_regionkey").alias("n_regionkey"))
    return t.spark.range(1).select(F.lit(contracts.same_set(keys, regions)).alias("same"), F.lit(contracts.same_set(keys, regions.where("n_regionkey > 0"))).alias("other"))


@query("v9_restored_weights", f"WITH {ARMS} SELECT cluster, round(weight, 9) AS weight FROM wt")
def restored_weights(t):
    return r9(contracts.restored_weights(event_weights(t), event_arms(t)), "weight")


@query("a2_category_counts", f"WITH {TAXONOMY} SELECT technique || '||' || reference_scope AS category, count(*) AS n FROM ax GROUP BY 1")
def category_counts(t):
    return taxonomy.arms(t.spark).groupBy("category").agg(F.count("*").alias("n"))


ROUND = f"""WITH {TAXONOMY}, arm AS (SELECT technique || '||' || reference_scope || '||' || comment_state AS cluster, comment_state, ordinal FROM ax),
picked AS (SELECT cluster, comment_state, ordinal FROM arm ORDER BY -ln({U(SEED + 1, 'cluster')}) LIMIT 8), p AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS i FROM picked),
slots AS (SELECT s AS slot, cluster, comment_state FROM range(48) r(s) JOIN p ON i = s % 8), tries AS (SELECT * FROM slots, range(4) r(attempt)),
c AS (SELECT 'SELECT ' || n_name || ' WHERE k = ' AS sql, n_nationkey % 2 = 0 AS req FROM nation), cn AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY sql) - 1 AS i, count(*) OVER (PARTITION BY req) AS c FROM c),
nt AS (SELECT 'note on ' || r_name AS note, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region),
filled AS (SELECT slot, attempt, cluster, sql || ' value' || CASE comment_state WHEN 'no_comment' THEN '' WHEN 'clean_comment' THEN '-- ' ELSE '-- ' || note END AS sql
  FROM tries JOIN cn ON req = (comment_state <> 'no_comment') AND cn.i = floor({U(SEED, "'carrier:' || slot || ':' || attempt")} * c)::BIGINT JOIN nt ON nt.i = floor({U(SEED, "'note:' || slot || ':' || attempt")} * 5)::BIGINT),
best AS (SELECT slot, arg_min(cluster, u) AS cluster, arg_min(sql, u) AS sql FROM (SELECT *, {U(SEED, "slot || ':' || attempt")} AS u FROM filled) GROUP BY slot)
SELECT slot, cluster, sql, CASE WHEN contains(cluster, '||lor||') THEN 'simple' WHEN contains(cluster, '||scr||') THEN 'medium' WHEN contains(cluster, '||cepp') THEN 'hard' ELSE 'medium' END AS difficulty FROM best"""


@query("l5_l7_round", ROUND)
def one_round(t):
    """A round's samples over a toy pool."""
    from . import config, rounds

    arms = taxonomy.arms(t.spark)
    settings = config.settings(config_example())
    state = rounds.State.first(t.spark, arms, settings)
    pool = arms.select("technique", "reference_scope", F.lit("x value").alias("payload")).distinct()
    carriers = t.nation.select(F.concat(F.lit("SELECT "), "n_name", F.lit(" WHERE k = $$")).alias("sql"), F.lit("db").alias("db"), (F.col("n_nationkey") % 2 == 0).alias("requires_comment_delimiter"))
    notes = t.region.select(F.concat(F.lit("note on "), "r_name").alias("comment"))
    return rounds.synthesised(rounds.chosen_clusters(state, arms, settings, 1), arms, pool, carriers, notes, 48, SEED).select(F.col("slot").cast("long").alias("slot"), "cluster", "sql", "difficulty")


def config_example() -> dict:
    return {
        "schema_version": 2, "random_seed": 42, "prompt_mode": "query_only", "num_rounds": 8, "num_training_sqls": 300, "initial_benign_ratio": 0.25, "mix_benign_sources": True,
        "attacker": {"gamma_start": 0.7, "gamma_end": 0.2, "strategy": "by_probability", "clusters_per_round": 8, "weight_exponent": 2.0},
        "verifier": {"update": "centered_full_information_exponential", "learning_rate": 1.0},
        "payload_mutation": {"enabled": True, "probability_start": 0.1, "probability_end": 0.4, "model": None},
    }
