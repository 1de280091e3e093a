"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, language_id, line_dedup, sentencepiece_codec, sharding, simhash, token_output, url_filters


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that the number in its url's path names."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    number = F.regexp_extract(url_filters.path_of(F.col("url")), "^/[a-z]+/([0-9]+)", 1).try_cast("long")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", bad.alias("bad"))
    return url_filters.judge(pages, outcomes)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))).drop("text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_html, op3_exact_dedup, op4_token_output, op5_url_filters, op6_line_dedup, op7_sentencepiece, op8_language_id, op9_decontaminate, op10_sharding)
    return {f.__name__: f for f in found}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP5 = r"""
WITH seen AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS t(action, rhost, rpath)),
ruled AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT * FROM seen) s JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path),
known AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM seen JOIN labels ON doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) WHERE page_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY page_id),
named AS (
  SELECT *, regexp_replace(domain, '^[^.]*\.', '') AS sfx FROM (
    SELECT host, regexp_extract(regexp_replace(host, ':.*$', ''), '([^.]*\.)?[^.]*$') AS domain FROM (SELECT DISTINCT host FROM seen))),
by_host AS (
  SELECT host, domain, sfx, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad
  FROM (SELECT DISTINCT page_id, host FROM seen) s JOIN known USING (page_id) JOIN named USING (host) GROUP BY ALL),
by_domain AS (SELECT domain, sfx, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY ALL),
by_suffix AS (SELECT sfx, sum(n) AS n, sum(bad) AS bad FROM by_domain GROUP BY ALL),
units AS (SELECT 'h' AS lv, n, bad FROM by_host UNION ALL SELECT 'd', n, bad FROM by_domain UNION ALL SELECT 's', n, bad FROM by_suffix),
sums AS (SELECT lv, sum(n) AS N, sum(bad) AS B, count(*)::DOUBLE AS K, sum(n * n) AS Q, sum(bad * bad / n) AS R FROM units GROUP BY lv),
rho AS (
  SELECT lv, (B + 0.5::DOUBLE) / (N + 1) AS root, least(0.9999::DOUBLE, greatest(0.0001::DOUBLE, coalesce(((R - B * B / N) - (B / N) * (1 - B / N) * (K - 1)) / nullif((B / N) * (1 - B / N) * (N - Q / N - (K - 1)), 0), 0.0001::DOUBLE))) AS rho
  FROM sums),
ks AS (SELECT lv, root, (1 - rho) / rho AS k FROM rho),
k AS (SELECT max(k) FILTER (lv = 'h') AS kh, max(k) FILTER (lv = 'd') AS kd, max(k) FILTER (lv = 's') AS ks, max(root) FILTER (lv = 'h') AS root FROM ks),
shrunk AS (
  SELECT named.host, coalesce(h.n, 0) AS hn, coalesce(h.bad, 0) AS hb, coalesce(d.n, 0) AS dn, coalesce(d.bad, 0) AS db, (ks * root + coalesce(s.bad, 0)) / (ks + coalesce(s.n, 0)) AS ms, kh, kd, root
  FROM named LEFT JOIN by_host h USING (host) LEFT JOIN by_domain d ON d.domain = named.domain LEFT JOIN by_suffix s ON s.sfx = named.sfx CROSS JOIN k),
post AS (SELECT host, root, (kh * ((kd * ms + db) / (kd + dn)) + hb) / (kh + hn) AS mean, kh + hn AS total FROM shrunk)
SELECT seen.page_id, seen.host, seen.path, rule,
  coalesce(action, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) > least(1.5 * root, (1 + root) / 2) THEN 'block' ELSE 'allow' END) AS verdict
FROM seen JOIN post USING (host) LEFT JOIN ruled ON ruled.page_id IS NOT DISTINCT FROM seen.page_id AND ruled.host = seen.host AND ruled.path = seen.path
"""

OP6 = r"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, no, trim(regexp_replace(lower(raw), '[ \t\x0B\f\r]+', ' ', 'g')) AS x FROM split),
firsts AS (SELECT x, min((doc_id, no)) AS spot, length(x) AS n, regexp_replace(x, '[^0-9]+', '', 'g') AS digits FROM lines WHERE x <> '' GROUP BY x),
halves AS (
  SELECT x, spot, n, digits, k, side, CASE side WHEN 'l' THEN left(x, k // 2) ELSE right(x, k - k // 2) END AS half
  FROM (SELECT *, unnest([n, n - 1]) AS k FROM firsts), (VALUES ('l'), ('r')) s(side) WHERE k >= 16),
pairs AS (
  SELECT DISTINCT a.x AS x, b.x AS y, b.spot AS spot, a.n AS n, b.n AS m FROM halves a JOIN halves b ON a.k = b.k AND a.side = b.side AND a.half = b.half AND a.digits = b.digits AND a.spot < b.spot AND least(a.n, b.n) = a.k),
beginnings AS (
  SELECT *, coalesce(list_position(list_transform(list_zip(string_split(x, ''), string_split(y, '')), lambda z: z[1] IS DISTINCT FROM z[2]), true), least(n, m) + 1) - 1 AS p FROM pairs),
near AS (SELECT DISTINCT spot FROM beginnings WHERE substr(x, p + 1 + CASE WHEN n >= m THEN 1 ELSE 0 END) = substr(y, p + 1 + CASE WHEN m >= n THEN 1 ELSE 0 END)),
kept AS (SELECT spot FROM firsts WHERE spot NOT IN (SELECT spot FROM near)),
gone AS (SELECT doc_id, count(*) AS n_dropped, string_agg(no, ',' ORDER BY no) AS dropped FROM lines WHERE x <> '' AND (doc_id, no) NOT IN (SELECT spot FROM kept) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped FROM documents LEFT JOIN gone USING (doc_id)
"""

WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP9 = f"""
WITH items AS (SELECT DISTINCT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
spots AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (SELECT DISTINCT n FROM wins) WHERE i + n - 1 <= len(w)),
found AS (SELECT doc_id, i, n, item_id FROM spots JOIN wins USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op5_url_filters": OP5, "op6_line_dedup": OP6, "op9_decontaminate": OP9}
