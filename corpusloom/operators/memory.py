"""Mutation memory: fingerprints of known texts, duplicate checks, few-shot picks, checkpoints."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import fingerprint, uniform

FORMAT_VERSION = 1
#: A row of a checkpoint holds about so many bytes of texts, and a task deals with so many.
PART_BYTES, TASK_BYTES = 1 << 20, 16 << 20
SPLIT_KEYS = 100_000


def known_fingerprints(*tables: DataFrame, text: str) -> DataFrame:
    """Distinct fingerprints of all tables, whatever their category."""
    out = None
    for t in tables:
        one = t.select(fingerprint(F.col(text)).alias("fingerprint"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def new_rows(candidates: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Candidates whose fingerprint isn't known."""
    return candidates.withColumn("fingerprint", fingerprint(F.col(text))).join(known, "fingerprint", "left_anti")


def first_of_each(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each fingerprint: a partial aggregate, no window over hot groups."""
    row = F.struct(*df.columns)
    return df.groupBy(fingerprint(F.col(text)).alias("fingerprint")).agg(F.min_by(row, F.col(order)).alias("row"), F.count("*").alias("copies")).select("fingerprint", "copies", "row.*")


def few_shot(mutated: DataFrame, source: DataFrame, category: str, k: int, seed: int, *key: str) -> DataFrame:
    """k examples of each category: mutated ones first, source ones for the rest."""
    both = mutated.withColumn("priority", F.lit(0)).unionByName(source.withColumn("priority", F.lit(1)))
    w = Window.partitionBy(category).orderBy("priority", "u", *key)
    return both.withColumn("u", uniform(seed, *[F.col(c) for c in key])).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def few_shot_text(picked: DataFrame, category: str, text: str) -> DataFrame:
    """(category, prompt): numbered examples in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", text)))
    return picked.groupBy(category).agg(rows.alias("rows")).select(category, F.array_join(F.transform("rows", lambda r: F.concat(r["rank"].cast("string"), F.lit(". "), r[text])), "\n").alias("prompt"))


def stats(df: DataFrame, category: str, text: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("templates"), F.count_distinct(fingerprint(F.col(text))).alias("fingerprints"))


def checkpoint_rows(df: DataFrame, category: str, text: str, taxonomy_version: int) -> DataFrame:
    """Rows of a category, in order of ``part`` and ``piece``: versions, sorted fingerprints and their texts in order.

    A part is a range of fingerprints with about PART_BYTES of texts (copies and null texts too): a small
    category is one row, and no row grows with the table. Of a fingerprint with more than that, the copies
    are dealt over pieces, and the first piece has the fingerprint. df is read four times, thrice for sizes.
    """
    size = F.sum((F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long"))  # and what an array takes for an element
    total = df.agg(size).first()[0] or 0
    # at most SPLIT_KEYS categories and fingerprints are larger than this, so lists of them can be broadcast
    most = max(PART_BYTES, -(-total // SPLIT_KEYS))
    large = lambda *keys: F.broadcast(df.groupBy(*keys).agg(F.ceil(size / most).cast("long").alias("__n")).where("__n > 1"))
    parts = large(F.col(category).alias("__c")).withColumnRenamed("__n", "__parts")
    pieces = large(F.col(category).alias("__h"), fingerprint(F.col(text)).alias("__hot")).withColumnRenamed("__n", "__pieces")
    # the leading 32 bits of a fingerprint tell its range; null texts are in the first
    bits = F.coalesce(F.conv(F.substring("__fp", 1, 8), 16, 10).cast("long"), F.lit(0))
    part = F.shiftright(bits * F.coalesce("__parts", F.lit(1)), 32)
    piece = F.pmod(F.monotonically_increasing_id(), F.coalesce("__pieces", F.lit(1)))
    dealt = (
        df.select(category, text, fingerprint(F.col(text)).alias("__fp"))
        .join(parts, F.col(category).eqNullSafe(F.col("__c")), "left")
        .join(pieces, F.col(category).eqNullSafe(F.col("__h")) & F.col("__fp").eqNullSafe(F.col("__hot")), "left")
        .select(category, text, "__fp", part.alias("part"), piece.alias("piece"))
        .repartition(max(1, -(-total // TASK_BYTES)), category, "part", "piece")
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(text).alias("t")))), lambda r: r["t"])  # a list of plain texts would lack the null ones
    prints = F.array_sort(F.collect_set("__fp"))
    return dealt.groupBy(category, "part", "piece").agg(texts.alias("templates"), prints.alias("fingerprints")).withColumns({"format_version": F.lit(FORMAT_VERSION), "taxonomy_version": F.lit(taxonomy_version)})


def digests(rows: DataFrame, category: str) -> DataFrame:
    """checkpoint_rows -> (category, n texts, digest): the MD5 of a category's sorted fingerprints joined by commas, null if it has none.

    An MD5 is a chain, so the fingerprints of a category (never its texts) stream through one task, which
    holds one Arrow batch.
    """

    def chained(batches):
        now, n, md5, last = None, 0, None, None

        def told():
            return pa.RecordBatch.from_pydict({"category": [now], "n": [n], "digest": [md5.hexdigest() if last else None]}, schema=pa.schema([("category", pa.string()), ("n", pa.int64()), ("digest", pa.string())]))

        for batch in batches:
            for c, k, fp in zip(*(x.to_pylist() for x in batch.columns)):
                if md5 is None or c != now:
                    if md5 is not None:
                        yield told()
                    now, n, md5, last = c, 0, hashlib.md5(), None
                n += k
                if fp not in (None, last):  # the pieces of a part repeat one
                    md5.update(f",{fp}".encode() if last else fp.encode())
                    last = fp
        if md5 is not None:
            yield told()

    one = rows.select(F.col(category).cast("string").alias("category"), F.size("templates").cast("long").alias("k"), F.posexplode_outer("fingerprints").alias("at", "fp"))
    each = one.select("category", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("k")).otherwise(0).alias("k"), "fp")
    return each.repartition("category").sortWithinPartitions("category", "fp").mapInArrow(chained, "category string, n long, digest string").withColumnRenamed("category", category)


def save(df: DataFrame, path: str, category: str) -> None:
    df.write.mode("overwrite").partitionBy(category).parquet(path)


def restore(spark: SparkSession, path: str, taxonomy_version: int) -> DataFrame:
    """The rows of a checkpoint; another format or taxonomy version raises."""
    df = spark.read.parquet(path)
    odd = df.where((F.col("format_version") != FORMAT_VERSION) | (F.col("taxonomy_version") != taxonomy_version)).select("format_version", "taxonomy_version").limit(1).collect()
    if odd:
        raise ValueError(f"checkpoint versions {tuple(odd[0])} aren't {(FORMAT_VERSION, taxonomy_version)}")
    return df


def recorded(memory: DataFrame, accepted: DataFrame) -> DataFrame:
    """Memory with accepted rows that it doesn't have."""
    return memory.unionByName(accepted.join(memory.select("fingerprint").distinct(), "fingerprint", "left_anti"))


def judged(candidates: DataFrame, known: DataFrame, old: str, new: str, technique: str, scope: str) -> DataFrame:
    """Candidates with fingerprint, reason (of the first failed check, or null) and status: failed, duplicate or success.

    A duplicate has a known fingerprint or that of an earlier candidate (the smallest old text) that passes.
    """
    rows = candidates.withColumns({"fingerprint": fingerprint(F.col(new)), "reason": X.rejection(F.col(old), F.col(new), F.col(technique), F.col(scope))})
    seen = known.select("fingerprint", F.lit(True).alias("__seen")).distinct()
    first = rows.where("reason IS NULL").groupBy("fingerprint").agg(F.min(old).alias("__first"))
    joined = rows.join(seen, "fingerprint", "left").join(first, "fingerprint", "left")
    status = F.when(F.col("reason").isNotNull(), "failed").when(F.col("__seen") | (F.col(old) > F.col("__first")), "duplicate").otherwise("success")
    return joined.withColumn("status", status).drop("__seen", "__first")


def mutated(templates: DataFrame, known: DataFrame, generate, schema: str, old: str, new: str, technique: str, scope: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Templates through a generator (it adds ``new``), its output cleaned, checked and held against what is known."""
    made = generated(templates, generate, schema)
    return judged(made.withColumn(new, X.cleaned_output(F.col(new), prefixes)), known, old, new, technique, scope)


def generated(df: DataFrame, generate, schema: str) -> DataFrame:
    """Rows through a caller's generator over Arrow batches: the place for a model, none is built in."""
    return df.mapInArrow(generate, schema)


def routed(scope: Column, seed: int, *key: Column, share: float = 0.3) -> Column:
    """Prompt kind by scope; of tsr rows about ``share`` are structure-focused."""
    return F.when(scope == "tsr", F.when(uniform(seed, *key) < share, "sql_structure").otherwise("attack_form")).when(scope == "scr", "system_context").otherwise("attack_form")
