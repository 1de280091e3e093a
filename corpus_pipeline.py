"""A training corpus in five stages; each takes (spark, docs, sf_dir) and works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, exact_dedup, language_id, sentencepiece_codec, simhash
from corpusloom.llm.common import drop_folder, fresh_name, new_path, work_tables
from corpusloom.llm.queries import vocabulary

#: The pieces' file; any SentencePiece BPE model without text normalisation will do.
MODEL = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, which fills in a null lang; null texts and texts without a letter go."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (sets of five-word shingles with a Jaccard similarity of 0.8, counted out) the row with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; a document of nothing else goes."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip (decoding gives the text back)."""
    into = fresh_name(docs, "encoded")
    rows = sentencepiece_codec.encode_texts(docs, vocabulary(MODEL), into=into)
    return rows.select("doc_id", "lang", "source", F.size(f"{into}.ids").cast("long").alias("n_tokens"), F.col(f"{into}.ids").alias("ids"), F.col(f"{into}.round_trip").alias("round_trip"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("sentencepiece", encode)]

#: A language model, shingle sets and piece search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. A stage's work tables go when its rows are written, and its input's rows then too."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with work_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
