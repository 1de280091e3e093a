"""Streams give what the same rows give as a table."""

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import events as S

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in", rows


def drained(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_windows(spark, folder):
    path, rows = folder
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    got = drained(S.windowed_summary(S.event_stream(spark, path, schema), "ts", "event_type", "value"), "complete", "w")
    want = rows.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert got.select("start", "event_type", "n").exceptAll(want).isEmpty() and got.count() == want.count()
    sessions = drained(S.session_summary(S.event_stream(spark, path, schema), "ts", "user_id"), "complete", "s")
    assert sessions.agg(F.sum("n")).first()[0] == rows.count()


def test_stage_pairs(spark, folder):
    path, rows = folder
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").otherwise("other")
    got = drained(S.stage_pairs(S.event_stream(spark, path, schema).select("user_id", "ts", kind.alias("event")), ["user_id"], "ts", "event"), "append", "p")
    want, open_ = set(), {}
    for r in rows.orderBy("ts").collect():
        if r["event_type"] == "signup":
            open_[r["user_id"]] = r["ts"]
        elif r["event_type"] == "purchase" and r["user_id"] in open_:
            want.add((r["user_id"], open_.pop(r["user_id"]), r["ts"]))
    assert {(r["user_id"], r["started"], r["completed"]) for r in got.collect()} == want


def test_intervals(spark, folder):
    path, rows = folder
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    spans = rows.groupBy("event_type").agg(F.min("ts").alias("a"), F.expr("min(ts) + interval 1 day").alias("b")).withColumnRenamed("event_type", "stage")
    got = drained(S.in_intervals(S.event_stream(spark, path, schema), spans, "ts", "a", "b"), "append", "i")
    want = rows.join(spans, F.col("ts").between(F.col("a"), F.col("b")))
    assert got.count() == want.count()
