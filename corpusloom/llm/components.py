"""Connected components over an edge table, by alternating large-star and small-star steps.

Every round is two key joins over the edges alone and is written to the shared folder; edges never
reach the driver. The edges of a node with many are dealt over several tasks. Rounds grow with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, label), label the smallest node reachable.

    Nodes without an edge are absent. Null ends and self-links are ignored; repeated links count once.
    """
    now = materialise(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if before == (mark["n"], mark["x"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = (mark["n"], mark["x"])
        ends = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialise(ends.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select(F.col("u").alias("b"), F.least("u", "v").alias("m"), "n"), "least")
        large = materialise(join_unique(now, least, ["b"], "n", F.col("a")).select("a", F.col("m").alias("b")).where("a <> b").distinct(), "large")
        lower = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lower")
        small = join_unique(large, lower, ["a"], "n", F.col("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        now = materialise(small.distinct(), "edges")
