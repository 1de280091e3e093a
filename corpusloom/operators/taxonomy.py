"""The three-axis taxonomy: declared arms, cluster keys, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SCOPES, TECHNIQUES

VERSION = 3
BENIGN = "benign"
STATES = ("no_comment", "clean_comment", "cepp")
PRUNED = (("boolean_blind", "lor"), ("piggy_backed", "lor"))


def arms(spark: SparkSession) -> DataFrame:
    """(ordinal, technique, reference_scope, comment_state, category, cluster): all combinations but the pruned ones, in fixed order."""
    axis = lambda values, name: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])).alias(name)
    rows = spark.range(1).select(axis(TECHNIQUES, "t")).select("t", axis(SCOPES, "s")).select("t", "s", axis(STATES, "c"))
    for t, s in PRUNED:
        rows = rows.where(~((F.col("t.v") == t) & (F.col("s.v") == s)))
    order = (F.col("t.i") * 9 + F.col("s.i") * 3 + F.col("c.i")).alias("ordinal")
    return rows.select(order, F.col("t.v").alias("technique"), F.col("s.v").alias("reference_scope"), F.col("c.v").alias("comment_state"), category_key(F.col("t.v"), F.col("s.v")).alias("category"), F.concat_ws("||", "t.v", "s.v", "c.v").alias("cluster"))


def category_key(technique: Column, scope: Column) -> Column:
    return F.concat_ws("||", technique, scope)


def cluster_key(label: Column, *axes: Column) -> Column:
    """``benign`` where the label is true, else the axes joined."""
    return F.when(label, BENIGN).otherwise(F.concat_ws("||", *axes))


def known_category(technique: Column, scope: Column) -> Column:
    """Whether a technique and scope are declared and not pruned."""
    pruned = F.lit(False)
    for t, s in PRUNED:
        pruned = pruned | ((technique == t) & (scope == s))
    return F.coalesce(technique.isin(*TECHNIQUES) & scope.isin(*SCOPES) & ~pruned, F.lit(False))


def key_violation(key: Column, parts: int) -> Column:
    """Why a key of two (category) or three (cluster) parts is none; null for a valid one."""
    x = F.split(key, r"\|\|", -1)
    out = F.when(key.isNull() | (F.size(x) != parts), "parts").when(~known_category(F.get(x, 0), F.get(x, 1)), "category")
    return out.when(~F.get(x, 2).isin(*STATES), "comment_state") if parts == 3 else out


def parsed_category(key: Column) -> Column:
    """Struct (technique, reference_scope) of a valid two-part key, else null."""
    x = F.split(key, r"\|\|", -1)
    return F.when(key_violation(key, 2).isNull(), F.struct(F.get(x, 0).alias("technique"), F.get(x, 1).alias("reference_scope")))


def parsed_key(key: Column) -> Column:
    """Struct (technique, reference_scope, comment_state) of a valid three-part key, else null."""
    x = F.split(key, r"\|\|", -1)
    return F.when(key_violation(key, 3).isNull(), F.struct(F.get(x, 0).alias("technique"), F.get(x, 1).alias("reference_scope"), F.get(x, 2).alias("comment_state")))


def without_benign(df: DataFrame, key: str = "cluster") -> DataFrame:
    return df.where(F.col(key) != BENIGN)


def coverage(observed: DataFrame, expected: DataFrame, key: str = "cluster") -> DataFrame:
    """(key, status): expected keys that weren't observed (missing) and observed ones that weren't expected (extra)."""
    o, e = observed.select(key).distinct(), expected.select(key).distinct()
    return e.join(o, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(o.join(e, key, "left_anti").withColumn("status", F.lit("extra")))
