"""Queries on a cluster of two executors, each a process of its own that doesn't see the driver's memory."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

REPO = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"

RUN = """
import sys
from pyspark.sql import SparkSession

conf = {"spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": sys.argv[1]}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
import __spark_entry__
for _ in range(2):
    rows = __spark_entry__.queries()[sys.argv[2]](spark, sys.argv[3]).orderBy("n_nationkey").collect()
    assert [tuple(r) for r in rows] == [(r["n_nationkey"], r["n_name"], "24", "") for r in spark.read.parquet(sys.argv[3] + "/nation.parquet").orderBy("n_nationkey").collect()] and len(rows) == 25
from corpusloom.sources import io
odd = [(None, "a"), (1, None), (2, "it's")]
url = io.small_database(spark.createDataFrame(odd, "k long, v string"), "odd")
assert {tuple(r) for r in io.read_table(spark, url, "odd", ["v", "k"], driver=io.DERBY).select("k", "v").collect()} == set(odd)
print("told by executors")
"""


def test_database_is_there_for_executors(tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write their logs below Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(REPO), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", RUN, f"file://{tmp_path}/shared", "s6_s7_database", DATA], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=170)
    assert "told by executors" in done.stdout, done.stderr[-3000:]
