"""Readers with declared schemas, and writers that keep out of the project's own folder.

Readers fail on what they can't read, or give the bad rows beside the good ones.
"""

from __future__ import annotations

import json
import logging
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import require_columns

PROJECT = Path(__file__).resolve().parents[2]
CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object for each file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parsed_lines(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(columns of the good JSON lines, the lines that aren't JSON objects of the schema); blank lines are skipped."""
    some = lines.select(F.col(column).alias("value")).where(F.col("value").rlike("\\S"))
    parsed = some.select("value", F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select("r.*").drop(CORRUPT), parsed.where(bad).select("value")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """parsed_lines of text files."""
    return parsed_lines(spark.read.text(path), "value", schema)


def read_mapping(path: str) -> dict:
    """A settings file (JSON, or YAML where a YAML library is installed): empty is {}, anything but a mapping raises."""
    text = Path(path).read_text()
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text) if text.strip() else None
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise TypeError(f"{path} holds no mapping")
    return found


def training_rows(df: DataFrame, split: str = "set", value: str = "train") -> DataFrame:
    """The rows of the training split; raises if there are none."""
    rows = df.where(F.col(split) == value)
    if rows.isEmpty():
        raise ValueError(f"no rows with {split} = {value}")
    return rows


def first_lines(df: DataFrame, order: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(order).limit(n)


def read_labelled_csv(spark: SparkSession, path: str, text_column: str, label_column: str, wanted: str) -> DataFrame:
    """(sql, label true) of rows whose label is the wanted one whatever its case; blank texts go; missing columns raise."""
    df = require_columns(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), [text_column, label_column])
    hit = F.lower(F.trim(F.col(label_column))) == wanted.strip().lower()
    return df.where(hit & F.col(text_column).rlike("\\S")).select(F.col(text_column).alias("sql"), F.lit(True).alias("label"))


def read_optional_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of the files that are there; none if none is."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = [p for p in paths if jvm(p).getFileSystem(conf).exists(jvm(p))]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(there)


def round_folders(spark: SparkSession, path: str) -> DataFrame:
    """(round, file) of files in folders named round_N, in order of N."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    number = F.regexp_extract("path", r"/round_(\d+)/", 1)
    return files.where(number != "").select(number.cast("int").alias("round"), F.col("path").alias("file")).orderBy("round", "file")


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes of all files below, from their sizes alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_table(spark: SparkSession, url: str, table: str, columns: list[str], limit: int = 100, **options: str) -> DataFrame:
    """A bounded sample of a table over JDBC; the limit is pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*columns).limit(limit)


def scalar_query(spark: SparkSession, url: str, query: str, **options: str) -> str:
    """First column of the first row over JDBC; empty if the query gives none or fails, which is logged."""
    try:
        row = spark.read.format("jdbc").options(url=url, query=query, **options).load().first()
    except Exception as error:  # whatever the driver of the database raises
        logging.getLogger(__name__).warning("no value for %s: %s", query, type(error).__name__)
        return ""
    return "" if row is None or row[0] is None else str(row[0])


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def small_database(df: DataFrame, table: str) -> str:
    """The JDBC url of a new read-only database with the rows of a small df, which every executor and the driver can read.

    An embedded database belongs to one process: one in memory or in a folder that the driver fills is not
    there for executors. So the driver makes it, closes it, and Spark ships it to each process in a JAR.
    """
    spark, name = df.sparkSession, f"corpusloom_{uuid.uuid4().hex}"
    jvm, made = spark._jvm, os.path.realpath(tempfile.mkdtemp(prefix="corpusloom-"))
    jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    driver, none = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver(), jvm.java.util.Properties()
    dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get("jdbc:derby:")
    link = driver.connect(f"jdbc:derby:{made}/{name};create=true", none)
    schema = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.schemaString(dialect, df._jdf.schema(), False, jvm.scala.Option.empty())
    link.createStatement().executeUpdate(f"CREATE TABLE {table} ({schema})")
    insert = link.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' * len(df.columns))})")
    for row in df.toLocalIterator():
        for k, value in enumerate(row, 1):
            insert.setObject(k, value)
        insert.executeUpdate()
    link.close()
    try:
        driver.connect(f"jdbc:derby:{made}/{name};shutdown=true", none)
    except Exception as error:  # a database that has been closed says so by an error
        if "08006" not in str(error.java_exception.getSQLState()):
            raise
    with zipfile.ZipFile(f"{made}/{name}.jar", "w") as out:
        for f in sorted(Path(made, name).rglob("*")):
            if f.suffix != ".lck":
                out.write(f, f.relative_to(made))
    shutil.rmtree(f"{made}/{name}")
    spark.sql(f"ADD JAR '{made}/{name}.jar'")
    return f"jdbc:derby:classpath:{name}"


def sample_values(table: DataFrame, limit: int = 100) -> DataFrame:
    """(column, value) of the values of a bounded sample that are neither null nor empty."""
    rows = table.limit(limit).select([F.col(c).cast("string").alias(c) for c in table.columns])
    return rows.unpivot([], table.columns, "column", "value").where("value IS NOT NULL AND value <> ''")


def read_samples(spark: SparkSession, path: str, text: list[str], numbers: list[str]) -> DataFrame:
    """A telemetry CSV: all text at first, numbers where they are numbers."""
    schema = ", ".join(f"{c} string" for c in [*text, *numbers])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's path, not made yet, that driver and executors share: below ``spark.checkpoint.dir``, or on one machine a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='corpusloom-')}/{uuid.uuid4().hex}"


def outside_project(path: str) -> str:
    """path, unless it is in the project's folder."""
    local = path.removeprefix("file://")
    if "://" not in local and Path(os.path.abspath(local)).is_relative_to(PROJECT):
        raise ValueError(f"outputs don't go into the project: {path}")
    return path


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(outside_project(path))


def append_events(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; a table without rows has one too."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(outside_project(path))


def write_json(rows: DataFrame, path: str) -> None:
    """A small result as one file."""
    rows.coalesce(1).write.mode("overwrite").json(outside_project(path))


def without_private(df: DataFrame) -> DataFrame:
    """Columns whose name begins with an underscore are dropped."""
    return df.select([c for c in df.columns if not c.startswith("_")])
