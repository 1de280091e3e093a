"""Chat and fine-tuning records from rows, and the arrays that training reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ddl_type

MASKED = -100


def ddl(database: Column, tables: Column) -> Column:
    """CREATE TABLE text of an array of (table_name, columns of (column_name, data_type))."""
    tick = lambda n: F.when(n.rlike(r"[ /()]"), F.concat(F.lit("`"), n, F.lit("`"))).otherwise(n)
    column = lambda c: F.concat(F.lit("    "), tick(F.coalesce(c["column_name"], F.lit("unknown_col"))), F.lit(" "), ddl_type(c["data_type"]))

    def table(t: Column) -> Column:
        cols = F.array_join(F.transform(t["columns"], column), ",\n")
        body = F.when(F.coalesce(F.size(t["columns"]), F.lit(0)) > 0, cols).otherwise("    -- No columns defined")
        return F.concat(F.lit("CREATE TABLE `"), F.coalesce(t["table_name"], F.lit("unknown_table")), F.lit("` (\n"), body, F.lit("\n);\n"))

    head = F.concat(F.lit("-- Database: "), F.coalesce(database, F.lit("unknown_db")), F.lit("\n"))
    return F.array_join(F.concat(F.array(head), F.transform(tables, table)), "\n")


def first_schema(schemas: DataFrame, key: str, ordinal: str, last: bool = False) -> DataFrame:
    """One row for each key: the first in order, or the last."""
    row, pick = F.struct(*schemas.columns), F.max_by if last else F.min_by
    return schemas.groupBy(F.col(key).alias("__k")).agg(pick(row, F.col(ordinal)).alias("r")).select("r.*")


def with_schema(df: DataFrame, schemas: DataFrame, key: str, ordinal: str, required: bool = False) -> DataFrame:
    """df with the schema of its key (the last of several); ``required`` raises on reading a row without one."""
    one = first_schema(schemas, key, ordinal, last=True).drop(ordinal).withColumn("__has", F.lit(True))
    out = df.join(one, key, "left")
    if required:
        out = out.withColumn(key, F.when(F.col("__has"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no schema of "), F.coalesce(F.col(key), F.lit("null"))))))
    return out.drop("__has")


def user_prompt(mode: str, sql: Column, schema: Column | None = None) -> Column:
    if mode == "schema_aware":
        return F.concat(F.lit("Schema:\n"), schema, F.lit("\n\nSQL:\n"), sql)
    if mode == "sql_only":
        return F.concat(F.lit("SQL:\n"), sql)
    raise ValueError(f"unknown prompt mode {mode}")


def record(system: str, user: Column, label: Column) -> Column:
    """Three messages; the answer is benign where the label is true."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", F.when(label, "benign").otherwise("malicious")))


def sft_records(df: DataFrame, system: str, mode: str, sql: str, label: str, taxonomy: list[str], schema: str | None = None, level: str = "difficulty") -> DataFrame:
    """messages, sql, label, prompt_mode; taxonomy and difficulty (default medium) of rows that aren't benign, null else."""
    attack = ~F.col(label)
    extra = [F.when(attack, F.col(c)).alias(c) for c in taxonomy]
    user = user_prompt(mode, F.col(sql), F.col(schema) if schema else None)
    return df.select(record(system, user, F.col(label)).alias("messages"), F.col(sql).alias("sql"), F.col(label).alias("label"), F.lit(mode).alias("prompt_mode"), *extra, F.when(attack, F.coalesce(level, F.lit("medium"))).alias("difficulty"))


def conversations(turns: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """(key, messages) with the turns in order; a hot conversation is one row in the end, so it is gathered once."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(rows.alias("rows")).select(key, F.transform("rows", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def well_formed(messages: Column) -> Column:
    """Whether the first three turns are of system, user and assistant."""
    return F.coalesce(F.transform(F.slice(messages, 1, 3), lambda m: m["role"]) == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.lit(False))


def rendered_turn(m: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))


def rendered_chat(messages: Column, inference: bool = False) -> Column:
    """All turns as one text; for inference the first two and an open turn of the assistant."""
    if inference:
        return F.concat(F.array_join(F.transform(F.slice(messages, 1, 2), rendered_turn), ""), F.lit("<|im_start|>assistant\n"))
    return F.array_join(F.transform(messages, rendered_turn), "")


def masked_prompt(ids: Column, prompt: Column) -> Column:
    """ids as labels with the prompt's masked; null unless the prompt is how ids begin."""
    n = F.size(prompt)
    return F.when(F.slice(ids, F.lit(1), n) == prompt, F.transform(ids, lambda x, i: F.when(i < n, MASKED).otherwise(x)))


def supervised(df: DataFrame, labels: str) -> DataFrame:
    """Rows with a label that isn't masked."""
    return df.where(F.exists(labels, lambda x: x != MASKED))


def joined_completion(prompt: Column, completion: Column, end: str = "", begin: str = "") -> Column:
    """Prompt and completion with white space between, and end and begin marks where they are missing."""
    gap = F.when(prompt.rlike(r"[ \n\t]$") | completion.rlike(r"^[ \n\t]"), "").otherwise(" ")
    text = F.concat(prompt, gap, completion)
    text = F.when(F.lit(end) == "", text).when(text.endswith(end), text).otherwise(F.concat(text, F.lit(end)))
    return F.concat(F.lit(begin), text)
