"""Template filling: placeholders resolved against schema tables and value pools, then samples assembled.

Templates, carriers and value pools are the caller's tables; nothing is built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import random_scalars, uniform

FIXED = tuple(X.NAMED_TYPES)
# What declared column types begin with that an expected type stands for; None is any.
COLUMN_TYPES = {
    "number": ("int", "integer", "bigint", "smallint", "tinyint", "real", "float", "double", "numeric", "decimal"),
    "integer": ("int", "integer", "bigint", "smallint", "tinyint", "real", "float", "double", "numeric", "decimal"),
    "float": ("real", "float", "double", "numeric", "decimal"),
    "string": ("varchar", "char", "text", "nvarchar", "nchar", "clob", "blob", "string"),
    "date": ("date", "datetime", "timestamp", "time"),
    "time": ("time", "datetime", "timestamp"),
    "hex": None,
    "character": ("varchar", "char", "text", "nvarchar", "nchar"),
    "boolean": ("bool", "boolean", "bit"),
    "all": None,
    "table": None,
}


def spots(templates: DataFrame, key: str, text: str, types: str | None = None) -> DataFrame:
    """One row for each placeholder: key, pos, name, kind, table_id, column_id and, with types, its expected type by place."""
    rows = templates.select(key, F.posexplode(X.placeholders(F.col(text))).alias("pos", "name"), *([types] if types else []))
    out = rows.withColumns(X.placeholder_parts(F.col("name")))
    return out.withColumn("expected", F.coalesce(F.get(types, F.col("pos")), F.lit("all"))).drop(types) if types else out


def merged_constraints(spots_: DataFrame, key: str) -> DataFrame:
    """(key, table_id, column_id, expected): the first type that isn't ``all``, else ``all``."""
    typed = F.min_by(F.when(F.col("expected") != "all", F.col("expected")), F.when(F.col("expected") != "all", F.col("pos")))
    return spots_.where("column_id IS NOT NULL").groupBy(key, "table_id", "column_id").agg(F.coalesce(typed, F.lit("all")).alias("expected"))


def compatible(declared: Column, expected: Column) -> Column:
    """Whether a declared column type begins with a type that the expected one stands for; never for an unknown one, a null one is ``all``."""
    low, want = F.lower(F.coalesce(declared, F.lit(""))), F.coalesce(expected, F.lit("all"))
    out = F.when(F.lit(False), F.lit(False))
    for name, kinds in COLUMN_TYPES.items():
        fits = F.lit(kinds is None)
        for k in kinds or ():
            fits = fits | low.startswith(k)
        out = out.when(want == name, fits)
    return out.otherwise(False)


def assigned_tables(wanted: DataFrame, constraints: DataFrame, columns: DataFrame, key: str, db: str, seed: int) -> DataFrame:
    """(key, db, table_id, table_name) for each row of wanted (key, db, table_id): a table that meets all its constraints, by hash.

    columns: (db, table_name, column_name, column_type). constraints have key, db, table_id, column_id,
    expected; a table meets them if each has a compatible column. A key's tables differ if the database has
    as many as the key wants; ids choose in ascending order. One that nothing is left for takes one of all
    tables of its database, by hash. Only tables that meet constraints, and one more, are joined to a key.
    """
    tables = columns.select(db, "table_name").distinct()
    numbered = tables.withColumns({"__n": F.row_number().over(Window.partitionBy(db).orderBy("table_name")) - 1, "__c": F.count("*").over(Window.partitionBy(db))})
    sizes = numbered.groupBy(db).agg(F.first("__c").alias("__c"))
    each = wanted.select(key, db, "table_id").distinct()
    u = lambda *more: uniform(seed, F.col(key), F.col("table_id"), *more)
    spare = each.join(sizes, db).withColumn("__n", F.floor(u() * F.col("__c")).cast("int")).join(numbered.drop("__c"), [db, "__n"]).select(key, db, "table_id", "__c", F.col("table_name").alias("spare"))
    needs = constraints.groupBy(key, db, "table_id").agg(F.count("*").alias("needs"))
    met = constraints.join(columns, db).where(compatible(F.col("column_type"), F.col("expected"))).groupBy(key, db, "table_id", "table_name").agg(F.count_distinct("column_id").alias("met")).join(needs, [key, db, "table_id"]).where("met = needs")
    free = each.join(needs, [key, db, "table_id"], "left_anti").join(tables, db)
    fit = met.select(key, db, "table_id", "table_name").unionByName(free.select(key, db, "table_id", "table_name"))
    fits = fit.groupBy(key, db, "table_id").agg(F.array_sort(F.collect_list(F.struct(u(F.col("table_name")).alias("u"), "table_name"))).alias("fits"))
    listed = spare.join(fits, [key, db, "table_id"], "left").groupBy(key, db).agg(F.first("__c").alias("__c"), F.array_sort(F.collect_list(F.struct("table_id", "spare", F.col("fits.table_name").alias("fits")))).alias("ids"))
    none = F.array().cast("array<string>")

    def choose(taken: Column, x: Column) -> Column:
        may = F.filter(F.coalesce(x["fits"], none), lambda t: (F.size("ids") > F.col("__c")) | ~F.array_contains(taken, t))
        return F.concat(taken, F.array(F.coalesce(F.get(may, 0), x["spare"])))

    chosen = listed.select(key, db, F.explode(F.arrays_zip(F.col("ids.table_id").alias("table_id"), F.aggregate("ids", none, choose).alias("table_name"))).alias("x"))
    return chosen.select(key, db, "x.table_id", "x.table_name")


def assigned_columns(constraints: DataFrame, tables: DataFrame, columns: DataFrame, key: str, db: str, seed: int) -> DataFrame:
    """(key, table_id, column_id, table_name, column_name, column_type): a compatible column by hash, else any of the table."""
    every = constraints.join(tables, [key, db, "table_id"]).join(columns, [db, "table_name"])
    unfit = (~compatible(F.col("column_type"), F.col("expected"))).cast("int")
    order = F.struct(unfit, uniform(seed, F.col(key), F.col("table_id"), F.col("column_id"), F.col("column_name")).alias("u"), "column_name")
    return every.groupBy(key, db, "table_id", "column_id", "table_name").agg(F.min_by(F.struct("column_name", "column_type"), order).alias("c")).select(key, db, "table_id", "column_id", "table_name", "c.*")


def column_text(name: Column) -> Column:
    """A column's name, in back-ticks if it has a space, a hyphen or a parenthesis."""
    return F.when(name.rlike(r"[ (-]"), F.concat(F.lit("`"), name, F.lit("`"))).otherwise(name)


def table_text(db: Column, table: Column, scope: Column) -> Column:
    """tsr names tables alone, other scopes with their database."""
    return F.when(scope == "tsr", table).otherwise(F.concat(db, F.lit("."), table))


def fixed_value(kind: Column, scalars: dict[str, Column], quoted: Column) -> Column:
    """The value of a placeholder of fixed type; time, date and character in quotes where ``quoted``."""
    out = F.lit(None).cast("string")
    for name in FIXED:
        value = scalars[name]
        if name in ("time", "date", "character"):
            value = F.when(quoted, F.concat(F.lit("'"), value, F.lit("'"))).otherwise(value)
        out = F.when(kind == name, value).otherwise(out)
    return out


def filled_templates(templates: DataFrame, values: DataFrame, key: str, text: str) -> DataFrame:
    """templates with a column ``filled``; values has (key, pos, value). Placeholders without a value stay."""
    by_place = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("__v"))
    n = F.regexp_count(F.col(text), F.lit(r"\$\w+\$"))
    listed = F.when(F.col("__v").isNotNull() & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.try_element_at(F.col("__v"), i))).otherwise(F.array().cast("array<string>"))
    return templates.join(by_place, key, "left").withColumn("filled", X.filled(F.col(text), listed)).drop("__v")


def pooled_values(wanted: DataFrame, pool: DataFrame, key: str, pos: str, kind: str, value: str, seed: int) -> DataFrame:
    """wanted (key, pos, kind) with a value of the pool (kind, value) of that kind, drawn for each place; ``all`` draws from the whole pool.

    A kind that the pool lacks draws from the whole pool too.
    """
    each = pool.select(kind, value).unionByName(pool.select(F.lit("all").alias(kind), value))
    numbered = each.withColumns({"__n": F.row_number().over(Window.partitionBy(kind).orderBy(value)) - 1, "__c": F.count("*").over(Window.partitionBy(kind))})
    sizes = numbered.groupBy(kind).agg(F.first("__c").alias("__c"))
    known = wanted.join(sizes.select(F.col(kind), F.lit(True).alias("__has")), kind, "left").withColumn(kind, F.when(F.col("__has"), F.col(kind)).otherwise("all")).drop("__has")
    drawn = known.join(sizes, kind).withColumn("__n", F.floor(uniform(seed, F.col(key), F.col(pos)) * F.col("__c")).cast("int")).drop("__c")
    return drawn.join(numbered.drop("__c"), [kind, "__n"]).select(key, pos, kind, value)


def system_filled(templates: DataFrame, pool: DataFrame, key: str, text: str, types: str, seed: int) -> DataFrame:
    """templates with a column ``filled``: the rules of scope scr. pool: (type, variable, sample), an ``all`` type for any.

    Each $sysInfo$ takes a variable of the type that stands at its place among all placeholders, by hash;
    without one of that type VERSION() for string and 1 for others. $sample$ takes the sample of the last
    such variable, in quotes unless it has nothing but digits, points and hyphens, 0 without one; without
    any $sysInfo$ it stays. Fixed types take random scalars, each place its own, quoted for time, date and
    character. Other placeholders stay.
    """
    at = spots(templates, key, text, types)
    system = at.where("kind = 'sysInfo'")
    w = Window.partitionBy("type")
    numbered = pool.select("type", "variable", "sample").withColumns({"__n": F.row_number().over(w.orderBy("variable")) - 1, "__c": F.count("*").over(w)})
    sizes = numbered.groupBy("type").agg(F.first("__c").alias("__c"))
    sized = system.join(sizes.withColumnRenamed("type", "expected"), "expected", "left").withColumn("__n", F.floor(uniform(seed, F.col(key), F.col("pos")) * F.col("__c")).cast("int"))
    drawn = sized.join(numbered.drop("__c").withColumnRenamed("type", "expected"), ["expected", "__n"], "left")
    put = drawn.select(key, "pos", F.coalesce("variable", F.when(F.col("expected") == "string", "VERSION()").otherwise("1")).alias("value"), "sample")
    last = put.groupBy(key).agg(F.max_by(F.struct("sample"), "pos")["sample"].alias("sample"))
    shown = F.when(F.coalesce("sample", F.lit("")) == "", "0").when(F.translate("sample", ".-", "").rlike(r"^\d+$"), F.col("sample")).otherwise(F.concat(F.lit("'"), F.col("sample"), F.lit("'")))
    samples = at.where("name = 'sample'").join(last, key).select(key, "pos", shown.alias("value"))
    scalars = fixed_value(F.col("kind"), random_scalars(seed, F.col(key), F.col("pos")), F.lit(True))
    fixed = at.where(F.col("kind").isin(*FIXED)).select(key, "pos", scalars.alias("value"))
    return filled_templates(templates, put.select(key, "pos", "value").unionByName(samples).unionByName(fixed), key, text)


def comment_strategy(u: Column, rational_share: float = 0.2) -> Column:
    """``rational`` below the share, else ``local``."""
    return F.when(u < rational_share, "rational").otherwise("local")


def with_comment(df: DataFrame, pool: DataFrame, key: str, payload: str, technique: str, response: str, error: str, allow_llm: bool, seed: int, rational_share: float = 0.2, stop: tuple[str, ...] = ()) -> DataFrame:
    """df with ``comment`` and ``comment_strategy``. pool: (type, comment), the caller's safe one-line comments.

    Below rational_share of the draws a comment is rational: without a model the sentence on the payload
    (rational_template_explanation); with one its safe response, trimmed (rational_explanation), else the
    sentence again, and why: rational_fallback_exception_<error> or rational_fallback_invalid_response. All
    others draw evenly from the whole pool: local_<type>, lower-cased, spaces as underscores; a comment of
    several types has the first by name. An empty pool gives null there.
    """
    safe = pool.where(X.single_line_safe(F.col("comment"))).select(F.trim("comment").alias("__local"), "type")
    # the caller's pool of comments is numbered as a whole: it has no key to number by
    numbered = safe.withColumns({"__n": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("type", "__local")) - 1, "__type": F.min("type").over(Window.partitionBy("__local"))})
    count = F.broadcast(numbered.agg(F.count("*").alias("__c")))
    drawn = df.join(count, F.lit(True)).withColumns({"__kind": comment_strategy(uniform(seed, F.col(key)), rational_share), "__n": F.floor(uniform(seed, F.lit("comment"), F.col(key)) * F.col("__c")).cast("int")})
    local = drawn.join(numbered.select("__n", "__local", "__type"), "__n", "left")
    sentence, good = X.contextual_sentence(F.col(payload), F.col(technique), stop), X.single_line_safe(F.col(response)) & F.col(error).isNull()
    by_model = [(good, F.trim(F.col(response)), F.lit("rational_explanation")), (F.col(error).isNotNull(), sentence, F.concat(F.lit("rational_fallback_exception_"), F.col(error))), (F.lit(True), sentence, F.lit("rational_fallback_invalid_response"))]
    choices = [(F.col("__kind") == "local", F.col("__local"), F.concat(F.lit("local_"), F.replace(F.lower("__type"), F.lit(" "), F.lit("_"))))]
    choices += by_model if allow_llm else [(F.lit(True), sentence, F.lit("rational_template_explanation"))]
    comment = strategy = F.when(F.lit(False), F.lit(None).cast("string"))
    for fits, text, name in choices:
        comment, strategy = comment.when(fits, text), strategy.when(fits, name)
    return local.select(*df.columns, comment.alias("comment"), strategy.alias("comment_strategy"))


def assembled(df: DataFrame, core: str, state: str, carrier: str, requires: str, note: str, prefix: str) -> DataFrame:
    """df with payload, sql and reject (null for a whole sample): comment added by state, contract checked, marker filled, balance checked before the comment."""
    c, s, p = F.col(core), F.col(state), F.col(prefix)
    note_ = F.when(s == "cepp", F.col(note)).otherwise("")
    payload = F.when(s == "no_comment", c).when(s == "clean_comment", F.concat(c, p)).otherwise(F.concat(c, p, note_))
    out = df.withColumns({"payload": payload, "__note": note_})
    out = out.withColumn("sql", X.marker_inserted(F.col(carrier), F.col("payload")))
    bad = X.comment_state_violation(s, F.col(requires), c, F.col("payload"), F.col("__note"), p)
    head = X.before_comment(F.col("sql"), F.when(s != "no_comment", p))
    reject = F.coalesce(bad, F.when(F.col("sql").isNull(), "no_marker"), F.when(~X.balance(head)["balanced"], "unbalanced"))
    return out.withColumn("reject", reject).drop("__note")
