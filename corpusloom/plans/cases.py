"""Queries over short lists of cases that reach every branch of a rule; their SQL holds answers told by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import taxonomy
from .registry import Tables, query

SQL_TYPES = {"string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def cases(name: str, given: str, told: str, rows: list[tuple]):
    """Register fn(columns) -> answers over rows of (given..., told...), numbered by k."""
    inputs, answers = [c.split() for c in given.split(", ")], [c.split() for c in told.split(", ")]
    n = len(inputs)
    values = ", ".join(f"({i}, {', '.join(map(literal, r[n:]))})" for i, r in enumerate(rows))
    picked = ", ".join(f"CAST({c} AS {SQL_TYPES[t]}) AS {c}" for c, t in answers)
    sql = f"SELECT k::BIGINT AS k, {picked} FROM (VALUES {values}) v(k, {', '.join(c for c, _ in answers)})"

    def add(fn: Callable[..., list[Column]]):
        def run(t: Tables):
            df = t.spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], f"k long, {given}")
            return df.select("k", *[x.alias(c) for x, (c, _) in zip(fn(*[F.col(c) for c, _ in inputs]), answers)])

        query(name, sql)(run)
        return fn

    return add


@cases("f2_f3_f4_technique_cases", "t string, technique string, scope string", "told string, told_scope string", [
    ("1; DROP TABLE t", None, None, "piggy_backed", "lor"), ("1;  select 1", "x", "y", "piggy_backed", "lor"), ("1 AND sleep (5)", None, None, "time_blind", "lor"), ("BENCHMARK(10, 1)", None, None, "time_blind", "lor"),
    ("1 union select $sysInfo$", None, None, "union_query", "scr"), ("unions", None, None, "union_query", "lor"), ("1 ORDER  BY 3", None, None, "union_query", "lor"), ("group by 2 having 1", None, None, "union_query", "lor"),
    ("CAST($column_t1_1$ AS int)", None, None, "error_based", "tsr"), ("log10 (2) $sysInfo$ $sample_t1_2$", None, None, "error_based", "tsr"), ("gtid_subset(1)", None, None, "error_based", "lor"), ("1 AND SUBSTR('a',1,1)='a'", None, None, "boolean_blind", "lor"),
    ("and length(user())>3", None, None, "boolean_blind", "lor"), ("sandy order", None, None, "boolean_blind", "lor"), ("x' OR '1'='1", None, None, "tautology", "lor"), ("x'  and  $table_2$", None, None, "tautology", "tsr"),
    ("plain words $table$", None, None, "unknown", "lor"), ("order of words", None, None, "unknown", "lor"), ("anything", "time_blind", "scr", "time_blind", "scr"), ("1; DROP x", "unknown", "unknown", "unknown", "unknown"), ("1; DROP x", "odd", "tsr", "piggy_backed", "tsr"),
])
def technique_cases(t, technique, scope):
    return list(X.identified(t, technique, scope).values())


@cases("f13_literal_cases", "v string, kind string", "told string", [
    (None, "int", "NULL"), ("NULL", "varchar", "NULL"), ("5", "int", "5"), ("5.5", "DECIMAL", "5.5"), ("2020-01-01", "date", "'2020-01-01'"), ("it's", "datetime", "'it's'"), ("5", "varchar", "'5'"), ("5", "varchar(20)", "5"), ("2019-01-01", "varchar(9)", "2019-01-01"),
    ("o'x", "varchar(9)", "'o''x'"), ("o'x", "text", "'o''x'"), ("-", "enum", "'-'"), ("1-2", "year", "1-2"), ("12", "nchar", "'12'"), ("12", "mediumint", "12"), ("7x", None, "'7x'"), ("7", None, "7"),
])
def literal_cases(v, kind):
    return [X.sql_literal(v, kind)]


@cases("f28_expected_type_cases", "t string, name string, technique string", "told string", [
    ("a $table_1$", "table_1", None, "table"), ("$table$", "table", "x", "table"), ("$tables$", "tables", "x", "all"), ("$int$", "int", None, "integer"), ("$float$", "float", None, "float"), ("$hex$", "hex", None, "hex"), ("$time$", "time", None, "time"),
    ("$date$", "date", None, "date"), ("$character$", "character", None, "character"), ("$char$", "char", "error_based", "all"), ("extractvalue(1, concat(0x7e, $column_t1_1$))", "column_t1_1", "error_based", "integer"),
    ("updatexml (1, $sysInfo$, 1)", "sysInfo", "tautology", "all"), ("updatexml(1, $sysInfo$, 1)", "sysInfo", "error_based", "integer"), ("gtid_subset($sysInfo$, 1)", "sysInfo", None, "integer"), ("GTID_SUBTRACT(1, $sysInfo$)", "sysInfo", "error_based", "integer"),
    ("SUBSTR(($column_t1_1$),1,1)", "column_t1_1", "union_query", "string"), ("left( $sample_t1_1$, 2)", "sample_t1_1", "union_query", "string"), ("ascii($sysInfo$)", "sysInfo", "tautology", "string"), ("LENGTH( $sysInfo$ ) > 3", "sysInfo", "tautology", "string"),
    ("$column_t1_1$) like 'a'", "column_t1_1", "tautology", "string"), ("$column_t1_1$ REGEXP 'a'", "column_t1_1", "tautology", "string"), ("$column_t1_10$ REGEXP 'a' $column_t1_1$", "column_t1_1", "tautology", "all"),
    ("CAST(($column_t1_1$) AS int) DAY($column_t1_1$)", "column_t1_1", "error_based", "string"), ("convert($sysInfo$, int) DAY($sysInfo$)", "sysInfo", "error_based", "string"), ("SQRT($sysInfo$) YEAR($sysInfo$)", "sysInfo", "Error", "string"),
    ("$sysInfo$ = $int$ YEAR($sysInfo$)", "sysInfo", "error_based", "string"), ("$sysInfo$) != 5 YEAR($sysInfo$)", "sysInfo", "error_based", "string"), ("YEAR($sysInfo$)", "sysInfo", "error_based", "integer"), ("DATE($sysInfo$) extractvalue", "sysInfo", "error_based", "string"),
    ("extractvalue $sysInfo$", "sysInfo", "error_based", "integer"), ("$sysInfo$", "sysInfo", "error_based", "string"), ("$sysInfo$ > 5", "sysInfo", "tautology", "integer"), ("$column_t1_1$ = 5", "column_t1_1", "tautology", "number"),
    ("$column_t1_1$ ) <= $int$", "column_t1_1", "tautology", "number"), ("$sample$ between 1 and 2", "sample", "tautologies", "number"), ("$sysInfo$ BETWEEN 1 AND 2", "sysInfo", "tautology", "integer"), ("$column_t1_1$ != 5", "column_t1_1", "tautology", "all"),
    ("$sysInfo$ != 4", "sysInfo", "boolean_blind", "integer"), ("IF($sysInfo$, 1, 0)", "sysInfo", "time_blind", "integer"), ("$column_t1_1$ > 4", "column_t1_1", "time_blind", "string"), ("$sysInfo$ x", "sysInfo", "inference", "string"),
    ("$column_t1_1$ = 5", "column_t1_1", "union_query", "all"), ("$column_t1_1$ = 5", "column_t1_1", "piggy_backed", "all"), ("$column_t1_1$ = 5", "column_t1_1", None, "all"), ("$other$ like 'a'", "other", "error_based", "all"), ("$sample_t1_1$", "sample_t1_1", "odd", "all"),
])
def type_cases(t, name, technique):
    return [X.guessed_type(t, name, technique)]


@cases("f23_f24_f25_f27_rejection_cases", "old string, new string, technique string, scope string", "told string", [
    ("x' OR 1=1", "  ", "tautology", "lor", "empty"), ("x' OR 1=1", None, "tautology", "lor", "empty"), ("a", "b\nc", "unknown", "lor", "multiline"), ("$table_1$ x", "no reference", "unknown", "scr", "placeholder"), ("$table_1$", "no reference", "unknown", "tsr", "placeholder"),
    ("$table_1$", "$column_t1_1$ z", "unknown", "tsr", None), ("a", "b $sysInfo$", "unknown", "lor", "scope"), ("$sysInfo$", "$sysInfo$ $table_1$", "unknown", "scr", "scope"), ("$table_1$", "$sysInfo$ alone", "unknown", "tsr", "scope"), ("a $int$", "b $hex$", "unknown", "scr", None),
    ("a", "b -- c", "unknown", "lor", "comment"), ("a", "b # c", "unknown", "lor", "comment"), ("a", "f(x", "unknown", "lor", "paren"), ("x' OR 1=1", "1; DROP t", "tautology", "lor", "technique"), ("x' OR 1=1", "1 AND LENGTH(2)", "tautology", "lor", None),
    ("x", "1; DROP t", "unknown", "lor", None), ("u", "plain", "union_query", "lor", None), ("u", "1 UNION SELECT 2", "union_query", "lor", None),
])
def rejection_cases(old, new, technique, scope):
    return [X.rejection(old, new, technique, scope)]


@cases("f29_type_list_cases", "t string, n int", "told string", [
    ('["String","odd"]', 2, "string,all"), ('Types: ["hex", "Number"] ok', 3, "hex,number,all"), ("none", 2, "all,all"), ('["date","time","float"]', 2, "date,time"), ('[1, null, "table"]', 3, "all,all,table"), ('{"a": ["character"]}', 1, "character"),
])
def type_list_cases(t, n):
    return [F.array_join(X.type_list(t, n), ",")]


@cases("p5_comment_state_cases", "state string, requires boolean, core string, payload string, note string, prefix string", "told string", [
    ("no_comment", None, "1", "1", None, None, "delimiter_flag_missing"), ("no_comment", False, "1-- ", "1", None, None, "marker_in_core"), ("no_comment", True, "1", "1", None, None, "no_comment_needs_no_delimiter"), ("no_comment", False, "1", "1#x", None, None, "no_comment_has_comment"),
    ("no_comment", False, "1", "1", "note", None, "no_comment_has_comment"), ("clean_comment", False, "1", "1-- ", "", "-- ", "delimiter_required"), ("cepp", True, "1", "1-- ", " ", "-- ", "note_missing"), ("cepp", True, "1", "1-- a\nb", "a\nb", "-- ", "note_not_one_line"),
    ("clean_comment", True, "1", "1/*", "", "/*", "prefix_unknown"), ("clean_comment", True, "1", "1-- x", "", "-- ", "clean_comment_not_exact"), ("cepp", True, "1", "1-- y", "x", "-- ", "note_not_after_prefix"), ("odd", False, "1", "1", None, None, "state_unknown"),
    ("clean_comment", True, "1", "1#", "", "#", None), ("cepp", True, "1", "1-- x", "x", "-- ", None), ("no_comment", False, "1", "1", None, None, None),
])
def comment_state_cases(state, requires, core, payload, note, prefix):
    return [X.comment_state_violation(state, requires, core, payload, note, prefix)]


@cases("p9_key_cases", "key string", "bad_category string, bad_cluster string, technique string, state string", [
    ("tautology||lor", None, "parts", "tautology", None), ("boolean_blind||lor", "category", "parts", None, None), ("tautology||lor||cepp", "parts", None, None, "cepp"), ("piggy_backed||lor||cepp", "parts", "category", None, None), ("piggy_backed||scr", None, "parts", "piggy_backed", None),
    ("time_blind||tsr||odd", "parts", "comment_state", None, None), ("odd||tsr", "category", "parts", None, None), ("tautology||odd", "category", "parts", None, None), ("", "parts", "parts", None, None), (None, "parts", "parts", None, None), ("a||b||c||d", "parts", "parts", None, None),
])
def key_cases(key):
    return [taxonomy.key_violation(key, 2), taxonomy.key_violation(key, 3), taxonomy.parsed_category(key)["technique"], taxonomy.parsed_key(key)["comment_state"]]


@cases("f26_p3_p4_predicate_cases", "t string", "even boolean, safe boolean, marked boolean", [
    ("(a)", True, True, False), ("(a", False, True, False), ("a\nb", True, False, False), ("a#b", True, False, True), ("a--b)", False, False, True), ("  ", True, False, False), (None, None, False, None),
])
def predicate_cases(t):
    return [X.parens_even(t), X.single_line_safe(t), X.has_comment_marker(t)]


@cases("f30_answer_cases", "t string", "told string", [
    ("<answer>Malicious</answer>", "malicious"), ("x <ANSWER> it is not malicious\n</ANSWER> malicious", "benign"), ("<answer>Odd One</answer>", "odd one"), ("the query is benign, not malicious", "benign"), ("MALICIOUS", "malicious"), (" benign?", "benign"), ("Hello there", "Hello"), ("", ""),
])
def answer_cases(t):
    return [X.answer(t)]


@cases("f43_f44_render_cases", "technique string, name string", "told string, guide string", [
    ("tautology", "a", "Of a: a {{ odd }}.", X.GUIDANCE["tautology"]), ("time_blind", "{{ technique }}", "Of {{ technique }}: {{ technique }} {{ odd }}.", X.GUIDANCE["time_blind"]), ("union_query", None, "Of :  {{ odd }}.", X.GUIDANCE["union_query"]),
    ("piggy_backed", "$1 \\1", "Of $1 \\1: $1 \\1 {{ odd }}.", X.GUIDANCE["piggy_backed"]), ("error_based", "", "Of :  {{ odd }}.", X.GUIDANCE["error_based"]), ("boolean_blind", "b", "Of b: b {{ odd }}.", X.GUIDANCE["boolean_blind"]),
    ("odd", "b", "Of b: b {{ odd }}.", X.GUIDANCE["tautology"]), (None, "b", "Of b: b {{ odd }}.", X.GUIDANCE["tautology"]),
])
def render_cases(technique, name):
    return [X.rendered("Of {{ name }}: {{name}} {{ odd }}.", {"name": name, "technique": technique}), X.guidance(technique)]


@cases("f9_aligned_cases", "text string, types string", "told string", [
    ("$int$ $column_t1_1$ $character$ $sample_t1_1$", "a,b,c,d", "b,d"), ("$character$ $column_t1_1$", "a", "all"), ("$column_t1_1$", "a,b,c", "a"), ("$time$ $date$ $hex$ $float$", "a,b", ""), ("$char$ $sysInfo$", "a,b", "a,b"), ("none", "a", ""),
])
def aligned_cases(text, types):
    return [F.array_join(X.aligned_types(F.split(types, ","), X.placeholders(text), tuple(X.NAMED_TYPES)), ",")]


@cases("f11_compatible_cases", "declared string, expected string", "told boolean", [
    ("INT(11)", "integer", True), ("decimal(9,2)", "integer", True), ("varchar(9)", "number", False), ("double", "float", True), ("int", "float", False), ("time", "date", True), ("date", "time", False), ("nvarchar(9)", "string", True), ("clob", "character", False), ("blob", "string", True),
    ("nchar", "character", True), ("bit", "boolean", True), ("tinyint(1)", "boolean", False), ("anything", "hex", True), ("anything", "all", True), ("anything", "table", True), ("int", "odd", False), (None, "string", False), (None, None, True),
])
def compatible_cases(declared, expected):
    from ..operators.templates import compatible

    return [compatible(declared, expected)]
