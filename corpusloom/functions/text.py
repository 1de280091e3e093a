"""Column functions over text: cascades, predicates, placeholders, validators, answers, literals.

All are built-in expressions. White space and word characters are ASCII, as in the SQL that they are held
against.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Technique names and the patterns that tell them, in the order in which they are tried.
TECHNIQUES = ("tautology", "union_query", "piggy_backed", "error_based", "boolean_blind", "time_blind")
STACKED = r";\s*(SELECT|DELETE|INSERT|UPDATE|DROP|TRUNCATE|CREATE)\b"
TIMING = r"(SLEEP|BENCHMARK)\s*\("
UNION = r"\b(UNION|ORDER\s+BY\s+\d|GROUP\s+BY\s+\d)"
ERRORS = r"(CAST|CONVERT|SQRT|LOG\d*|MOD|EXTRACTVALUE|UPDATEXML|GTID_SUBSET|GTID_SUBTRACT)\s*\("
EXTRACTORS = r"SUBSTR|ASCII|ORD|LENGTH"
QUOTED_LOGIC = r"'\s+(OR|AND)\s+"
#: No pattern fits a text without any of these: one pass tells most texts.
HINT = r"[;(']|\bUNION|\bGROUP\s|SUBSTR|ASCII|ORD|LENGTH"
SCOPES = ("lor", "tsr", "scr")
TABLE_REFERENCE = r"\$(?:table_\d+|column_t\d+_\d+|sample_t\d+_\d+)\$"
SYSTEM_REFERENCE = "$sysInfo$"
PLACEHOLDER = r"\$(\w+)\$"
UNKNOWN = "unknown"
COMMENT_PREFIXES = ("-- ", "#")
EXPECTED_TYPES = ("table", "string", "number", "integer", "float", "hex", "time", "date", "character", "all")
# Data types as they are looked for in a declared type, in order, and what each is called.
TYPE_NAMES = {
    "text": "VARCHAR", "varchar": "VARCHAR", "char": "VARCHAR", "string": "VARCHAR", "int": "INTEGER", "integer": "INTEGER", "real": "REAL", "float": "REAL",
    "double": "DOUBLE", "number": "DECIMAL", "decimal": "DECIMAL", "bool": "BOOLEAN", "boolean": "BOOLEAN", "date": "DATE", "datetime": "DATETIME", "timestamp": "TIMESTAMP",
}
# What a technique is called in a sentence.
SUBJECTS = {"tautology": "condition", "union_query": "report field", "piggy_backed": "maintenance action", "error_based": "database diagnostic", "boolean_blind": "validation result", "time_blind": "response timing check"}
# Declared types, as whole names, by how their values are written in SQL.
NUMERIC_TYPES = ("int", "integer", "double", "float", "real", "numeric", "decimal", "bigint", "smallint", "tinyint")
TEXT_TYPES = ("varchar", "char", "text", "nvarchar", "nchar", "clob", "blob", "string")
TEMPORAL_TYPES = ("date", "datetime", "timestamp", "time")
# Expected types that a placeholder's own name tells.
NAMED_TYPES = {"int": "integer", "float": "float", "hex": "hex", "time": "time", "date": "date", "character": "character"}
# Expected types by context. All patterns of a rule must be in the text; @ stands for the
# placeholder. Patterns with (?i) ignore case; rules are tried in order, ``system`` is for $sysInfo$, ``stored`` for others.
ANY_CONTEXT = (
    ((r"(?i)(extractvalue|updatexml)\s*\(", r"(?i)concat\s*\([^)]*@"), "integer"),
    ((r"(?i)GTID_(SUBSET|SUBTRACT)\s*\(\s*\(?@",), "integer"),
    ((r"(?i)(SUBSTR|SUBSTRING|LEFT|RIGHT|MID)\s*\(\s*\(?@",), "string"),
    ((r"(?i)ASCII\s*\(\s*(SUBSTR|SUBSTRING|LEFT|RIGHT|MID)?\s*\(?@",), "string"),
    ((r"(?i)LENGTH\s*\(\s*@",), "string"),
    ((r"(?i)@\s*\)?\s*LIKE",), "string"),
    ((r"(?i)@\s*\)?\s*REGEXP",), "string"),
)
TECHNIQUE_CONTEXTS = (
    (("error",), (
        ((r"(?i)CAST\s*\(\s*\(?@",), "string"),
        ((r"(?i)CONVERT\s*\(\s*\(?@",), "string"),
        ((r"(?i)(SQRT|LOG|LOG2|LOG10|LN|MOD|EXP|POW|POWER)\s*\(\s*\(?@",), "string"),
        ((r"@\s*\)?\s*[><=!]+\s*\$int\$",), "string"),
        ((r"@\s*\)?\s*[><=!]+\s*\d+",), "string"),
        ((r"(?i)GTID_(SUBSET|SUBTRACT)",), "integer"),
        ((r"(?i)(TO_DAYS|FROM_DAYS|YEAR|MONTH|DAY|HOUR|MINUTE|SECOND|WEEKDAY|DAYOFWEEK)\s*\(\s*\(?@",), "integer"),
        ((r"(?i)(DATE|TIME)\s*\(\s*\(?@",), "string"),
        ((r"(?i)(extractvalue|updatexml)",), "integer"),
    ), "string"),
    (("tautolog",), (
        ((r"@\s*\)?\s*[><=]+\s*\d+",), {"system": "integer", "stored": "number"}),
        ((r"@\s*\)?\s*[><=]+\s*\$int\$",), {"system": "integer", "stored": "number"}),
        ((r"(?i)@\s*\)?\s*BETWEEN",), {"system": "integer", "stored": "number"}),
    ), "all"),
    (("inference", "boolean", "time"), (
        ((r"@\s*\)?\s*[><=!]+\s*(\d+|\$int\$)",), {"system": "integer"}),
        ((r"(?i)IF\s*\(\s*\(?@",), {"system": "integer"}),
    ), "string"),
    (("union", "piggy"), (), "all"),
)


def technique(text: Column) -> Column:
    """The first technique whose pattern the text has; ``unknown`` for none."""
    has = lambda pattern: text.rlike(f"(?i){pattern}")
    return (
        F.when(~has(HINT), UNKNOWN)
        .when(has(STACKED), "piggy_backed")
        .when(has(TIMING), "time_blind")
        .when(has(UNION), "union_query")
        .when(has(ERRORS), "error_based")
        .when(has("AND") & has(EXTRACTORS), "boolean_blind")
        .when(has(QUOTED_LOGIC), "tautology")
        .otherwise(UNKNOWN)
    )


def scope(text: Column) -> Column:
    return F.when(text.rlike(TABLE_REFERENCE), "tsr").when(text.contains(SYSTEM_REFERENCE), "scr").otherwise("lor")


def identified(text: Column, technique_given: Column, scope_given: Column) -> dict[str, Column]:
    """Valid metadata wins (``unknown`` is valid), else the cascades."""
    return {
        "technique": F.when(technique_given.isin(*TECHNIQUES, UNKNOWN), technique_given).otherwise(technique(text)),
        "reference_scope": F.when(scope_given.isin(*SCOPES, UNKNOWN), scope_given).otherwise(scope(text)),
    }


def single_line_safe(text: Column) -> Column:
    """Not blank, one line, no comment marker; false for null."""
    return F.coalesce(text.rlike("\\S") & ~text.rlike("[\n\r#]|--"), F.lit(False))


def has_comment_marker(text: Column) -> Column:
    return text.contains("--") | text.contains("#")


def comment_state_violation(state: Column, requires: Column, core: Column, payload: Column, note: Column, prefix: Column) -> Column:
    """Code of the first rule of the three-state contract that a row breaks; null if none."""
    has_note, known_prefix = F.coalesce(F.trim(note), F.lit("")) != "", F.coalesce(prefix.isin(*COMMENT_PREFIXES), F.lit(False))
    return (
        F.when(requires.isNull(), "delimiter_flag_missing")
        .when(has_comment_marker(core), "marker_in_core")
        .when((state == "no_comment") & requires, "no_comment_needs_no_delimiter")
        .when((state == "no_comment") & (has_comment_marker(payload) | has_note), "no_comment_has_comment")
        .when(state.isin("clean_comment", "cepp") & ~requires, "delimiter_required")
        .when((state == "cepp") & ~has_note, "note_missing")
        .when((state == "cepp") & ~single_line_safe(note), "note_not_one_line")
        .when(state.isin("clean_comment", "cepp") & ~known_prefix, "prefix_unknown")
        .when((state == "clean_comment") & ((payload != F.concat(core, prefix)) | has_note), "clean_comment_not_exact")
        .when((state == "cepp") & (payload != F.concat(core, prefix, note)), "note_not_after_prefix")
        .when(~state.isin("no_comment", "clean_comment", "cepp") | state.isNull(), "state_unknown")
    )


def difficulty(scope_: Column, state: Column) -> Column:
    return F.when(scope_ == "lor", "simple").when(scope_ == "scr", "medium").when(state == "cepp", "hard").otherwise("medium")


def placeholders(text: Column) -> Column:
    """Names between dollar signs, in order."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))


def placeholder_parts(name: Column) -> dict[str, Column]:
    """kind, table_id, column_id of a placeholder name; prefixes count, numbers that are absent are null."""
    table = F.regexp_extract(name, r"^(?:table_|column_t|sample_t)(\d+)", 1)
    column = F.regexp_extract(name, r"^(?:column|sample)_t\d+_(\d+)", 1)
    number = lambda c: F.when(c != "", c.cast("int"))
    kind = F.when(name.rlike(r"^table_\d+"), "table").when(name.rlike(r"^column_t\d+_\d+"), "column").when(name.rlike(r"^sample_t\d+_\d+"), "sample").when(name == "sysInfo", "sysInfo").otherwise(name)
    return {"kind": kind, "table_id": number(table), "column_id": number(column)}


def aligned_types(types: Column, names: Column, fixed: tuple[str, ...]) -> Column:
    """Expected types of the names that aren't fixed: by place, padded with ``all``, cut to their number."""
    padded = F.slice(F.concat(F.coalesce(types, F.array().cast("array<string>")), F.array_repeat(F.lit("all"), F.size(names))), F.lit(1), F.size(names))
    pairs = F.filter(F.arrays_zip(names.alias("n"), padded.alias("t")), lambda p: ~p["n"].isin(*fixed))
    return F.transform(pairs, lambda p: p["t"])


def filled(text: Column, values: Column) -> Column:
    """text with its placeholders exchanged for values, by place; a placeholder without a value stays."""
    parts = F.split(text, r"\$\w+\$")
    marks = F.regexp_extract_all(text, F.lit(r"\$\w+\$"), F.lit(0))
    put = F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(marks), F.coalesce(F.get(values, i), F.get(marks, i))).otherwise("")))
    return F.array_join(put, "")


def sql_literal(value: Column, kind: Column) -> Column:
    """A value as SQL text by its declared type (exact names): numbers bare, temporal and text quoted, null and ``NULL`` as NULL.

    A value of other types that has nothing but digits, points and hyphens is bare too.
    """
    low = F.lower(kind)
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    looks = F.translate(value, ".-", "").rlike(r"^\d+$")
    return (
        F.when(value.isNull() | (value == "NULL"), "NULL")
        .when(low.isin(*NUMERIC_TYPES), value)
        .when(low.isin(*TEMPORAL_TYPES), F.concat(F.lit("'"), value, F.lit("'")))
        .when(looks & ~F.coalesce(low.isin(*TEXT_TYPES), F.lit(False)), value)
        .otherwise(quoted)
    )


def marker_inserted(sql: Column, payload: Column) -> Column:
    """sql with each ``$$`` exchanged for the payload; null without one.

    If a quote follows the first marker the payload goes in whole, else without its first character.
    """
    at = F.instr(sql, "$$")
    in_string = F.substr(sql, at + 2, F.lit(1)) == "'"
    return F.when(at > 0, F.replace(sql, F.lit("$$"), F.when(in_string, payload).otherwise(F.substr(payload, F.lit(2)))))


def before_comment(sql: Column, prefix: Column) -> Column:
    """What stands before the first prefix; all of it if the prefix is null or absent."""
    at = F.instr(sql, prefix)
    return F.when(prefix.isNull() | (at == 0), sql).otherwise(F.substr(sql, F.lit(1), at - 1))


def balance(text: Column) -> Column:
    """Struct (balanced, position, message): brackets nest outside quotes, quotes close, a backslash hides the next character.

    A fold over the characters; a character whose predecessor is a backslash never counts.
    """
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("quote"), F.lit(False).alias("hidden"), F.lit(0).alias("bad"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        plain, outside = ~s["hidden"], s["quote"] == ""
        is_quote = c.isin("'", '"', "`")
        opens, closes = c.isin("(", "[", "{"), c.isin(")", "]", "}")
        mate = F.translate(c, ")]}", "([{")
        top = F.substring(s["open"], -1, 1)
        at = s["at"] + 1
        quote = F.when(plain & is_quote & outside, c).when(plain & (c == s["quote"]), "").otherwise(s["quote"])
        counts = plain & outside
        stack = F.when(counts & opens, F.concat(s["open"], c)).when(counts & closes & (top == mate), F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).otherwise(s["open"])
        bad = F.when((s["bad"] == 0) & counts & closes & (top != mate), at).otherwise(s["bad"])
        return F.struct(stack.alias("open"), quote.alias("quote"), (c == "\\").alias("hidden"), bad.alias("bad"), at.alias("at"))

    end = F.aggregate(F.split(text, ""), start, step)
    return F.transform(
        F.array(end),
        lambda e: F.struct(
            ((e["bad"] == 0) & (e["open"] == "") & (e["quote"] == "")).alias("balanced"),
            F.when(e["bad"] > 0, e["bad"] - 1).alias("position"),
            F.when(e["bad"] > 0, "unexpected closing").when(e["quote"] != "", "quote left open").when(e["open"] != "", "bracket left open").otherwise("ok").alias("message"),
        ),
    )[0]


def contextual_sentence(text: Column, technique_: Column, stop: tuple[str, ...]) -> Column:
    """A plain sentence on the last identifier that is no stop word, else on the technique's subject."""
    names = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_]*)"), F.lit(1)), lambda x: ~F.upper(x).isin(*stop))
    subject = F.lit("database operation")
    for name, what in SUBJECTS.items():
        subject = F.when(technique_ == name, what).otherwise(subject)
    named = F.concat(F.replace(F.element_at(names, -1), F.lit("_"), F.lit(" ")), F.lit(" operation"))
    return F.concat(F.lit("Validate the requested "), F.when(F.size(names) > 0, named).otherwise(subject), F.lit(" for the current query."))


def cleaned_output(text: Column, prefixes: tuple[str, ...]) -> Column:
    """Generated text without white space around it, one known prefix, code fences; the first line that isn't blank."""
    x = F.regexp_replace(text, r"^\s+|\s+$", "")
    cut = x
    for p in reversed(prefixes):
        cut = F.when(F.lower(x).startswith(p.lower()), F.regexp_replace(F.substr(x, F.lit(len(p) + 1)), r"^\s+|\s+$", "")).otherwise(cut)
    bare = F.regexp_replace(cut, r"```\w*", "")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.coalesce(F.get(lines, 0), F.lit(""))


def is_core_reference(name: Column) -> Column:
    return name.rlike("table|column|sysInfo")


def placeholders_kept(old: Column, new: Column, scope_: Column) -> Column:
    """Whether a rewritten text keeps the core placeholders; scope ``tsr`` may arrange them anew but needs one."""
    had = F.array_distinct(F.filter(placeholders(old), is_core_reference))
    have = F.array_distinct(F.filter(placeholders(new), is_core_reference))
    return F.when(F.size(had) == 0, True).when(scope_ == "tsr", F.size(have) > 0).otherwise(F.size(F.array_except(had, have)) == 0)


def scope_kept(new: Column, scope_: Column) -> Column:
    """lor has no placeholder; scr has no table reference; tsr isn't down to system references alone."""
    names = placeholders(new)
    tables = F.exists(names, lambda n: n.rlike("^(table_|column_t|sample_t)"))
    system = F.array_contains(names, "sysInfo")
    return F.when(scope_ == "lor", F.size(names) == 0).when(scope_ == "scr", ~tables).when(scope_ == "tsr", tables | ~system).otherwise(True)


def parens_even(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\(")) == F.regexp_count(text, F.lit(r"\)"))


def technique_kept(old: Column, new_text: Column) -> Column:
    """Whether the text still reads as its technique; unknown passes, tautology and boolean_blind go for each other."""
    new = technique(new_text)
    pair = ("tautology", "boolean_blind")
    return (new == UNKNOWN) | (old == UNKNOWN) | (new == old) | (old.isin(*pair) & new.isin(*pair))


def rejection(old: Column, new: Column, technique_: Column, scope_: Column) -> Column:
    """Code of the first check that a rewritten text fails; null if it passes all."""
    return (
        F.when(new.isNull() | ~new.rlike("\\S"), "empty")
        .when(new.rlike("[\n\r]"), "multiline")
        .when(~placeholders_kept(old, new, scope_), "placeholder")
        .when(~scope_kept(new, scope_), "scope")
        .when(has_comment_marker(new), "comment")
        .when(~parens_even(new), "paren")
        .when(~technique_kept(technique_, new), "technique")
    )


def type_list(text: Column, n: Column) -> Column:
    """A JSON array of types from text: the whole, else its first bracketed part; unknown types and gaps are ``all``, n in all."""
    whole = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    part = F.from_json(F.regexp_extract(text, r"(\[[\s\S]*?\])", 1), "array<string>", {"mode": "PERMISSIVE"})
    found = F.transform(F.coalesce(whole, part, F.array().cast("array<string>")), lambda t: F.when(F.lower(F.trim(t)).isin(*EXPECTED_TYPES), F.lower(F.trim(t))).otherwise("all"))
    return F.slice(F.concat(found, F.array_repeat(F.lit("all"), n)), F.lit(1), n)


def guessed_type(text: Column, name: Column, technique_: Column) -> Column:
    """Expected type of the placeholder ``$name$`` in a text: by its name, else by what stands around it and the technique.

    What stands around any of its occurrences counts for all of them.
    """
    mark = F.concat(F.lit("\\$"), name, F.lit("\\$"))

    def told(rules, default: str | None) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for patterns, kinds in rules:
            fits = F.lit(True)
            for p in patterns:
                before, *after = p.split("@")
                fits = fits & (F.rlike(text, F.concat(F.lit(before), mark, F.lit(after[0]))) if after else text.rlike(p))
            for who, kind in (kinds.items() if isinstance(kinds, dict) else (("any", kinds),)):
                system = name.contains("sysInfo")
                out = out.when(fits & {"any": F.lit(True), "system": system, "stored": ~system}[who], kind)
        return out.otherwise(default)

    low, by_technique = F.lower(F.coalesce(technique_, F.lit(""))), F.when(F.lit(False), F.lit(None).cast("string"))
    for parts, rules, default in TECHNIQUE_CONTEXTS:
        named = F.lit(False)
        for part in parts:
            named = named | low.contains(part)
        by_technique = by_technique.when(named, told(rules, default))
    out = F.when(name.rlike(r"^table(_\d+)?$"), "table")
    for own, kind in NAMED_TYPES.items():
        out = out.when(name == own, kind)
    context = (name == "sysInfo") | name.rlike(r"^(column|sample)_t\d+_\d+$") | (name == "sample")
    return out.when(context, F.coalesce(told(ANY_CONTEXT, None), by_technique, F.lit("all"))).otherwise("all")


def answer(text: Column) -> Column:
    """The label in generated text: in an answer tag, else anywhere, else the first word as it is."""
    x = F.regexp_replace(text, r"^\s+|\s+$", "")
    tagged = x.rlike(r"(?is)<answer>\s*(.*?)\s*</answer>")
    inner = F.lower(F.regexp_replace(F.regexp_extract(x, r"(?is)<answer>\s*(.*?)\s*</answer>", 1), r"^\s+|\s+$", ""))

    def told(t: Column) -> Column:
        return F.when(t.contains("not malicious") | t.contains("is benign"), "benign").when(t.contains("malicious"), "malicious").when(t.contains("benign"), "benign")

    first = F.regexp_extract(x, r"^(\S*)", 1)
    return F.when(tagged, F.coalesce(told(inner), inner)).otherwise(F.coalesce(told(F.lower(x)), first))


def ground_truth(messages: Column) -> Column:
    """The first assistant turn, trimmed and lower-cased; empty if there is none."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.coalesce(F.lower(F.regexp_replace(F.get(said, 0)["content"], r"^\s+|\s+$", "")), F.lit(""))


def ddl_type(declared: Column) -> Column:
    """The standard name of a declared type: the first known part in order, else the type in upper case; VARCHAR for none."""
    low = F.lower(declared)
    out = F.when(declared.isNull() | (declared == ""), "VARCHAR")
    for part, name in TYPE_NAMES.items():
        out = out.when(low.contains(part), name)
    return out.otherwise(F.upper(declared))


def run_id_valid(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def sha256_valid(text: Column) -> Column:
    return text.rlike(r"^[0-9a-f]{64}$")


def byte_size(text: Column) -> Column:
    """Bytes of a number with an optional K, M, G or T; null for anything else."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)\s*[KMGTkmgt]?\s*$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"([KMGTkmgt])\s*$", 1))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return number * F.pow(F.lit(1024.0), power)


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{{ name }}`` exchanged for columns, whose own braces stay; null values are empty, unknown names stay."""
    parts = re.split(r"(\{\{\s*\w+\s*\}\})", template)
    name = lambda p: p.strip("{} \t\n")
    put = lambda k, p: F.coalesce(values[name(p)].cast("string"), F.lit("")) if k % 2 and name(p) in values else F.lit(p)
    return F.concat(*[put(k, p) for k, p in enumerate(parts)])


#: What to vary in a text of each technique.
GUIDANCE = {
    "tautology": "Vary the comparison that always holds, its operands and its operators.",
    "union_query": "Vary the columns asked for, their number and how the second query is joined on.",
    "piggy_backed": "Vary the statement that follows and what separates it.",
    "error_based": "Vary the function that is made to fail and its arguments.",
    "boolean_blind": "Vary the condition that is asked and the part of the value that it looks at.",
    "time_blind": "Vary what delays the answer and the condition it hangs on.",
}


def guidance(technique_: Column, texts: dict[str, str] = GUIDANCE, default: str = "tautology") -> Column:
    """The guidance of a technique; of the default one for any other, unknown or null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in texts.items():
        out = out.when(technique_ == name, text)
    return out.otherwise(texts[default])
