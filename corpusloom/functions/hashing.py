"""Hash-based numbers that stand in for random draws: the same in every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *key: Column) -> Column:
    """A number in (0, 1) from a seed and a key, by the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)


def fingerprint(text: Column) -> Column:
    """MD5 of the lower-cased text with every run of white space as one space, trimmed."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    return F.md5(F.lower(F.array_join(words, " ")).cast("binary"))


def canonical_json_sha256(columns: dict[str, Column]) -> Column:
    """SHA-256 of a flat JSON object with sorted keys, no spaces and explicit nulls."""
    record = F.struct(*[columns[k].alias(k) for k in sorted(columns)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def random_scalars(seed: int | str, *key: Column) -> dict[str, Column]:
    """Placeholder values by kind, each from a draw of its own."""
    u = lambda kind: uniform(seed, F.lit(kind), *key)
    whole = lambda kind, n: F.floor(u(kind) * n)
    # days from 2000-01-01 to 2025-12-31
    day = F.date_add(F.to_date(F.lit("2000-01-01")), whole("date", 9497).cast("int"))
    return {
        "time": F.format_string("%02d:%02d:%02d", whole("hour", 24), whole("minute", 60), whole("second", 60)),
        "date": F.date_format(day, "yyyy-MM-dd"),
        "hex": F.concat(F.lit("0x"), F.lower(F.hex(whole("hex", 65536).cast("long")))),
        "int": whole("int", 101).cast("string"),
        "float": F.format_string("%.2f", F.round(u("float") * 10, 2)),
        "character": F.chr(97 + whole("char", 26).cast("int")),
    }
