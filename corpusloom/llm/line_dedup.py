"""Near-duplicate lines by a deletion-neighbourhood join. DataFrame functions only.

Lines are compared lower-cased, with runs of blanks as one space. Two lines are alike if they are equal, or
if both have LEAST characters or more, the same digits in a row, and differ in one character put in, taken
out or exchanged. So ``Yes`` and ``No``, ``Total 12`` and ``Total 13`` or two dates are never alike.

The neighbourhood of a line is the line without each one of its characters, as hashed keys; lines that are
alike share a key. A line is cut into blocks of BLOCK characters: a key is the hash of what lies before the
block, the block without the character, and the hash of what lies after it, so a key costs a block, not a
line. Of two lines that are alike one half is untouched: only lines that share a half with another line emit
keys, and only for the characters of the other half. Equal keys are joined through the earliest line of
each key, never as all pairs, and each join is verified by the edit distance of the two lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, materialise, text_key

BLANKS = " \t\x0b\f\r"
#: Shorter lines are alike only if they are equal.
LEAST = 16
BLOCK = 64


def line_array(text: Column) -> Column:
    """The lines of a text in the form in which they are compared."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), f"[{BLANKS}]+", " "), "\n"), lambda x: F.trim(x))


def full_lines(text: Column) -> Column:
    """The numbers of the lines that aren't blank."""
    numbers = F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(f"[^{BLANKS}]"), i))
    return F.filter(numbers, lambda i: i.isNotNull())


def half_keys(line: Column) -> Column:
    """Hashes of the two halves of a line (left, right), and of those that a line with one character less would have."""
    n = F.char_length(line)

    def keys(length: Column) -> list[Column]:
        left = F.floor(length / 2).cast("int")
        right = length - left
        return [F.xxhash64(F.lit("l"), length, F.substring(line, F.lit(1), left)), F.xxhash64(F.lit("r"), length, F.substring(line, n - right + 1, right))]

    return F.when(n < LEAST, F.array().cast("array<long>")).when(n == LEAST, F.array(*keys(n))).otherwise(F.array(*keys(n), *keys(n - 1)))


def neighbourhood(line: Column, left: Column, right: Column) -> Column:
    """Keys (kind, hash) of a line that shares its left or right half with another one.

    ``s``: a place and the line without its character (lines of one length that differ there); ``i``: the
    line without a character (to meet lines with one less); ``w``: the whole line, as it is met by the latter.
    """
    n, digits = F.char_length(line), F.regexp_replace(line, "[^0-9]+", "")
    middle = F.floor(n / 2).cast("int")
    # a shared left half leaves the characters after it, from the middle on; one place more for lines of other lengths
    first = F.when(right, F.lit(1)).otherwise(F.greatest(F.lit(1), middle))
    last = F.when(left, n).otherwise(F.least(n, middle + 1))
    block = lambda at: F.floor(at / BLOCK).cast("int")
    one = lambda kind, h: F.struct(F.lit(kind).alias("kind"), h.alias("hash"))

    def of_line(x: Column) -> Column:
        def around(b: Column, size: int) -> tuple[Column, Column, Column]:
            start = b * BLOCK
            return F.xxhash64(b, x["digits"], F.substring(line, F.lit(1), start)), F.substring(line, start + 1, F.lit(size)), F.xxhash64(F.substring(line, start + size + 1, x["n"]))

        def without_each(b: Column) -> Column:
            before, own, after = around(b, BLOCK)
            cut = lambda y, i: F.concat(F.substring(y["own"], F.lit(1), i - 1), F.substring(y["own"], i + 1, F.lit(BLOCK)))

            def keys(y: Column) -> Column:
                places = F.sequence(F.greatest(F.lit(1), x["first"] - b * BLOCK), F.least(F.char_length(y["own"]), x["last"] - b * BLOCK))
                pair = lambda i: F.array(one("s", F.xxhash64(F.lit("s"), y["before"], i, cut(y, i), y["after"])), one("i", F.xxhash64(F.lit("i"), y["before"], cut(y, i), y["after"])))
                return F.flatten(F.transform(places, pair))

            return held(F.struct(before.alias("before"), own.alias("own"), after.alias("after")), keys)

        def whole(b: Column) -> Column:
            before, own, after = around(b, BLOCK - 1)
            return one("w", F.xxhash64(F.lit("i"), before, own, after))

        return F.concat(F.flatten(F.transform(F.sequence(block(x["first"] - 1), block(x["last"] - 1)), without_each)), F.transform(F.sequence(block(x["first"] - 1), block(x["last"])), whole))

    return held(F.struct(n.alias("n"), F.xxhash64(digits).alias("digits"), first.alias("first"), last.alias("last")), of_line)


def held(value: Column, of) -> Column:
    """of(value), an array; the value is computed once, however often it is used in there."""
    return F.flatten(F.transform(F.array(value), of))


def one_apart(a: Column, b: Column) -> Column:
    """Whether two different strings differ in one character put in, taken out or exchanged. Linear in their length but for a logarithm."""
    n, m = F.char_length(a), F.char_length(b)
    steps = F.sequence(F.floor(F.log2(F.greatest(n, m))).cast("int"), F.lit(0), F.lit(-1))
    grown = lambda p, k: p + F.pow(F.lit(2), k).cast("int")
    # the length of the common beginning, bit by bit
    common = F.aggregate(steps, F.lit(0), lambda p, k: F.when(F.substring(a, F.lit(1), grown(p, k)) == F.substring(b, F.lit(1), grown(p, k)), grown(p, k)).otherwise(p))
    tail = lambda x, p, more: F.substring(x, p + 1 + more, n + m)
    same = F.transform(F.array(common), lambda p: F.when(n == m, tail(a, p, 1) == tail(b, p, 1)).when(n == m + 1, tail(a, p, 1) == tail(b, p, 0)).when(m == n + 1, tail(a, p, 0) == tail(b, p, 1)).otherwise(False))
    return F.element_at(same, 1)


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, nos): of each document that has some, the numbers of its lines that no earlier line is alike.

    Lines are in order of id (null first), then text key, then number. A line goes if any earlier line is
    alike, whether that one goes itself or not. Blank lines are no lines here. Rows of docs that share id
    and text are one document. Null and empty texts have no lines.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    lines = rows.select("id", "key", F.posexplode(line_array(F.col("text"))).alias("no", "line")).where("line <> ''")
    spot = F.struct("id", "key", "no")
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), spot.alias("spot"), half_keys(F.col("line")).alias("halves"))
    distinct = hashed.groupBy("h1", "h2").agg(F.min("spot").alias("spot"), F.first("halves").alias("halves"))
    distinct = materialise(distinct.select("spot", "halves", F.monotonically_increasing_id().alias("line")), "lines")
    halves = distinct.select("line", F.posexplode("halves").alias("side", "half"))
    shared = materialise(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "halves")
    sides = halves.join(shared, "half").groupBy("line").agg(F.bool_or(F.col("side") % 2 == 0).alias("left"), F.bool_or(F.col("side") % 2 == 1).alias("right"))
    # those lines themselves, from their documents
    wanted = distinct.join(sides, "line").groupBy(F.col("spot.id").alias("id"), F.col("spot.key").alias("key")).agg(F.collect_list(F.struct(F.col("spot.no").alias("no"), "line", "left", "right")).alias("wanted"))
    hit = rows.alias("t").join(wanted.alias("w"), F.expr("t.id <=> w.id AND t.key = w.key")).select("t.id", "t.key", "t.text", "wanted")
    picked = held(line_array(F.col("text")), lambda all_: F.transform("wanted", lambda w: w.withField("text", all_[w["no"]])))
    known = materialise(hit.select("id", "key", F.explode(picked).alias("x")).select("id", "key", "x.*").dropDuplicates(["line"]), "known")
    emitted = known.select("line", spot.alias("spot"), F.explode(neighbourhood(F.col("text"), F.col("left"), F.col("right"))).alias("v")).select("line", "spot", F.col("v.kind").alias("kind"), F.col("v.hash").alias("hash"))
    emitted = materialise(emitted, "keys")
    # of each key the earliest line, apart for whole lines: those are met by the others
    first = lambda x: F.min(F.when(x, F.struct("spot", "line")))
    is_whole = F.col("kind") == "w"
    keys = emitted.groupBy("hash").agg(F.count("*").alias("n"), first(is_whole).alias("whole"), first(~is_whole).alias("other")).where("n > 1")
    met = emitted.join(keys, "hash")
    by = F.when(is_whole | (F.col("kind") == "s"), F.col("other")).otherwise(F.col("whole"))
    pairs = met.select("line", "spot", by.alias("by")).where(F.col("by").isNotNull() & (F.col("by.spot") < F.col("spot"))).select("line", F.col("by.line").alias("by")).distinct()
    texts = known.select("line", "text", F.regexp_replace("text", "[^0-9]+", "").alias("digits"))
    checked = pairs.join(texts, "line").join(texts.select(F.col("line").alias("by"), F.col("text").alias("by_text"), F.col("digits").alias("by_digits")), "by")
    near = checked.where((F.col("digits") == F.col("by_digits")) & one_apart(F.col("text"), F.col("by_text"))).select("line").distinct()
    # of equal lines the first is left, unless a near one stands before it
    kept = distinct.select("line", "spot").join(near, "line", "left_anti")
    return kept.groupBy(F.col("spot.id").alias("id"), F.col("spot.key").alias("key")).agg(F.sort_array(F.collect_list("spot.no")).alias("nos"))


def with_dropped(docs: DataFrame, id_col: str, text_col: str, into: str) -> DataFrame:
    """docs with a column ``into``: the numbers of the lines that go, in order; null for a null text."""
    key, k_id, k_key, nos = (fresh_name(docs, c) for c in ("__key", "__k_id", "__k_key", "__nos"))
    kept = kept_lines(docs, id_col, text_col).select(F.col("id").alias(k_id), F.col("key").alias(k_key), F.col("nos").alias(nos))
    left = docs.withColumns({key: text_key(F.col(text_col)), into: full_lines(F.col(text_col))})
    joined = left.join(kept, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(key) == F.col(k_key)), "left")
    return joined.withColumn(into, F.array_except(into, F.coalesce(nos, F.array().cast("array<int>")))).select(*docs.columns, into)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that an earlier line is alike (see kept_lines); all rows and columns stay, a null text too."""
    gone = fresh_name(docs, "__gone")
    out = with_dropped(docs, id_col, text_col, gone)
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    return out.withColumn(text_col, F.when(F.size(gone) > 0, left).otherwise(F.col(text_col))).select(*docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (0 for null), n_dropped, dropped (their numbers from 0, in order, comma-joined)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = rows.withColumns({"n_lines": F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"), "key": text_key(F.col("text")), "nos": full_lines(F.col("text"))}).drop("text")
    kept = kept_lines(rows, "doc_id", "text")
    joined = key.alias("r").join(kept.alias("k"), F.expr("r.doc_id <=> k.id AND r.key = k.key"), "left")
    gone = F.coalesce(F.array_except("r.nos", F.coalesce("k.nos", F.array().cast("array<int>"))), F.array().cast("array<int>"))
    return joined.select("doc_id", F.when(F.col("r.nos").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), F.array_join(F.transform(gone, lambda x: x.cast("string")), ",").alias("dropped"))
