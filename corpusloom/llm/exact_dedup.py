"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its normalised bytes read as a number in base R, modulo two primes, with the
length. Chunks are hashed on their own and put together by shifting: fp(A + B) = fp(A) * R^len(B) + fp(B).
Huge texts are cut into pieces that are hashed in parallel tasks. Rows with equal fingerprints are then
compared, chunk by chunk, with the row that would stay; what differs is told apart by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, drop_kept, join_unique, keep_rows, materialise, on_arrow, text_key

PRIMES = (2147483647, 2147483629)
BASE = (1_000_003, 998_244_353)
CHUNK = 4096
HUGE = 8 << 20
#: Of a group of equal fingerprints, so many rows at most are compared in one task.
GROUP_ROWS = 128
POWERS = np.stack([np.array([pow(r, CHUNK - 1 - i, p) for i in range(CHUNK)], dtype=np.uint64) for r, p in zip(BASE, PRIMES)], axis=1)
SHIFT = tuple(pow(r, CHUNK, p) for r, p in zip(BASE, PRIMES))
EMPTY = (0, 0, 0)


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of a text from those of its two parts, each (hash, hash, length)."""
    return (*((x * pow(r, b[2], p) + y) % p for x, y, r, p in zip(a, b, BASE, PRIMES)), a[2] + b[2])


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """(hash, hash, length): chunk hashes by one matrix product a block, then length-shifted sums."""
    h = [0, 0]
    n, view = len(data), np.frombuffer(data, dtype=np.uint8)
    head = n % CHUNK
    if head:
        h = [int(x) % p for x, p in zip(view[:head].astype(np.uint64) @ POWERS[CHUNK - head :], PRIMES)]
    for at in range(head, n, 64 * CHUNK):
        for row in view[at : at + 64 * CHUNK].reshape(-1, CHUNK).astype(np.uint64) @ POWERS:
            h = [(x * s + int(y)) % p for x, s, y, p in zip(h, SHIFT, row, PRIMES)]
    return h[0], h[1], n


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode().lower()


PARTS = "struct<h1:long,h2:long,len:long>"
TYPES = [("h1", pa.int64()), ("h2", pa.int64()), ("len", pa.int64())]


def parts_array(found: list[tuple[int, int, int]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([f[k] for f in found], type=t) for k, (_, t) in enumerate(TYPES)], names=[n for n, _ in TYPES])


@on_arrow(PARTS)
def prints_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    drop_kept()
    for batch in batches:
        yield parts_array([fingerprint(normal(t.as_py())) for t in batch])


@on_arrow("struct<h1:long,h2:long,len:long,sha:string>")
def prints_and_sha_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    drop_kept()
    for batch in batches:
        found, sha = [], []
        for t in batch:
            data = normal(t.as_py())
            found.append(fingerprint(data))
            sha.append(hashlib.sha256(data).hexdigest())
        parts = parts_array(found)
        yield pa.StructArray.from_arrays([*parts.flatten(), pa.array(sha, type=pa.string())], names=["h1", "h2", "len", "sha"])


@on_arrow(PARTS)
def fold_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of arrays of (no, h1, h2, len) in order of no."""
    for batch in batches:
        out = []
        for pieces in batch.to_pylist():
            whole = EMPTY
            for x in pieces:
                whole = combine(whole, (x["h1"], x["h2"], x["len"]))
            out.append(whole)
        yield parts_array(out)


def row_prints(docs: DataFrame, id_col: str, text_col: str, huge: int) -> DataFrame:
    """(id, key, h1, h2, len, sha) of each row; the pieces of huge texts are hashed in tasks of their own."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_huge = F.coalesce(F.octet_length("text"), F.lit(0)) > huge
    plain = rows.where(~is_huge).select("id", text_key(F.col("text")).alias("key"), prints_and_sha_of("text").alias("p")).select("id", "key", "p.*")
    # one row for each piece; the row's number holds its pieces together within this one plan
    cut = rows.where(is_huge).select("id", text_key(F.col("text")).alias("key"), F.sha2(ascii_lower(F.col("text")), 256).alias("sha"), F.monotonically_increasing_id().alias("row"), "text")
    spots = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / huge).cast("int"))
    pieces = cut.select("id", "key", "sha", "row", F.posexplode(F.transform(spots, lambda k: F.substring(F.col("text"), k * huge + 1, F.lit(huge)))).alias("no", "piece"))
    hashed = pieces.repartition("row", "no").select("id", "key", "sha", "row", "no", prints_of("piece").alias("p"))
    whole = hashed.groupBy("row").agg(F.first("id").alias("id"), F.first("key").alias("key"), F.first("sha").alias("sha"), F.sort_array(F.collect_list(F.struct("no", "p.h1", "p.h2", "p.len"))).alias("pieces"))
    big = whole.select("id", "key", fold_of("pieces").alias("p"), "sha").select("id", "key", "p.*", "sha")
    return plain.unionByName(big)


def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, len, salt), the row that stays first: (h1, h2, len, sha) of those that differ from it."""
    key, stays = None, b""
    for batch in batches:
        h1, h2, size, salt, _, text = batch.columns
        rows = []
        for at, now in enumerate(zip(h1.to_pylist(), h2.to_pylist(), size.to_pylist(), salt.to_pylist())):
            data = normal(text[at].as_py())
            if now != key:
                key, stays = now, data
            elif any(data[k : k + 16 * CHUNK] != stays[k : k + 16 * CHUNK] for k in range(0, max(len(data), len(stays)), 16 * CHUNK)):
                rows.append((*now[:3], hashlib.sha256(data).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()])], names=["h1", "h2", "len", "sha"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """One row for each row of docs: id, key (of the text), keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays (a null id is the smallest; of rows that share it, one). Exactly one row of
    each group is kept. Other columns of docs are not read. An empty table gives no rows.
    """
    prints = materialise(row_prints(bounded_batches(docs), id_col, text_col, huge).withColumn("row", F.monotonically_increasing_id()), "prints")
    same = ["h1", "h2", "len"]
    groups = materialise(prints.groupBy(*same).agg(F.count("*").alias("n"), F.max("id").alias("top")).where("n > 1"), "groups")
    # texts again, only of groups with more than one row; hot groups in several parts, each with the row that stays
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("p", prints_of("text")).select("id", "text", "p.*")
    member = join_unique(texts, groups, same, "n", F.col("id")).withColumn("parts", F.ceil(F.col("n") / GROUP_ROWS).cast("int"))
    stays = F.col("id").eqNullSafe(F.col("top"))
    salts = F.when(stays, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    dealt = member.select(*same, F.explode(salts).alias("salt"), (~stays).alias("later"), "text").repartition(*same, "salt").sortWithinPartitions(*same, "salt", "later")
    unlike = materialise(dealt.mapInArrow(differing, "h1 long, h2 long, len long, sha string").distinct(), "unlike")
    # usually no row at all: a class is a fingerprint, and what differs in spite of it is a class by SHA-256
    if unlike.isEmpty():
        classed = prints.withColumn("apart", F.lit(""))
    else:
        classed = materialise(prints.join(unlike.select(*same, "sha", F.col("sha").alias("apart")), [*same, "sha"], "left").withColumn("apart", F.coalesce("apart", F.lit(""))), "classes")
    best = materialise(classed.groupBy(*same, "apart").agg(F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", "row")).alias("best"), F.count("*").alias("group_size")), "best")
    found = join_unique(classed, best, [*same, "apart"], "group_size", F.col("row"))
    return found.select("id", "key", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts (see exact_duplicates); all columns come back."""
    found = exact_duplicates(docs, id_col, text_col)
    return keep_rows(docs, found.where("kept").select("id", "key"), id_col, text_col)
