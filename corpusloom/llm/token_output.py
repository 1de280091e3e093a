"""Token-id files: Parquet with list columns, delta or dictionary encoding, small pages with indexes.

Rows are dealt by ranges of the document id and sorted, so files and pages hold narrow id ranges: a
reader of some documents skips the pages of all others by the column index, and a reader of counts never
touches the ids. Documents are encoded word by word with a bounded table of known words, since the
tokenizer's own pre-split never joins what a space or newline separates.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MARKS, WordTable, bounded_batches, crc32_of, give_back, kept, new_path, on_arrow, slices, text_bytes, without_end_marks, word_spans

#: The tokenizer's own pre-split never joins what these separate.
SEPARATORS = b" \n"
#: A-Z as a-z.
FOLDED = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
SCHEMA = "part int, local_start long, doc_id long, n_tokens long, ids array<int>"
#: Ids are few against their number: a dictionary; counters grow slowly: deltas (Parquet's version 2 writes them where no dictionary is).
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them without special tokens added."""

    JOINED = 500

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = WordTable(self.encode_words)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Two properties of the file that make the words fewer: case is folded, and marks are split from letters.
        self.folds = self.alike("The Of Zebra", "the of zebra")
        self.marks_apart = all(self.alike(f"word{m} x", f"word {m} x") for m in [*map(chr, np.flatnonzero(MARKS)), '."', "',", "):", "!!!"])

    def alike(self, a: str, b: str) -> bool:
        return self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(b, add_special_tokens=False).ids

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Many words are one text with a newline between them; the places of the tokens tell the words apart."""
        out, step = [], self.JOINED
        parts = [[w.decode() for w in words[at : at + step]] for at in range(0, len(words), step)]
        for part, found in zip(parts, self.tokenizer.encode_batch(["\n".join(p) for p in parts], add_special_tokens=False)):
            ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
            spots = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found.ids))
            cuts = (4 * np.searchsorted(spots, ends)).tolist()
            ids = array("i", found.ids).tobytes()
            out += [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]
        return out

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin; end_id follows each text."""
        data, begin = text_bytes(texts)
        folded = FOLDED[data]
        held = folded.tobytes()
        plain = not any(x in held for x in self.special)  # special tokens are told before case is folded, marks and all
        if plain and self.folds:
            data = folded
        first, after, _ = word_spans(data, begin, SEPARATORS)
        if plain and self.marks_apart:
            first, after = without_end_marks(data, first, after)
        ids, sizes = self.words.lists(data, first, after)
        at = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(first, begin)]
        if end_id is not None:
            n = len(texts)
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(n + 1)
        return ids.astype(np.int32), at


def write_tokens(docs: DataFrame, tokenizer: str, to: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write files under ``to`` in ascending id order; null texts are empty.

    Columns: part, local_start (ids before the document in its part), doc_id, n_tokens, ids. Parts follow
    each other in id order; rows that share an id stand together, a null id first. Columns of docs besides
    the two are not read. An empty table gives a folder without rows.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, start = kept(("tokens", tokenizer), lambda: Encoder(tokenizer)), TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                ids, at = enc.encode(texts, end_id)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(start + at[:-1]), batch.column(0).slice(done, len(n)), pa.array(n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                    names=["part", "local_start", "doc_id", "n_tokens", "ids"],
                )
                start += int(at[-1])
                done += len(n)
            give_back()

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(over, SCHEMA).write.options(**WRITER).parquet(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of files of write_tokens.

    The parts' totals (a row for each part) come from two narrow columns; no id is read for them.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


@on_arrow("long")
def crc32_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        at = batch.offsets.to_numpy()
        yield pa.array(crc32_of(batch.flatten().to_numpy(zero_copy_only=False), at - at[0]), type=pa.int64())


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    to = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, to, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, to).select("doc_id", "start", "n_tokens", crc32_udf("ids").alias("ids_crc32"))
