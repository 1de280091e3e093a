"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is one Arrow batch of documents. Its words that can lie in a benchmark window at all (both
neighbours of each word pair occur side by side in the benchmark) form the indexed sequence; all other
words are separators, which no window holds, so nothing is lost. Every benchmark window is searched
backward through wavelet-tree ranks, its occurrences are located by sampled suffix positions, and the
spans found are merged for each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_name, give_back, kept, materialise, on_arrow, slices

WINDOW = 10
#: Benchmark items are searched in blocks of so many bytes of text, so what each task holds is bounded.
BLOCK_BYTES = 8 << 20
#: Texts with hits that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
SAMPLE = 8
#: Word characters after lower-casing: 0-9, a-z and everything outside ASCII; every other byte separates.
SEPARATE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(SEPARATE).split()


class WaveletTree:
    """Ranks of symbols 0 .. sigma - 1 in a sequence; one bit vector with running counts for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
            self.zeros.append(int((bit == 0).sum()))

    def rank(self, symbol: np.ndarray, to: np.ndarray) -> np.ndarray:
        """How often each symbol is in seq[:to]."""
        low, high = np.zeros_like(to), to
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.bits):
            before = self.ones[k][at]
            one = self.ones[k][at + 1] - before
            out = out * 2 + one
            at = np.where(one == 1, self.zeros[k] + before, at - before)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by doubling the compared length until all ranks differ."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        rank, step = new, step * 2
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Counts and places of symbol strings in a sequence (symbols from 1; 0 ends it)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = np.concatenate([seq, [0]])
        order = suffix_array(seq)
        self.n = len(seq)
        self.tree = WaveletTree(seq[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        kept = order % SAMPLE == 0
        self.sampled, self.rank_of, self.place = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of equally long patterns, one in a row."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text position of each suffix: step back to a sampled one."""
        at, out, steps = at.copy(), np.full(len(at), -1, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        live = np.arange(len(at))
        while len(live):
            hit = self.sampled[at[live]]
            done = live[hit]
            out[done] = self.place[self.rank_of[at[done]]] + steps[done]
            live = live[~hit]
            c = self.tree.access(at[live])
            at[live] = self.before[c] + self.tree.rank(c, at[live])
            steps[live] += 1
        return out


class Windows:
    """The distinct windows of a block of benchmark items, by length, and which items have them.

    All words of the block stand as codes in one row; a window is where it begins there.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.code: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        coded = [np.array([self.code.setdefault(w, len(self.code) + 2) for w in words_of(text)], dtype=np.int32) for _, text in items]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        self.seq = np.concatenate([*coded, np.zeros(0, dtype=np.int32)])
        begins = np.cumsum(sizes) - sizes
        self.sigma = len(self.code) + 2
        #: Of each length: where its windows begin, and the items of each (in a row, with where each window's begin).
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(window, s) for s in sizes.tolist() if s}):
            of = np.flatnonzero(np.minimum(window, sizes) == n)
            count = sizes[of] - n + 1
            owner = np.repeat(of, count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begins[owner]
            group = self.groups(at, n)
            order = np.lexsort((owner, group))
            pairs = np.stack([group[order], owner[order]])
            pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])]
            first = np.zeros(int(group.max()) + 1, dtype=np.int64)
            first[group] = at
            self.by_length[n] = first.astype(np.int32), pairs[1].astype(np.int32), np.searchsorted(pairs[0], np.arange(len(first) + 1)).astype(np.int32)
        self.shortest = min(self.by_length, default=0)
        inner = np.ones(len(self.seq), dtype=bool)
        inner[(begins + sizes - 1)[sizes > 0]] = False
        at = np.flatnonzero(inner)
        self.pairs = np.unique(self.seq[at].astype(np.int64) * self.sigma + self.seq[at + 1]) if len(at) else np.zeros(0, dtype=np.int64)

    def groups(self, at: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the distinct windows that begin at these places, by doubling the compared length."""
        group = np.unique(self.seq, return_inverse=True)[1].astype(np.int64)
        size = 1
        while size < n:
            step = min(size, n - size)
            far = np.minimum(np.arange(len(group)) + step, len(group) - 1)
            group = np.unique(group * (int(group.max()) + 1) + group[far], return_inverse=True)[1].astype(np.int64)
            size += step
        return np.unique(group[at], return_inverse=True)[1]

    def find(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """Of each document, the hit words and the items of the windows found."""
        get, sizes = self.code.get, [len(d) for d in docs]
        total = sum(sizes)
        ends = np.cumsum(sizes)
        seq = np.fromiter(map(get, chain.from_iterable(docs), repeat(1)), dtype=np.int64, count=total)
        cover = np.zeros(total + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        starts = ends - np.array(sizes, dtype=np.int64)
        keep = seq > 1
        if self.shortest > 1:
            pair = seq[:-1] * self.sigma + seq[1:]
            near = np.searchsorted(self.pairs, pair)
            known = (self.pairs[np.minimum(near, len(self.pairs) - 1)] == pair) if len(self.pairs) else np.zeros(len(pair), dtype=bool)
            known[ends[(ends > 0) & (ends < total)] - 1] = False
            keep &= np.concatenate([known, [False]])[:total] | np.concatenate([[False], known])[:total]
        # a separator stands after each run and each document
        spot = np.flatnonzero(keep)
        if len(spot) and self.by_length:
            doc = np.searchsorted(ends, spot, side="right")
            cut = np.concatenate([[True], (spot[1:] != spot[:-1] + 1) | (doc[1:] != doc[:-1])])
            if self.shortest > 1:
                cut[1:] |= ~known[spot[1:] - 1]
            run = np.cumsum(cut) - 1
            long = np.bincount(run) >= self.shortest
            spot, run = spot[long[run]], run[long[run]]
        if len(spot) and self.by_length:
            _, run = np.unique(run, return_inverse=True)
            at = np.arange(len(spot)) + run
            text = np.ones(at[-1] + 2, dtype=np.int64)
            text[at] = seq[spot]
            where = np.zeros(len(text), dtype=np.int64)
            where[at] = spot
            index = FMIndex(text, self.sigma)
            there = np.zeros(self.sigma, dtype=bool)
            there[text] = True
            for n, (first, owners, owner_at) in self.by_length.items():
                # a window with a word that the shard doesn't have is nowhere in it
                asked = np.arange(len(first))
                for k in range(n):
                    asked = asked[there[self.seq[first[asked] + k]]]
                low, high = index.search(self.seq[first[asked][:, None] + np.arange(n)].astype(np.int64))
                # a place begins one window of each length at most, so all places together are bounded by the shard
                sizes = high - low
                window = np.repeat(np.arange(len(sizes)), sizes)
                rank = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[window]
                begin = where[index.locate(rank)]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + n, -1)
                found = np.unique(np.searchsorted(ends, begin, side="right") * len(first) + asked[window])
                for d, p in zip((found // len(first)).tolist(), (found % len(first)).tolist()):
                    items.setdefault(d, set()).update(self.names[o] for o in owners[owner_at[p] : owner_at[p + 1]].tolist())
        hits = np.cumsum(cover[:-1]) > 0
        return [(np.flatnonzero(hits[a:b]), items.get(i, set())) for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist()))]


def spans(words: np.ndarray) -> list[dict[str, int]]:
    """Word numbers as merged spans [first, after)."""
    if not len(words):
        return []
    cut = np.flatnonzero(np.diff(words) > 1)
    return [{"first": int(a), "after": int(b) + 1} for a, b in zip(words[np.concatenate([[0], cut + 1])], words[np.concatenate([cut, [len(words) - 1]])])]


RESULT = "n_words:long,n_hit:long,items:array<string>,spans:array<struct<first:long,after:long>>"
FIELDS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))]


def windows_of(block, window: int) -> Windows:
    """block: a broadcast (name, items); it is built once in each worker, not in each task."""
    return kept(("windows", block.value[0], window), lambda: Windows(block.value[1], window))


def search_udf(block, window: int, cut: bool = False):
    """block: a broadcast (name, [(item, text)]); with cut, texts with hits come back without them as ``left``."""

    @F.arrow_udf(f"struct<{RESULT},left:string>" if cut else f"struct<{RESULT}>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = windows_of(block, window)
        for batch in batches:
            rows = []
            for shard in slices(batch):
                texts = shard.to_pylist()
                docs = [words_of(t) for t in texts]
                for t, d, (at, items) in zip(texts, docs, windows.find(docs)):
                    found = spans(at)
                    rows.append({"n_words": len(d), "n_hit": len(at), "items": sorted(items), "spans": found})
                    if cut:
                        rows[-1]["left"] = cut_spans(t, found) if found else None
            yield pa.array(rows, type=pa.struct([*FIELDS, ("left", pa.string())] if cut else FIELDS))
            give_back()

    # a filter on the result would be moved before it, and the step be run twice
    return search.asNondeterministic()


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int | None = None):
    """Blocks of (id as string, text), streamed to the driver one partition at a time; empty items have no window."""
    most = BLOCK_BYTES if block_bytes is None else block_bytes
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator():
        if size and size + len(row["text"]) > most:
            yield block
            block, size = [], 0
        block.append((row["id"], row["text"]))
        size += len(row["text"]) + 16
    yield block


def two_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2")]


def merged_spans(all_: Column) -> Column:
    """Spans of one text from several searches, in order and joined where they touch or overlap."""
    none = F.array().cast("array<struct<first:bigint,after:bigint>>")

    def put(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["after"], s["after"]).alias("after"))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["after"] >= s["first"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(all_), none, put)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, into: str = "found", cut: bool = False) -> DataFrame:
    """docs with a column ``into`` (one of that name is replaced): struct of n_words, n_hit, items (sorted as strings), spans (hit words, merged).

    Words are runs of 0-9, a-z and characters outside ASCII after lower-casing A-Z. A window is ``window``
    consecutive words of an item, or all of an item with fewer. Null texts have no words and no hits;
    items without id or text are no items; repeated items count once, repeated rows of docs as often as
    they are there. The benchmark is a stated query set of any size: it is sent out in blocks of
    BLOCK_BYTES, one at a time. With more than one block, each is a pass over the texts that writes only
    the texts with hits, and these are put together by two hashes of the text. With ``cut`` the struct has
    a field ``left``: a text with hits without them, else null.
    """
    sc, rows = docs.sparkSession.sparkContext, bounded_batches(docs)
    send = lambda block: sc.broadcast((uuid.uuid4().hex, block))
    found, blocks = None, benchmark_blocks(benchmark, item_col, item_text_col)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return rows.withColumn(into, search_udf(send(block), window, cut)(F.col(text_col)))
    texts = rows.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    while block is not None:
        sent = send(block)
        hit = texts.withColumn("f", search_udf(sent, window)("text")).where("f.n_hit > 0").select(*two_keys(F.col("text")), "f.items", "f.spans")
        hit = materialise(hit.dropDuplicates(["__t1", "__t2"]), "hits")
        found, block, after = hit if found is None else found.unionByName(hit), after, next(blocks, None)
        sent.destroy()
    merged = found.groupBy("__t1", "__t2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"), merged_spans(F.flatten(F.collect_list("spans"))).alias("__spans"))
    t1, t2, items, spans_ = (fresh_name(docs, c) for c in ("__t1", "__t2", "__items", "__spans"))
    merged = materialise(merged.select(F.col("__t1").alias(t1), F.col("__t2").alias(t2), F.col("__items").alias(items), F.col("__spans").alias(spans_)), "merged")
    left = rows.withColumns(dict(zip((t1, t2), two_keys(F.col(text_col)))))
    left = left.join(F.broadcast(merged) if merged.count() <= BROADCAST_ROWS else merged, [t1, t2], "left")
    n_hit = F.aggregate(spans_, F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    n_words = F.coalesce(F.regexp_count(text_col, F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")), F.lit(0)).cast("long")
    whole = F.struct(n_words.alias("n_words"), F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), none(F.col(items), "array<string>").alias("items"), none(F.col(spans_), "array<struct<first:bigint,after:bigint>>").alias("spans"))
    if cut:
        left = left.withColumn(into, whole)
        whole = F.col(into).withField("left", F.when(F.col(f"{into}.n_hit") > 0, cut_udf(F.col(text_col), F.col(f"{into}.spans"))))
    return left.withColumn(into, whole).select(*docs.columns if into in docs.columns else (*docs.columns, into))


def cut_spans(text: str, out: list[dict[str, int]]) -> str:
    """text without the words of the spans and what lies between them; the rest stays as it is, trimmed."""
    data = text.encode()
    marks = np.frombuffer(data.translate(SEPARATE), dtype=np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for s in out:
        kept.append(data[at : first[s["first"]]])
        at = after[s["after"] - 1]
    kept.append(data[at:])
    return b"".join(kept).decode().strip()


@on_arrow("string")
def cut_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, outs in batches:
        yield pa.array([cut_spans(t, o) if t is not None and o else t for t, o in zip(texts.to_pylist(), outs.to_pylist())], type=pa.string())


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every benchmark passage cut out of its texts; a text that had nothing else goes.

    Texts without a hit stay as they are, null and empty ones too. All columns come back; n_chars_col,
    where docs has it, is counted anew for texts that were cut.
    """
    found, cut = fresh_name(docs, "__found"), fresh_name(docs, "__cut")
    hit = find_contamination(docs, benchmark, text_col, into=found, cut=True).withColumn(cut, F.col(f"{found}.left"))
    kept = hit.where(F.col(cut).isNull() | F.col(cut).rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
    new = {text_col: F.coalesce(cut, text_col)}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.when(F.col(cut).isNotNull(), F.char_length(cut).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(n_chars_col))
    return kept.withColumns(new).select(*docs.columns)


def digests(found: DataFrame, column: str = "found") -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated in place of the struct."""
    f = lambda name: F.col(f"{column}.{name}")
    return found.withColumns({"n_words": f("n_words"), "n_hit": f("n_hit"), "n_items": F.size(f("items")).cast("long"), "items_sha256": F.sha2(F.array_join(f("items"), ","), 256), "contaminated": f("n_hit") > 0}).drop(column)
