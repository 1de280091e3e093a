"""SimHash near-duplicates over a Gray-order hierarchical index.

Distinct fingerprints are dealt into buckets of some thousands by masked bit patterns. Inside a bucket they
are sorted by Gray rank, so that neighbours share long bit patterns; runs of them form leaves and runs of
leaves form upper nodes, each holding the bits that all below agree on. The bucket is joined with itself from
the top down: differences on the bits that two nodes share are added up, and both groups are dropped as soon
as the sum passes the bound, or when they are known to be in one component already.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop_kept, give_back, join_unique, keep_rows, materialise, ragged_take, text_key
from .components import connected_components

SEED = 42
#: About so many fingerprints share a bucket; one with more than SPLIT_BUCKET is split over several tasks.
BUCKET_ROWS, SPLIT_BUCKET = 1 << 13, 1 << 16
#: Keys that are split may be broadcast up to so many.
BROADCAST_ROWS = 1 << 20
#: For each byte, its bits as the bytes of a 64-bit lane: sums of up to 255 lanes don't overflow.
LANES = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles of a text, repeats included; none for no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(starts))


def majority(h: np.ndarray) -> np.uint64:
    """A bit is 1 if set in over half of h. Memory is bounded: long texts go in blocks."""
    n, counts = len(h), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255 * 256):
        block = h[at : at + 255 * 256]
        padded = np.zeros(-(-len(block) // 255) * 255, dtype=np.uint64)
        padded[: len(block)] = block
        lanes = LANES[padded.view(np.uint8).reshape(-1, 255, 8)].sum(axis=1, dtype=np.uint64)
        counts += lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]


def fingerprint_udf(shingle: int):
    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.uint64)
            for i, text in enumerate(batch):
                h = shingle_hashes(text.as_py(), shingle)
                if len(h):
                    out[i] = majority(h)
            yield pa.array(out.view(np.int64))
            give_back()

    return fingerprint


def gray_rank(x: Column) -> Column:
    """Where x stands in the Gray sequence, as 64 bits."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def index_masks(max_bits: int, n: int, rows: int = BUCKET_ROWS) -> list[int]:
    """Masks of 64 bits such that two patterns at most max_bits apart agree on one mask at least, and a bucket of n has about ``rows``.

    The word is cut into blocks; of any max_bits damaged ones the rest is whole. A mask has the leading bits
    of so many blocks as the rows ask for: no bit at all, and one index over everything, if they are few.
    """
    need = max(0, math.ceil(math.log2(max(n, 1) / rows)))
    if not need:
        return [0]
    for spare in range(1, 5):
        blocks = max_bits + spare
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        each = [list(range(a, b)) for a, b in itertools.pairwise(edges)]
        chosen = [sum(c, []) for c in itertools.combinations(each, spare)]
        if min(map(len, chosen)) >= need or spare == 4:
            return [sum(1 << b for b in bits[:need]) for bits in chosen]
    raise AssertionError


class Index:
    """Fingerprints of one bucket in Gray order, as a tree; joins up what is within max_bits.

    Runs of LEAF fingerprints are leaves, FAN nodes make a node above. A node holds the bits that all below
    it share and their values. Pairs of nodes are searched from the top: the differences on the bits that
    both share are added up, counting each bit once on the way down, and a pair is dropped with all below it
    as soon as the sum passes the bound, or when both sides are known to be in one component.
    """

    LEAF, FAN, TOP_ROWS = 8, 4, 2048

    def __init__(self, fps: np.ndarray, max_bits: int, pairs: bool = False):
        self.fps, self.most, self.n = fps, max_bits, len(fps)
        self.parent = np.arange(self.n)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # from the leaves up: shared bits, their values, first rows
        ones, zeros, cuts = fps, ~fps, np.arange(self.n)
        step = self.LEAF
        while True:
            at = np.arange(0, len(ones), step)
            ones, zeros, cuts = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at), cuts[at]
            self.levels.append((ones | zeros, ones, cuts))
            if len(ones) == 1:
                break
            step = self.FAN
        #: Pairs of nodes looked at, those dropped with all below them, and pairs of fingerprints compared.
        self.tested = self.pruned = self.compared = 0
        #: Where asked for, the pairs that joined two components, each within the bound: a spanning forest.
        self.forest: list[np.ndarray] | None = [] if pairs else None

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            over = self.parent[up]
            if np.array_equal(over, up):
                break
            up = over
        self.parent[at] = up
        return up

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j = i[apart], j[apart]
            high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            np.minimum.at(self.parent, high, low)
            if self.forest is not None:
                won = np.flatnonzero(self.parent[high] == low)
                won = won[np.unique(high[won], return_index=True)[1]]
                self.forest.append(np.stack([i[won], j[won]], axis=1))

    def labels(self) -> list[np.ndarray]:
        """Of each node of each level its one component, or -1."""
        own, out = self.roots(np.arange(self.n)), []
        for _, _, cuts in self.levels:
            low, high = np.minimum.reduceat(own, cuts), np.maximum.reduceat(own, cuts)
            out.append(np.where(low == high, low, -1))
        return out

    def down(self, pairs: tuple[np.ndarray, np.ndarray], level: int, labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the level above -> those of this level that can hold a link.

        A child shares all bits that its parent does, so the sum on its bits is its parents' sum and what the new bits add.
        """
        bits, value, _ = self.levels[level]
        a, b = (x * np.int32(self.FAN) for x in pairs)
        k = np.arange(self.FAN, dtype=np.int32)
        left, right = (a[:, None] + np.repeat(k, self.FAN)).reshape(-1), (b[:, None] + np.tile(k, self.FAN)).reshape(-1)
        real = left <= right
        real &= right < len(bits)
        left, right = left[real], right[real]
        fits = np.bitwise_count((value[left] ^ value[right]) & bits[left] & bits[right]) <= self.most
        self.tested += len(fits)
        if (labels[level] >= 0).any():
            mine = labels[level][left]
            fits &= (mine != labels[level][right]) | (mine < 0)
        left, right = left[fits], right[fits]
        self.pruned += len(fits) - len(left)
        return left, right

    def links(self) -> np.ndarray:
        """Of each member of a component, the component's first member; -1 for that one and for single ones."""
        n, fps = self.n, self.fps
        leaves = np.concatenate([fps, np.repeat(fps[-1:], -n % self.LEAF)]).reshape(-1, self.LEAF)
        for lag in range(1, min(self.LEAF, n)):  # neighbours first: dense groups are one component early
            near = np.flatnonzero(np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= self.most)
            self.unite(near, near + lag)
        top = len(self.levels) - 1
        labels = self.labels()
        pairs = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32)
        level, width = top, self.LEAF * self.FAN**top
        while level and width > self.TOP_ROWS:
            level, width = level - 1, width // self.FAN
            pairs = self.down(pairs, level, labels)
        for at in range(0, len(pairs[0]), 16):
            labels = self.labels()
            part, k = (pairs[0][at : at + 16], pairs[1][at : at + 16]), level
            while k:
                k -= 1
                part = self.down(part, k, labels)
            for lo in range(0, len(part[0]), 1 << 12):
                a, b = (x[lo : lo + (1 << 12)] for x in part)
                near = np.bitwise_count(leaves[a][:, :, None] ^ leaves[b][:, None, :]) <= self.most
                self.compared += near.size
                hit = np.flatnonzero(near)
                pair, p, q = hit // self.LEAF**2, hit // self.LEAF % self.LEAF, hit % self.LEAF
                left, right = a[pair] * self.LEAF + p, b[pair] * self.LEAF + q
                real = (left < n) & (right < n) & (left != right)
                self.unite(left[real], right[real])
        first = self.roots(np.arange(n))
        return np.where(first == np.arange(n), -1, first)


def bucket_links(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, max_bits: int, pairs: bool = False) -> np.ndarray:
    """Links (node, node) that connect what is connected in each bucket; rows come sorted by key and Gray rank.

    They lead to the first of each component or, with ``pairs``, are pairs within max_bits themselves.
    """
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    out = [np.zeros((0, 2), dtype=np.int64)]
    for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
        if end > at + 1:
            index = Index(fps[at:end], max_bits, pairs)
            to = index.links()
            i = np.flatnonzero(to >= 0)
            out += [nodes[at + x] for x in index.forest] if pairs else [np.stack([nodes[at + i], nodes[at + to[i]]], axis=1)]
    return np.concatenate(out)


def links_of(max_bits: int, pairs: bool):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the bucket that may go on in the next batch

        def found(rows: np.ndarray) -> pa.RecordBatch:
            links = bucket_links(rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2]).view(np.uint64), max_bits, pairs)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            last = int(np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))[-1])
            if last:
                yield found(np.concatenate([*held, rows[:last]]))
                held = []
            elif held and held[-1][-1, 0] != rows[0, 0]:
                yield found(np.concatenate(held))
                held = []
            held.append(rows[last:])
        if held:
            yield found(np.concatenate(held))

    return over


def split_pairs(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """rows with a column ``task``: those of a key that has up to ``most`` rows share one, a larger key is split.

    Its rows are dealt into parts by a hash, and each pair of parts is a task of its own, so any two rows
    meet in a task and no task has more than about ``most``. Rows of split keys are repeated.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    # keys of more than ``most`` rows are few against the rows; the list is broadcast, checked
    large = materialise(sizes.select(key, F.ceil(2 * F.col("n") / most).cast("int").alias("__parts")), "large")
    if large.isEmpty():
        return rows.withColumn("task", F.col(key))
    n = large.count()
    told = rows.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, key, "left")
    part = F.pmod(F.xxhash64(F.lit("part"), by), F.col("__parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("__parts") - 1), lambda p: p != part)
    tasks = F.transform(others, lambda p: F.xxhash64(F.col(key), F.least(p, part), F.greatest(p, part)))
    return told.withColumn("task", F.explode(F.when(F.col("__parts").isNull(), F.array(F.col(key))).otherwise(tasks))).drop("__parts")


def node_links(nodes: DataFrame, max_bits: int, masks: list[int], pairs: bool = False) -> DataFrame:
    """nodes (node, w) -> links (a, b) that connect what links of max_bits or fewer between patterns of one bucket connect."""
    keys = [F.xxhash64(F.lit(t), F.col("w").bitwiseAND(F.lit(signed(mask)))) for t, mask in enumerate(masks)]
    rows = split_pairs(nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "w"), "key", "node", SPLIT_BUCKET)
    dealt = rows.select("task", "node", "w").repartition("task").sortWithinPartitions("task", gray_rank(F.col("w")), "w")
    return dealt.mapInArrow(links_of(max_bits, pairs), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row for each row of docs: id, key (of the text), fingerprint (64 bits), component_id.

    Two rows are linked if their fingerprints differ in max_bits or fewer bits; component_id is the
    smallest id that links reach. The search is exact: every such pair is connected.

    A null or wordless text has fingerprint zero and is linked like any other. A null id never becomes a
    component_id unless the whole component has none (then null). Repeated rows and ids come back as often
    as they are in docs. Other columns of docs are not read. An empty table gives no rows.
    """
    prints = materialise(bounded_batches(docs).select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), fingerprint_udf(shingle)(F.col(text_col)).alias("w")), "prints")
    nodes = materialise(prints.groupBy("w").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = connected_components(node_links(nodes, max_bits, index_masks(max_bits, nodes.count())))
    linked = materialise(nodes.join(labels, "node").select("node", "w", "n", "id", "label"), "linked")
    least = materialise(linked.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("fps")), "least")
    of = join_unique(linked, least, ["label"], "fps", F.col("node")).select("node", "component_id", F.lit(True).alias("in_component"))
    every = nodes.join(of, "node", "left").select("w", "n", F.when(F.col("in_component"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return join_unique(prints.withColumnRenamed("w", "fingerprint"), materialise(every, "labels").withColumnRenamed("w", "fingerprint"), ["fingerprint"], "n", F.col("id")).select("id", "key", "fingerprint", "component_id")


STAGE_SHINGLE = 5
#: Places in the lists of documents that one step of a search looks at.
STEP = 1 << 22
#: Of 16 shingles, those whose owners are counted over all texts: more than the fifth that near copies may differ in.
TRACKED = 5
#: A block of more sets than this is compared in parts, after a first look at so many pivots.
SPLIT_SETS, PIVOTS = 256, 8
#: Fingerprints of near copies at the stage's bound differ in 9.7 bits in the mean; they are searched up to STAGE_BITS,
#: beyond STAGE_ROWS of them in buckets of about so many, by STAGE_MASKS masks of drawn bits.
STAGE_BITS, STAGE_ROWS, STAGE_MASKS = 12, 1 << 10, 24


def shingle_set_udf(shingle: int):
    @F.arrow_udf("array<long>")
    def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_kept()
        for batch in batches:
            sets = [np.unique(shingle_hashes(text.as_py(), shingle)) for text in batch]
            ends = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in sets], out=ends[1:])
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)))
            give_back()

    return shingle_set


def set_print_udf():
    """The fingerprint of a set of shingles: a bit is 1 if set in over half of them."""

    @F.arrow_udf("long")
    def set_print(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([majority(x.values.to_numpy().view(np.uint64)) for x in batch], dtype=np.uint64).view(np.int64))
            give_back()

    return set_print


def drawn_masks(n: int) -> list[int]:
    """Masks of 64 bits, drawn by a fixed seed, so that a bucket of n patterns has about STAGE_ROWS; one index if they are few.

    A wide bound leaves no block of bits whole for sure, so patterns within it may miss each other in all buckets.
    """
    need = max(0, math.ceil(math.log2(max(n, 1) / STAGE_ROWS)))
    rng = np.random.default_rng(SEED)
    return [sum(1 << int(b) for b in rng.choice(64, need, replace=False)) for _ in range(STAGE_MASKS)] if need else [0]


def print_links(sets: DataFrame) -> DataFrame:
    """sets (node, set) -> (node, near): nodes that the Gray index finds within STAGE_BITS, enough to connect those of a bucket."""
    prints = materialise(bounded_batches(sets).select("node", set_print_udf()(F.col("set")).alias("w")), "set-prints")
    firsts = materialise(prints.groupBy("w").agg(F.min("node").alias("b"), F.count("*").alias("rows")), "set-nodes")
    same = join_unique(prints, firsts, ["w"], "rows", F.col("node")).where("node <> b").select(F.col("node").alias("a"), "b")
    found = node_links(firsts.select(F.col("b").alias("node"), "w"), STAGE_BITS, drawn_masks(firsts.count()), pairs=True)
    return same.unionByName(found).groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("near"))


def shares_enough(n: Column, m: Column, both: Column, least: Fraction) -> Column:
    return F.lit(least.denominator) * both >= F.lit(least.numerator) * (n + m - both)


def similar_sets(sizes: np.ndarray, values: np.ndarray, starts: np.ndarray, asks: np.ndarray, near: list[np.ndarray], least: Fraction) -> np.ndarray:
    """The first member of each set's component, linked where Jaccard >= least and one of the two asks; values need to hold only what sets share.

    ``near`` are the partners by fingerprint of each set; they are counted out first. If all ask, only those
    outside the largest component that they make still do: of two sets in different components one is.
    """
    n = len(sizes)
    _, codes = np.unique(values, return_inverse=True)
    owners = np.repeat(np.arange(n), np.diff(starts))[np.argsort(codes, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, partners in enumerate(near):
        for j in partners.tolist():
            a, b = root(i), root(j)
            if a != b:
                both = len(np.intersect1d(codes[starts[i] : starts[i + 1]], codes[starts[j] : starts[j + 1]], assume_unique=True))
                if least.denominator * both >= least.numerator * (sizes[i] + sizes[j] - both):
                    parent[max(a, b)] = min(a, b)
    if asks.all():
        of = np.array([root(i) for i in range(n)], dtype=np.int64)
        asks = of != np.bincount(of).argmax()
    for i in np.flatnonzero(asks).tolist():
        mine = codes[starts[i] : starts[i + 1]]
        steps = np.cumsum(begin[mine + 1] - begin[mine]) // STEP
        both = np.zeros(n, dtype=np.int64)
        for some in np.split(mine, np.flatnonzero(np.diff(steps)) + 1):
            both += np.bincount(ragged_take(owners, begin, some)[0], minlength=n)
        alike = least.denominator * both >= least.numerator * (sizes[i] + sizes - both)
        alike[i] = False
        for j in np.flatnonzero(alike).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], dtype=np.int64)


def components_of(least: Fraction):
    """Over rows (task, node, n, shared, asks, near) sorted by task: links (a, b) of each node to the first one of its component."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the task that may go on in the next batch

        def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
            column = column.combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()

        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts).combine_chunks()
            task, node, n, asks = (rows[c].to_numpy() for c in ("task", "node", "n", "asks"))
            (starts, values), (begin, partners) = lists(rows["shared"]), lists(rows["near"])
            cuts = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
            first = []
            for a, b in itertools.pairwise(cuts.tolist()):
                at = {x: i for i, x in enumerate(node[a:b].tolist())}
                near = [np.array([at[x] for x in partners[begin[i] : begin[i + 1]].tolist() if x in at], dtype=np.int64) for i in range(a, b)]
                first.append(node[a + similar_sets(n[a:b], values[starts[a] : starts[b]], starts[a : b + 1] - starts[a], asks[a:b], near, least)])
            first = np.concatenate(first)
            linked = first != node
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(first[linked])], names=["a", "b"])
            give_back()

        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0).to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))[-1])
            if last:
                yield from found([*held, batch.slice(0, last)])
                held = []
            elif held and held[-1].column(0)[0].as_py() != task[0]:
                yield from found(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from found(held)

    return over


def searched(rows: DataFrame, least: Fraction) -> DataFrame:
    """rows (task, node, n, shared, asks, near) -> links (a, b); each task is compared as a whole."""
    dealt = rows.select("task", "node", "n", "shared", "asks", "near").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(components_of(least), "a long, b long")


def large_block_links(rows: DataFrame, least: Fraction) -> DataFrame:
    """Links (a, b) that connect what is connected in blocks too large for one task; rows (block, node, n, shared, near).

    All rows are compared with two partners by fingerprint and a few pivots of their block, which joins up
    the copies of one text at the cost of the block's length. Only rows outside the component that most rows are in then ask the others,
    those of about their own number of shingles, in tasks of bounded parts of both sides.
    """
    pivots = [F.min_by(F.struct("node", "n", "shared"), F.xxhash64(F.lit(k), "node")).alias(f"p{k}") for k in range(PIVOTS)]
    chosen = materialise(rows.groupBy("block").agg(*pivots, F.count("*").alias("size")), "pivots")
    met = join_unique(rows, chosen, ["block"], "size", F.col("node"))
    near = [F.when(shares_enough(F.col("n"), F.col(f"p{k}.n"), F.size(F.array_intersect("shared", f"p{k}.shared")), least), F.col(f"p{k}.node")) for k in range(PIVOTS)]
    by_pivot = met.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array(*near))).alias("b")).where("b IS NOT NULL AND a <> b")
    asked = materialise(rows.select("block", F.col("node").alias("a"), F.explode(F.slice("near", 1, 2)).alias("b")), "partners")
    theirs = rows.select("block", F.col("node").alias("b"), F.col("n").alias("m"), F.col("shared").alias("theirs"))
    partners = materialise(asked.groupBy("block", "b").agg(F.count("*").alias("asked")).join(theirs, ["block", "b"]), "partner-sets")
    pairs = join_unique(asked, partners, ["block", "b"], "asked", F.col("a")).join(rows.select(F.col("node").alias("a"), "n", "shared"), "a")
    by_print = pairs.where(shares_enough(F.col("n"), F.col("m"), F.size(F.array_intersect("shared", "theirs")), least)).select("a", "b")
    links = materialise(by_pivot.unionByName(by_print), "first-links")
    labels = connected_components(links)
    told = materialise(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "told")
    main = told.groupBy("block", "label").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("label", "n").alias("main"), F.sum("n").alias("size"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(least.denominator / least.numerator)).cast("int")
    open_ = materialise(join_unique(told, materialise(main, "main"), ["block"], "size", F.col("node")).select("block", "node", "n", "shared", band.alias("band"), (F.col("label") != F.col("main")).alias("asks")), "open")
    # two similar sets are in one band or in neighbouring ones
    asking = open_.where("asks").select("block", "node", "n", "shared", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    units = open_.groupBy("block", "band").agg(F.count("*").alias("own")).join(asking.groupBy("block", "band").agg(F.count("*").alias("asked")), ["block", "band"])
    parts = lambda c: F.ceil(F.col(c) / SPLIT_SETS).cast("int")
    units = materialise(units.select("block", "band", "own", "asked", parts("own").alias("p"), parts("asked").alias("q")), "units")
    task = lambda i, j: F.xxhash64("block", "band", i, j)
    part = lambda c: F.pmod(F.xxhash64(F.lit("part"), "node"), F.col(c)).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = join_unique(open_, units, ["block", "band"], "own", F.col("node")).withColumn("task", F.explode(F.transform(upto("q"), lambda j: task(part("p"), j)))).withColumn("asks", F.lit(False))
    ask = join_unique(asking, units, ["block", "band"], "asked", F.col("node")).withColumn("task", F.explode(F.transform(upto("p"), lambda i: task(i, part("q"))))).withColumn("asks", F.lit(True))
    columns = ["task", "node", "n", "shared", "asks", F.array().cast("array<long>").alias("near")]
    return links.unionByName(searched(own.select(*columns).unionByName(ask.select(*columns)), least))


def similar_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """sets (node, set of distinct values) -> (node, label) of rows that have a partner; no pair is missed and each link is counted out.

    The Gray index searches the sets' fingerprints; the partners that it finds are counted out first. What is
    left is what fingerprints tell too coarsely: of a block, rows that are not in its largest component yet.

    Blocks: values are in order of how many rows hold them. Two sets at the similarity share a value among the
    first |x| - ceil(similarity |x|) + 1 of each, so rows whose first values are all their own have no
    partner. Rows that share such a value make up blocks (through the smallest row of each value, not as
    pairs), and a block's sets are compared by what they share with any row.
    """
    least = Fraction(str(similarity))
    spots = sets.select("node", F.size("set").cast("long").alias("n"), F.explode("set").alias("x"))
    counts = materialise(spots.groupBy("x").agg(F.count("*").alias("held")).where("held > 1"), "counts")
    held = join_unique(spots, counts, ["x"], "held", F.col("node"))
    shared = materialise(held.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "x"))).alias("by")), "shared")
    first = F.expr(f"cast(n - (({least.numerator} * n + {least.denominator - 1}) div {least.denominator}) + 1 - (n - size(by)) as int)")
    lists = shared.select("node", F.explode(F.slice("by", 1, F.greatest(first, F.lit(0)))).alias("v")).select("node", F.col("v.x").alias("x"))
    firsts = materialise(lists.groupBy("x").agg(F.min("node").alias("b"), F.count("*").alias("rows")).where("rows > 1"), "firsts")
    links = join_unique(lists, firsts, ["x"], "rows", F.col("node")).where("node <> b").select(F.col("node").alias("a"), "b")
    blocks = connected_components(links).select("node", F.col("label").alias("block"))
    near = F.coalesce("near", F.array().cast("array<long>")).alias("near")
    rows = materialise(shared.join(blocks, "node").join(print_links(sets), "node", "left").select("block", "node", "n", F.col("by.x").alias("shared"), near), "blocks")
    sizes = materialise(rows.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > SPLIT_SETS), "large")
    if sizes.isEmpty():
        found = searched(rows.select(F.col("block").alias("task"), "node", "n", "shared", F.lit(True).alias("asks"), "near"), least)
    else:
        # blocks over SPLIT_SETS rows are few against the rows
        told = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "block", "left")
        small = told.where("size IS NULL").select(F.col("block").alias("task"), "node", "n", "shared", F.lit(True).alias("asks"), "near")
        large = materialise(told.where("size IS NOT NULL").select("block", "node", "n", "shared", "near"), "large-blocks")
        found = searched(small, least).unionByName(large_block_links(large, least))
    return connected_components(found)


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the row with the smallest id (ties: smallest text key) stays.

    Texts are near copies if the sets of their five-word shingles (A-Z lower-cased, as 64-bit hashes) have
    at least the given Jaccard similarity. SimHash fingerprints of the sets are searched by the Gray index and
    what it finds is counted out; an exact search by common shingles then finds the pairs whose fingerprints
    are too far apart. So every such pair is found, and no other pair links. Texts without
    words are all alike: one stays. All columns come back; a row with a null id stays only in a component
    without other ids.
    """
    text = shingle_set_udf(STAGE_SHINGLE)(F.col(text_col))
    docs_ = bounded_batches(docs).select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col))
    tracked = F.filter("set", lambda x: x.bitwiseAND(F.lit(15)) < TRACKED)
    prints = materialise(docs_.select("id", "key", text.alias("set")).select("id", "key", F.size("set").cast("long").alias("n"), tracked.alias("tracked")).withColumn("node", F.monotonically_increasing_id()), "tracked")
    nodes = prints.groupBy("id", "key").agg(F.min("node").alias("node"), F.max("n").alias("n"))
    # a text with more shingles of its own than a partner may lack has no partner
    own = prints.select("node", F.explode("tracked").alias("x")).groupBy("x").agg(F.count("*").alias("held"), F.min("node").alias("node")).where("held = 1").groupBy("node").agg(F.count("*").alias("own"))
    least = Fraction(str(similarity))
    open_ = F.coalesce("own", F.lit(0)) <= F.expr(f"n - (({least.numerator} * n + {least.denominator - 1}) div {least.denominator})")
    told = materialise(nodes.join(own, "node", "left").select("node", "id", "key", "n", open_.alias("open")), "nodes")
    left = told.where("open AND n > 0").select("node", F.col("id").alias("o_id"), F.col("key").alias("o_key"))
    left = F.broadcast(left) if left.count() <= BROADCAST_ROWS else left
    sets = docs_.join(left, F.expr("id <=> o_id AND key = o_key")).select("node", text.alias("set")).dropDuplicates(["node"])
    labels = similar_rows(materialise(sets, "sets"), similarity)
    group = F.when(F.col("n") == 0, F.lit(-1)).otherwise(F.coalesce("label", "node")).alias("group")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    return keep_rows(docs, told.join(labels, "node", "left").groupBy(group).agg(best).select("best.id", "best.key"), id_col, text_col)
