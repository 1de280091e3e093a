"""What the operators of this subpackage share: work tables, text keys, word dictionaries."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
import zlib
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for work tables: ``spark.checkpoint.dir`` where the cluster names one.

    Where it is unset a session on one machine (local tests) gets a checkpoint folder of its own; on a
    cluster it is refused, since executors can't read the driver's folders.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        kept = sc._jsc.sc().getCheckpointDir()
    return kept.get()


_scopes: list[str] = []


def session_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/corpusloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return "/".join([session_dir(spark), *_scopes, f"{tag}-{uuid.uuid4().hex}"])


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_work_tables(spark: SparkSession) -> None:
    """Delete the work tables of this session; results that still read them must have been written before."""
    drop_folder(spark, session_dir(spark))


@contextmanager
def work_tables(spark: SparkSession):
    """Work tables made inside are deleted at the end; what reads them must have been written by then."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = "/".join([session_dir(spark), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        drop_folder(spark, folder)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and return a reader of it: lineage ends, lost executors don't matter."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have yet, whatever case its columns are in."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_key(text: Column) -> Column:
    """With the id, it tells rows apart that share an id; rows equal in both are interchangeable."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, keepers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose (id, text key) is in keepers (columns ``id``, ``key``), each once.

    One shuffle of docs by (id, key) serves the semi-join and the removal of repeated rows.
    All columns of docs come back as they were.
    """
    key, n = fresh_name(docs, "__key"), fresh_name(docs, "__n")
    left = docs.withColumn(key, text_key(F.col(text_col)))
    right = keepers.select(F.col("id").alias("__k_id"), F.col("key").alias("__k_key")).distinct()
    hit = left.join(right, left[id_col].eqNullSafe(right["__k_id"]) & (left[key] == right["__k_key"]), "left_semi")
    w = Window.partitionBy(id_col, key).orderBy(key)
    return hit.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).select(*docs.columns)


#: A key with more rows than this is split; at most SPLIT_KEYS keys are (then the bound is higher), so a list of them can be broadcast.
SPLIT_ROWS, SPLIT_KEYS = 512, 100_000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows: str, by: Column, merge: bool = True) -> DataFrame:
    """left joined with right on keys (never null), which are unique in right; its column ``rows`` tells how many rows of left have each.

    The rows of a frequent key are dealt over several tasks, by a hash of ``by``; right's row goes to each of
    them. right should be a written table: it is read several times. With ``merge`` right is taken to grow
    with left, and both are shuffled at every size.
    """
    right = right.hint("merge") if merge else right
    total = right.agg(F.sum(rows).alias("n")).first()["n"] or 0
    most = max(SPLIT_ROWS, -(-total // SPLIT_KEYS))
    hot = right.where(F.col(rows) > most).select(*keys, F.ceil(F.col(rows) / most).cast("int").alias("__parts"))
    if hot.isEmpty():
        return left.join(right, keys)
    salt = F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int").alias("__salt")
    dealt = left.join(F.broadcast(hot), keys, "left").select(*left.columns, salt)
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > most, F.ceil(F.col(rows) / most)).otherwise(1).cast("int") - 1)))
    return dealt.join(spread, [*keys, "__salt"]).drop("__salt")


def slices(array: pa.Array, most_bytes: int = 1 << 20):
    """array in consecutive slices of about most_bytes of text, one row at least."""
    lens = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens, dtype=np.int64)
    at, n = 0, len(array)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield array.slice(at, to - at)
        at = to


def ragged_take(values: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the lists ``values[starts[p]:starts[p+1]]`` for each p of picks; also where each begins."""
    lens = (starts[1:] - starts[:-1])[picks]
    ends = np.cumsum(lens, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    begin = np.concatenate([[0], ends])
    at = np.arange(total, dtype=np.int64) + np.repeat(starts[:-1][picks] - begin[:-1], lens)
    return values[at], begin


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each text begins; a null text is empty."""
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]] if len(texts) else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and after-last byte of each word between separators, and where each text begins in the list of words."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    inside = inside[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    first[at[:-1][full]] = inside[at[:-1][full]]
    last[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII that is neither letter, digit, white space nor control.
MARKS = np.zeros(256, dtype=bool)
MARKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def without_end_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, with the marks at the end of a word that come after an ASCII letter as words of their own."""
    at, live = ends.copy(), np.arange(len(ends))
    while len(live):
        live = live[(at[live] > starts[live]) & MARKS[data[np.maximum(at[live], 1) - 1]]]
        at[live] -= 1
    cut = (at < ends) & (at > starts)
    cut[cut] = LETTERS[data[at[cut] - 1]]
    pick = np.repeat(np.arange(len(ends)), 1 + cut)
    second = np.concatenate([[False], pick[1:] == pick[:-1]])
    first = np.concatenate([pick[1:] == pick[:-1], [False]])
    return np.where(second, at[pick], starts[pick]), np.where(first, at[pick], ends[pick])


_kept: dict = {}


def kept(key, make):
    """make(), once in this Python worker: workers live on between tasks. What was kept under another key goes first."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    """For steps that keep nothing: what another step kept in this worker goes."""
    _kept.clear()


def crc32_of(ids: np.ndarray, at: np.ndarray) -> list[int]:
    """Unsigned CRC-32 of each list ids[at[i]:at[i+1]] as little-endian unsigned 32-bit integers."""
    ids = np.ascontiguousarray(ids).astype("<u4", copy=False)
    return [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def grown(x: np.ndarray) -> np.ndarray:
    """x with as much room again; memory is taken only when it is written to."""
    out = np.zeros((2 * len(x), *x.shape[1:]), dtype=x.dtype)
    out[: len(x)] = x
    return out


class WordTable:
    """Lists of 32-bit integers by word, each word told by its bytes; it lives as long as the Python worker.

    Words of up to 8 * WIDTH bytes stand as 64-bit numbers in a hash table that is searched for many words
    at once; longer ones in a dictionary. A table that holds ``most`` words is emptied before the next
    block, so memory stays bounded; it is a cache, and every result is the same without it.
    """

    WIDTH, BLOCK = 3, 1 << 17
    MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)

    def __init__(self, make, most: int = 3 << 19):
        #: ``make`` takes distinct words (bytes) and gives the list of each as bytes of 32-bit integers.
        self.make, self.most, self.bits = make, most, (2 * most - 1).bit_length()
        self.forget()

    def forget(self) -> None:
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = np.zeros((1024, self.WIDTH), dtype=np.uint64)
        self.size = np.zeros(1024, dtype=np.int32)
        self.starts = np.zeros(1025, dtype=np.int64)
        self.values = np.zeros(4096, dtype=np.int32)
        self.n, self.long = 0, {}

    def packed(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The first bytes of each word as numbers; data has 8 * WIDTH spare bytes at its end."""
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        out = np.zeros((len(starts), self.WIDTH), dtype=np.uint64)
        rows = np.arange(len(starts))
        for k in range(self.WIDTH):
            if k:
                rows = rows[lens[rows] > 8 * k]
            out[rows, k] = eight[starts[rows] + 8 * k] & self.MASKS[np.minimum(lens[rows] - 8 * k, 8)]
        return out

    def home(self, keys: np.ndarray, lens: np.ndarray) -> np.ndarray:
        h = lens.astype(np.uint64)
        for k in range(self.WIDTH):
            h = (h ^ keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for unknown ones."""
        out, live, at = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), self.home(keys, lens)
        while len(live):
            seen = self.slot[at]
            some = seen >= 0
            live, at, seen = live[some], at[some], seen[some]
            same = (self.size[seen] == lens[live]) & (self.keys[seen] == keys[live]).all(axis=1)
            out[live[same]] = seen[same]
            live, at = live[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, words: list[bytes]) -> None:
        """Put in distinct unknown words."""
        made, m = self.make(words), len(words)
        to = self.n + m
        while to > len(self.keys):
            self.keys, self.size = grown(self.keys), grown(self.size)
        while to >= len(self.starts):
            self.starts = grown(self.starts)
        ends = self.starts[self.n] + np.cumsum(np.fromiter(map(len, made), dtype=np.int64, count=m) // 4)
        while ends[-1] > len(self.values):
            self.values = grown(self.values)
        self.values[self.starts[self.n] : ends[-1]] = np.frombuffer(b"".join(made), dtype=np.int32)
        self.starts[self.n + 1 : to + 1] = ends
        lens = np.fromiter(map(len, words), dtype=np.int64, count=m)
        self.size[self.n : to] = lens
        at = np.cumsum(lens) - lens
        self.keys[self.n : to] = self.packed(np.frombuffer(b"".join(words) + bytes(8 * self.WIDTH), dtype=np.uint8), at, lens)
        number = np.arange(self.n, to)
        for i in np.flatnonzero(lens > 8 * self.WIDTH).tolist():
            self.long[words[i]] = self.n + i
        number = number[lens <= 8 * self.WIDTH]
        spot = self.home(self.keys[number], self.size[number])
        while len(number):
            free = self.slot[spot] < 0
            self.slot[spot[free]] = number[free]
            left = self.slot[spot] != number
            number, spot = number[left], (spot[left] + 1) & ((1 << self.bits) - 1)
        self.n = to

    def lists(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the words data[starts:ends], one after the other, and how long each is."""
        data = np.concatenate([data, np.zeros(8 * self.WIDTH, dtype=np.uint8)])
        values, sizes = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(starts), self.BLOCK):
            if self.n >= self.most:
                self.forget()
            a, b = starts[at : at + self.BLOCK], ends[at : at + self.BLOCK]
            lens = b - a
            keys = self.packed(data, a, lens)
            code = self.find(keys, lens)
            if self.long:
                for i in np.flatnonzero(lens > 8 * self.WIDTH).tolist():
                    code[i] = self.long.get(data[a[i] : b[i]].tobytes(), -1)
            miss = np.flatnonzero(code < 0)
            if len(miss):
                low = int(a[miss[0]])
                view = data[low : int(b[miss[-1]])].tobytes()
                words = [view[x:y] for x, y in zip((a[miss] - low).tolist(), (b[miss] - low).tolist())]
                new: dict[bytes, int] = {}
                code[miss] = [new.setdefault(w, self.n + len(new)) for w in words]
                self.add(list(new))
            taken, begin = ragged_take(self.values, self.starts, code)
            values.append(taken)
            sizes.append(np.diff(begin))
        return np.concatenate(values), np.concatenate(sizes)


#: Rows of one Arrow batch at most: two tasks of an executor hold a batch on both sides of the pipe each.
BATCH_ROWS = 1000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package's sources, once for each application, wherever the driver has them from."""
    app, package = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app in _shipped or not package.is_dir():
        return
    to = f"{tempfile.mkdtemp(prefix='corpusloom-')}/corpusloom.zip"
    with zipfile.ZipFile(to, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends BATCH_ROWS rows to Python at once, or fewer if it is set so, and its workers have this package."""
    ship_package(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return freed memory to the system; Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def on_arrow(ddl: str):
    """Make a function over iterators of Arrow arrays into one over columns; the UDF is built on each call, when a session is there.

    A filter on its result, such as a join's on its keys, would be moved before it and the step be run
    twice; called nondeterministic it runs once.
    """

    def made(fn):
        return lambda *cols: F.arrow_udf(fn, ddl).asNondeterministic()(*cols)

    return made
