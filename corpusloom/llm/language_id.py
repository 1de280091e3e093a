"""Language identification of spans: script ranges, per-word scores, Viterbi with a switching penalty.

Each word's script leaves only the languages that were seen in that script. A word's score for a language
is the summed log probability of its character n-grams (hashed into a fixed number of slots). Viterbi over
a text's words, with a penalty for each change of language, labels spans; the text gets the language that
labels most of its letters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bounded_batches, drop_kept, fresh_name, give_back, kept, slices, text_bytes, word_spans

#: n-grams are hashed into so many slots; with many languages into fewer, so that the model has ENTRIES numbers at most.
SLOTS, ENTRIES = 1 << 16, 1 << 23
NGRAMS = (1, 2, 3)
#: So many labelled texts of each language are expected in the sample that the model is fitted on.
SAMPLE_PER_LANGUAGE = 4000
#: Bytes of text that are labelled at once, with up to 8 languages; fewer with more.
SLICE = 1 << 20
#: So many words are scored at once.
BLOCK = 16_384
PENALTY = 6.0
#: Words of a text that are searched one after the other; the pieces of a long text are searched at once.
PIECE = 256
#: A language counts as written in a script if so large a share of its letters is.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

# First code points of Unicode blocks, and the script of the letters from there to the next one.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"), (0x3100, "other"),
    (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0xFF66, "Kana"), (0xFFA0, "other"),
    (0x20000, "Han"), (0x30000, "other"),
]
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_CODES = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased words: all n-gram slots, where each word's begin, each word's script and letters."""
    padded = [f" {w} " for w in words]
    marks = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    ends = np.cumsum(lens)
    word = np.repeat(np.arange(len(words)), lens)
    slots, owners, h = [], [], np.zeros(len(marks), dtype=np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(marks) - n + 1] * np.uint64(0x100000001B3) + marks[n - 1 :] + np.uint64(n)
        if n in NGRAMS:
            same = word[: len(h)] == word[n - 1 :]
            if n == 1:
                same = same & (marks != 32)
            x = h[same] * np.uint64(0x9E3779B97F4A7C15)
            slots.append((x >> np.uint64(48)).astype(np.int64))
            owners.append(word[: len(h)][same])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words) + 1))
    letters = marks != 32
    script = np.zeros(len(words), dtype=np.int64)
    of = SCRIPT_CODES[np.searchsorted(SCRIPT_STARTS, marks.astype(np.int64), side="right") - 1]
    # a word's script is that of its last letter: marks and loans before it don't count
    script[lens > 2] = of[(ends - 2)[lens > 2]]
    return np.concatenate(slots)[order], starts, script, np.bincount(word[letters], minlength=len(words))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # slots x languages
    allowed: np.ndarray  # scripts x languages
    penalty: float = PENALTY
    name: str = ""  # tells models apart

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of raw tokens: scores by language (n x languages) and numbers of letters."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        script, letters = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for at in range(0, len(words), BLOCK):  # a word has several n-grams, each with a row of numbers: not all at once
            part = slice(at, at + BLOCK)
            slots, starts, script[part], letters[part] = features([" ".join(NOT_LETTERS.split(w.lower())).strip() if LETTER.search(w) else "" for w in words[part]])
            out[part] = np.add.reduceat(self.logs[slots >> (16 - (len(self.logs) - 1).bit_length())], starts[:-1], axis=0)
        some = self.allowed[script].any(axis=1)
        out[some] = np.where(self.allowed[script[some]], out[some], -1e6)
        out[~some | (letters == 0)] = 0
        return out - out.max(axis=1, keepdims=True, initial=-np.inf), letters

    def words(self) -> WordTable:
        """Letters and scores of the words seen by this worker, which are scored once."""
        most = max(1024, min(1 << 19, (1 << 24) // (len(self.languages) + 1)))
        return kept(("languages", self.name), lambda: WordTable(self.rows, most))

    def rows(self, words: list[bytes]) -> list[bytes]:
        """Of each word its letters, then its scores, as 32-bit numbers."""
        scores, letters = self.scores([w.decode() for w in words])
        table = np.concatenate([letters.astype(np.int32)[:, None], scores.view(np.int32)], axis=1)
        data, size = table.tobytes(), 4 * table.shape[1]
        return [data[at : at + size] for at in range(0, len(data), size)]

    def label(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each text the language of each token, and the letters that each language labels (n x languages)."""
        data, begin = text_bytes(texts)
        first, after, at = word_spans(data, begin, b" \n")
        rows = self.words().lists(data, first, after)[0].reshape(len(first), len(self.languages) + 1)
        useful = rows[:, 0] > 0
        kept, rows = np.concatenate([[0], np.cumsum(useful)])[at], rows[useful]
        path = viterbi(np.ascontiguousarray(rows[:, 1:]).view(np.float32), np.arange(len(rows)), kept, self.penalty)
        share = np.zeros((len(at) - 1, len(self.languages)))
        np.add.at(share, (np.repeat(np.arange(len(at) - 1), np.diff(kept)), path), rows[:, 0])
        return [path[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())], share


def forward(emit: np.ndarray, codes: np.ndarray, at: np.ndarray, lens: np.ndarray, state: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lanes a step at a time; a lane is emit[codes[at[i]:at[i]+lens[i]]] after a state of its own.

    The states after each lane's last word, where each word's language came from, and where each lane begins there.
    """
    order = np.argsort(-lens, kind="stable")
    sizes, spot, s_all = lens[order], at[order], state[order]
    store = np.cumsum(sizes) - sizes
    k, m = emit.shape[1], len(lens)
    own, lanes = np.arange(k, dtype=np.int16), np.arange(m)
    came = np.zeros((int(sizes.sum()), k), dtype=np.int16)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # of each step, the lanes longer than it
    for t in range(int(sizes[0])):
        m = active[t]
        s = s_all[:m]
        best = s.argmax(axis=1)
        jump = s[lanes[:m], best] - penalty
        switch = jump[:, None] > s
        came[store[:m] + t] = np.where(switch, best[:, None].astype(np.int16), own)
        s_all[:m] = np.where(switch, jump[:, None], s) + emit[codes[spot[:m] + t]]
    back = np.argsort(order)
    return s_all[back], came, store[back]


def viterbi(emit: np.ndarray, codes: np.ndarray, starts: np.ndarray, penalty: float, piece: int = PIECE) -> np.ndarray:
    """The best path of each sequence codes[starts[i]:starts[i+1]].

    All sequences are searched at once, and long ones in pieces at once: a piece but the first is searched
    after each language that the word before it can have, and the pieces are put together at the end.
    """
    k, path = emit.shape[1], np.zeros(len(codes), dtype=np.int16)
    if not len(codes):
        return path
    lens = np.diff(starts)
    size = piece if k <= 16 else int(lens.max())
    count = -(-lens // size)
    text = np.repeat(np.arange(len(lens)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at, long = starts[:-1][text] + nth * size, np.minimum(size, lens[text] - nth * size)
    lane_of = np.concatenate([[0], np.cumsum(np.where(nth == 0, 1, k))])  # of each piece, its first lane
    of = np.repeat(np.arange(len(text)), np.diff(lane_of))
    before = np.arange(len(of)) - lane_of[of]
    state = np.where(before[:, None] == np.arange(k), 0.0, -np.inf).astype(np.float32)
    state[nth[of] == 0] = 0
    ended, came, store = forward(emit, codes, at[of], long[of], state, penalty)
    # from the last piece of each text back: the language that it ends with, and the one before its first word
    end, lane = np.zeros(len(text), dtype=np.int64), lane_of[:-1].copy()
    last = np.flatnonzero(np.concatenate([nth[1:] == 0, [True]]))
    end[last] = ended[lane[last]].argmax(axis=1)
    for p in last[nth[last] > 0].tolist():
        first = p - nth[p]
        sums, froms = ended[lane[first]], []
        for q in range(first + 1, p + 1):
            through = sums[:, None] + ended[lane_of[q] : lane_of[q] + k]
            froms.append(through.argmax(axis=0))
            sums = through.max(axis=0)
        now = int(sums.argmax())
        for q in range(p, first, -1):
            end[q], now = now, int(froms[q - first - 1][now])
            lane[q] = lane_of[q] + now
        end[first] = now
    order = np.argsort(-long, kind="stable")
    sizes, spot, kept, now = long[order], at[order], store[lane[order]], end[order].astype(np.int16)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = active[t]
        path[spot[:m] + t] = now[:m]
        now[:m] = came[kept[:m] + t, now[:m]]
    return path


def fit(docs: DataFrame, text_col: str, label_col: str, id_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from labelled rows that aren't held out; None if there are none.

    Labels are counted over all rows; n-grams over a sample, chosen by a hash of the id, of about
    per_language texts of each language. What reaches the driver is a row for each label and at most ENTRIES
    counts: beyond ENTRIES / SLOTS languages each has fewer slots.
    """
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    number = {c: i for i, c in enumerate(languages)}
    size = SLOTS
    while size > 256 and size * len(languages) > ENTRIES:
        size //= 2
    shift = (SLOTS // size).bit_length() - 1
    known = docs.sparkSession.createDataFrame([(c, i, per_language / counts[c]) for c, i in number.items()], "lang string, number int, share double")
    sample = rows.join(F.broadcast(known), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(0), 1 << 18):
                codes, scripts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for text, lang in zip(texts, batch.column(1).slice(at, len(texts)).to_pylist()):
                    words = [w for w in NOT_LETTERS.split(text.as_py().lower()) if LETTER.search(w)]
                    if words:
                        slots, _, script, letters = features(words)
                        codes.append((slots >> shift) * len(languages) + lang)
                        scripts.append(np.repeat(script, letters) * len(languages) + lang)
                at += len(texts)
                for kind, found in (("slot", codes), ("script", scripts)):
                    code, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(code), type=pa.string()), pa.array(code), pa.array(n)], names=["kind", "code", "n"])
            give_back()

    summed = sample.select("text", "number").mapInArrow(count, "kind string, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    kind, code, n = (summed.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "code", "n"))
    table, scripts = np.full((size, len(languages)), 0.1), np.zeros((len(SCRIPT_NAMES), len(languages)))
    is_slot = kind == "slot"
    table.reshape(-1)[code[is_slot].astype(np.int64)] += n[is_slot]
    scripts.reshape(-1)[code[~is_slot].astype(np.int64)] = n[~is_slot]
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)), name=uuid.uuid4().hex)


RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))])


def predict_udf(shared, spans: bool):
    """shared: a broadcast Model, or one of None."""

    @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<lang:string,words:long>>>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            rows = []
            for texts in slices(batch, SLICE if model is None else max(1 << 16, SLICE // max(1, len(model.languages) // 8))):
                if model is None:
                    rows += [{"lang": UNKNOWN, "score": 0.0, "spans": []}] * len(texts)
                    continue
                paths, share = model.label(texts)
                best, total = share.argmax(axis=1), share.sum(axis=1)
                for i, path in enumerate(paths):
                    if not total[i]:
                        rows.append({"lang": UNKNOWN, "score": 0.0, "spans": []})
                        continue
                    found = []
                    if spans:
                        cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
                        found = [{"lang": model.languages[path[a]], "words": int(b - a)} for a, b in zip(cut[:-1], cut[1:])]
                    rows.append({"lang": model.languages[best[i]], "score": float(share[i, best[i]] / total[i]), "spans": found})
            yield pa.array(rows, type=RESULT)
            give_back()

    # a filter on the result would be moved before it, and the step be run twice
    return predict.asNondeterministic()


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", into: str = "language", spans: bool = True) -> DataFrame:
    """docs with a struct column: lang, score (the share of the letters that it labels), spans (lang, words, in order).

    Of languages that label as many letters the first in alphabetical order wins. Texts that are null or have no letter get ``und``, score 0 and no spans, and so does every text if
    there was nothing to learn from. All rows and columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return bounded_batches(docs).withColumn(into, predict_udf(shared, spans)(F.col(text_col)))


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learnt from the labelled rows that aren't held out.

    A null label or text teaches nothing; a null id is never held out. Repeated rows count as often as
    they are there. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = identify(rows, fit(docs, text_col, label_col, id_col, per_language), "text", "found", spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """docs whose language is told, with that language where the label is null; all columns come back.

    Those with ``und`` go: null texts and texts without a letter. A label that is there stays as it is.
    """
    into = fresh_name(docs, "__language")
    found = identify(docs, fit(docs, text_col, label_col, id_col), text_col, into, spans=False).where(F.col(f"{into}.lang") != UNKNOWN)
    return found.withColumn(label_col, F.coalesce(F.col(label_col), F.col(f"{into}.lang"))).select(*docs.columns)
