"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model's pieces are merged by rank (BPE), so the best path is not the one of the highest sum of
scores. It is still a shortest-memory lattice: every prefix of a text has one encoding, and its last
piece is the one piece that ends there and is compatible with the last piece of the prefix before it
(two pieces are compatible if their two alone encode to just them). The search keeps a backpointer for
each position of a window bounded by the longest piece. Whenever the paths from all positions that a
later piece can still start at meet in one boundary, the ids up to it are final and leave the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bounded_batches, crc32_of, fresh_name, give_back, kept, ragged_take, slices, text_bytes

SPACE = "▁"
#: Odd, so that hashes of different characters differ; pieces are short.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Positions that the search of many words keeps of each; words of more than LANE characters are streamed alone.
WINDOW, LANE = 64, 256
ONE, ALL = np.uint64(1), np.uint64(2**64 - 1)


def turned(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x as 64 bits, turned left."""
    by = by.astype(np.uint64) & np.uint64(63)
    return (x << by) | (x >> ((np.uint64(64) - by) & np.uint64(63)))


def highest_bit(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return np.bitwise_count(x).astype(np.int64) - 1


class Flags:
    """A bounded table of known answers by 64-bit key (0 and more), asked for many at once."""

    BITS = 20

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.key, self.flag, self.n = np.full(1 << self.BITS, -1, dtype=np.int64), np.zeros(1 << self.BITS, dtype=bool), 0

    def home(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * FACTOR
        return ((x ^ (x >> np.uint64(32))) * FACTOR >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ask(self, keys: np.ndarray) -> np.ndarray:
        """1, 0, or -1 for unknown."""
        out, live, at = np.full(len(keys), -1, dtype=np.int8), np.arange(len(keys)), self.home(keys)
        while len(live):
            seen = self.key[at]
            same = seen == keys[live]
            out[live[same]] = self.flag[at[same]]
            on = ~same & (seen >= 0)
            live, at = live[on], (at[on] + 1) & ((1 << self.BITS) - 1)
        return out

    def tell(self, keys: np.ndarray, flags: np.ndarray) -> None:
        """keys are distinct and unknown."""
        if self.n + len(keys) > 1 << (self.BITS - 1):
            self.clear()
        self.n += len(keys)
        at = self.home(keys)
        while len(keys):
            free = self.key[at] < 0
            self.key[at[free]], self.flag[at[free]] = keys[free], flags[free]
            on = self.key[at] != keys
            # of several that met in one place the last has it, with its own flag set again
            self.flag[at[~on]] = flags[~on]
            keys, flags, at = keys[on], flags[on], (at[on] + 1) & ((1 << self.BITS) - 1)


class Model:
    """Pieces, scores and ids of a SentencePiece BPE model with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        #: No piece goes on over a space, so words can be searched one by one.
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        data = [b""] * n
        for p, i in self.ids.items():
            data[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            data[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.byte_starts = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        #: The order of merging: a better score comes first.
        self.rank = {p: k for k, p in enumerate(sorted(self.ids, key=lambda p: -self.score[p]))}
        self.made_of: dict[str, tuple[str, str]] = {}
        self.known_steady: dict[str, bool] = {}
        #: Neighbouring characters within pieces; between all others every path has a boundary.
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.newline_apart = not any("\n" in p for p in self.ids)
        self.known: dict[tuple[str, str], bool] = {}
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.names = pieces
        #: Of the pieces of each length, hashes of their characters in order, and the ids.
        self.hashed = []
        for size in range(1, self.longest + 1):
            of = [p for p in self.ids if len(p) == size]
            marks = np.frombuffer("".join(of).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(-1, size)
            h = np.zeros(len(of), dtype=np.uint64)
            for k in range(size):
                h = h * FACTOR + marks[:, k]
            order = np.argsort(h)
            self.hashed.append((h[order], np.array([self.ids[p] for p in of], dtype=np.int64)[order]))
        self.pairs = Flags()
        self.units = WordTable(self.encode_units, 1 << 20)
        self.stems: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merge a short string: always the pair whose joined piece has the best score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge made this one last; None for a character, ("", "") for a piece that merging never makes."""
        found = self.made_of.get(piece)
        if found is None and len(piece) > 1:
            k = self.last_step(piece) if self.merged(piece) == [piece] else 0
            found = self.made_of[piece] = (piece[:k], piece[k:]) if k else ("", "")
        return found

    def steady(self, piece: str) -> bool:
        """Whether every part of a piece is made before it, and no two equal characters meet in it."""
        found = self.known_steady.get(piece)
        if found is None:
            parts = self.halves(piece)
            found = parts is None or (parts[0][-1] != parts[1][0] and all(len(p) == 1 or self.rank[p] < self.rank[piece] and self.steady(p) for p in parts))
            self.known_steady[piece] = found
        return found

    def last_step(self, piece: str) -> int:
        """Where the last merge of a piece joins its two parts."""
        parts = list(piece)
        while len(parts) > 2:
            pairs = [(self.score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.score]
            at = -max(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts[0])

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two, side by side, stay as they are; left "" asks for right alone.

        Both are taken apart from the boundary, the later made first; had the two ends that met at some
        time a better merge than the next one due, it would have crossed the boundary.
        """
        if self.halves(right) == ("", "") or left and self.halves(left) == ("", ""):
            return False
        if not left:
            return True
        if left[-1] == right[0] or not (self.steady(left) and self.steady(right)):
            return self.merged(left + right) == [left, right]
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < limit:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is not None and (b is None or rank[left] > rank[right]):
                limit, left = rank[left], a[1]
            elif b is not None:
                limit, right = rank[right] + 1, b[0]
            else:
                return True

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """compatible() of pairs of ids; -1 is the start."""
        key = (left + 1) * (1 << 32) + right
        told = self.pairs.ask(key)
        unknown = told < 0
        if unknown.any():
            new, back = np.unique(key[unknown], return_inverse=True)
            flags = np.array([self.compatible(self.names[(k >> 32) - 1] if k >> 32 else "", self.names[k & 0xFFFFFFFF]) for k in new.tolist()], dtype=bool)
            self.pairs.tell(new, flags)
            told[unknown] = flags[back]
        return told == 1

    def search_many(self, words: list[str]) -> list[bytes]:
        """encode_text() of many words at once: the same search, one position of all words after the other."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if 0 < len(w) <= LANE and self.ids.keys() >= set(w)]
        for i in set(range(len(words))).difference(plain):
            out[i] = self.encode_text(words[i]).tobytes()
        plain.sort(key=lambda i: -len(words[i]))
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            for i, ids in zip(part, self.search_block([words[i] for i in part])):
                out[i] = self.encode_text(words[i]).tobytes() if ids is None else ids
        return out

    def search_block(self, words: list[str]) -> list[bytes | None]:
        """The streaming search in many lanes; words come longest first.

        A lane keeps WINDOW positions: the last piece of each, and as bits the boundaries of its path since
        the last commit. The boundaries that the paths of all positions a later piece can start at have in
        common are the bits that are left of their AND; the ids up to the highest are committed. None for a
        word whose paths don't meet within the window.
        """
        n, longest = len(words), self.longest
        lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
        begin = np.cumsum(lens) - lens
        marks = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        found, h, total = [], np.zeros(len(marks), dtype=np.uint64), len(marks)
        for size in range(1, min(longest, int(lens[0])) + 1):
            h = h[: total - size + 1] * FACTOR + marks[size - 1 :]
            keys, ids = self.hashed[size - 1]
            if len(keys):
                near = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found.append(np.where(keys[near] == h, ids[near], -1))
            else:
                found.append(np.full(len(h), -1, dtype=np.int64))
        last = np.full((n, WINDOW), -1, dtype=np.int64)
        path = np.zeros((n, WINDOW), dtype=np.uint64)
        base, lost = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # lanes, ends and ids of committed pieces

        def commit(rows: np.ndarray, to: np.ndarray) -> None:
            lanes, at = rows, to
            while len(lanes):
                piece = last[lanes, at % WINDOW]
                told.append((lanes, at, piece))
                at = at - self.sizes[piece]
                on = at > base[lanes]
                lanes, at = lanes[on], at[on]
            base[rows] = to

        for end in range(1, int(lens[0]) + 1):
            rows = np.arange(int(np.searchsorted(-lens, -end, side="right")))
            active = rows
            for size in range(min(longest, end), 0, -1):
                piece = found[size - 1][begin[rows] + end - size]
                some = piece >= 0
                maybe, piece = rows[some], piece[some]
                fit = self.fits(last[maybe, (end - size) % WINDOW], piece)
                maybe, piece = maybe[fit], piece[fit]
                last[maybe, end % WINDOW] = piece
                path[maybe, end % WINDOW] = path[maybe, (end - size) % WINDOW] | (ONE << np.uint64(end % WINDOW))
                if len(maybe) == len(rows):
                    break
                rows = np.setdiff1d(rows, maybe, assume_unique=True)
            if end % longest == 0:
                common = np.full(len(active), ALL)
                for at in range(end - longest + 1, end + 1):
                    common &= np.where(at > base[active], path[active, at % WINDOW], ALL)
                common = turned(common, 63 - base[active])  # the first position after the base is bit 0
                common &= (ONE << (end - base[active]).astype(np.uint64)) - ONE
                common[lost[active]] = 0
                meet = common > 0
                to = base[active[meet]] + 1 + highest_bit(common[meet])
                commit(active[meet], to)
                keep = turned((ONE << (end - to).astype(np.uint64)) - ONE, to + 1)
                path[active[meet]] &= keep[:, None]
                lost[active] |= end - base[active] > WINDOW - 2 * longest
        rows = np.flatnonzero(~lost & (base < lens))
        commit(rows, lens[rows])
        lanes, ends, pieces = (np.concatenate(x) for x in zip(*told))
        order = np.lexsort((ends, lanes))
        data = pieces[order].astype(np.int32).tobytes()
        cuts = (4 * np.searchsorted(lanes[order], np.arange(n + 1))).tolist()
        return [None if x else data[a:b] for x, a, b in zip(lost.tolist(), cuts, cuts[1:])]

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        """Ids of words with the space or newline before them. What no piece joins is searched apart: newlines, and last characters that follow a stem."""
        inside, plans = self.inside, []
        for u in units:
            text = u.decode()
            parts = ["\n", text[1:]] if text[0] == "\n" else [SPACE + text[1:]]
            if len(parts[-1]) > 1 and parts[-1][-2:] not in inside:
                parts[-1:] = [parts[-1][:-1], parts[-1][-1]]
            plans.append([p for p in parts if p])
        if len(self.stems) > 50_000:
            self.stems = {}
        new = [p for p in dict.fromkeys(p for ps in plans for p in ps) if p not in self.stems]
        self.stems.update(zip(new, self.search_many(new), strict=True))
        return [b"".join([self.stems[p] for p in ps]) for ps in plans]

    def encode_text(self, text: str) -> np.ndarray:
        """Ids of a text in which spaces are already marked."""
        run = Stream(self)
        return np.array(run.feed(text) + run.end(), dtype=np.int32)


class Stream:
    """The search over a text that comes in parts."""

    def __init__(self, model: Model):
        self.model = model
        self.text = ""  # from the last committed boundary on
        self.last: list[str] = [""]  # of each position since, the last piece of the encoding up to it
        self.most_held = 0

    def feed(self, part: str) -> list[int]:
        model, last, out = self.model, self.last, []
        ids, longest, known, patience = model.ids, model.longest, model.known, 4 * model.longest
        if len(known) > 200_000:
            known.clear()
        self.text += part
        at = len(last) - 1
        while at < len(self.text):
            at += 1
            text = self.text
            for size in range(min(longest, at), 0, -1):
                piece = text[at - size : at]
                if piece in ids or size == 1:
                    pair = (last[at - size], piece)
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = model.compatible(*pair)
                    if fits:
                        last.append(piece)
                        break
            else:
                raise AssertionError((text, last, at))
            if at >= patience:
                out += self.commit()
                last, at = self.last, len(self.last) - 1
                patience = max(4 * longest, 2 * at)  # paths that don't meet are looked at again when they have doubled
        return out

    def commit(self) -> list[int]:
        """Ids up to the last boundary that all surviving paths share."""
        last, n = self.last, len(self.last) - 1
        self.most_held = max(self.most_held, n)
        meets, paths = None, []
        for end in range(max(0, n - self.model.longest + 1), n + 1):
            path, at = [], end
            while at > 0:
                path.append(at)
                at -= len(last[at])
            paths.append(path)
            meets = set(path) if meets is None else meets & set(path)
        if not meets:
            return []
        at = max(meets)
        back = [b for b in paths[-1] if b <= at]
        out = [i for b in reversed(back) for i in self.model.piece_ids(last[b])]
        self.text, self.last = self.text[at:], last[at:]
        return out

    def end(self) -> list[int]:
        back, at = [], len(self.last) - 1
        while at > 0:
            back.append(self.last[at])
            at -= len(self.last[at])
        self.text, self.last = "", [""]
        return [i for p in reversed(back) for i in self.model.piece_ids(p)]


def model_of(path: str) -> Model:
    return kept(("pieces", path), lambda: Model(path))


def encode_batch(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and where each text's begin; null and empty texts have none.

    Words between single spaces and newlines are searched once for each distinct word; a text with other
    spacing goes through the stream as a whole.
    """
    texts = pc.fill_null(texts, "")
    odd = np.ones(len(texts), dtype=bool)
    if model.by_words and model.newline_apart:
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE)).to_numpy(zero_copy_only=False)
    streamed = {}
    for i in np.flatnonzero(odd).tolist():
        text = texts[i].as_py()
        run, marked, out = Stream(model), SPACE + text.replace(" ", SPACE) if text else "", []
        for at in range(0, len(marked), 4096):
            out += run.feed(marked[at : at + 4096])
        streamed[i] = np.array(out + run.end(), dtype=np.int32)
    data, at = text_bytes(pc.if_else(pa.array(odd), "", texts) if streamed else texts)
    # each text begins with a space, so a word stands with the space or newline before it
    full = at[:-1] < at[1:]
    data = np.insert(data, at[:-1][full], 0x20)
    at = at + np.concatenate([[0], np.cumsum(full)])
    starts = np.flatnonzero((data == 0x20) | (data == 0x0A))
    ids, sizes = model.units.lists(data, starts, np.append(starts[1:], len(data)))
    at = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, at)]
    if streamed:
        parts = [streamed[i] if i in streamed else ids[at[i] : at[i + 1]] for i in range(len(texts))]
        ids = np.concatenate(parts)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return ids.astype(np.int32), at


def decode_batch(model: Model, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The texts' bytes: those of the pieces in a row, without the space put before the first."""
    data, begins = ragged_take(model.bytes, model.byte_starts, ids)
    ends = begins[at].tolist()
    blob = data.tobytes()
    return [blob[a + (blob[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1], ends[1:])]


def encode_udf(path: str):
    # all that a caller may ask for is told at once: each further Python step in a plan takes workers of its own
    @F.arrow_udf("struct<ids:array<int>,ids_crc32:long,round_trip:boolean>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path)
        for batch in batches:
            all_ids, lens, same, sums = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], [], []
            for texts in slices(batch):
                ids, at = encode_batch(model, texts)
                back = decode_batch(model, ids, at)
                same += [b == (t or "").replace(SPACE, " ").encode() for b, t in zip(back, texts.to_pylist())]
                sums += crc32_of(ids, at)
                all_ids.append(ids)
                lens.append(np.diff(at))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids)))
            yield pa.StructArray.from_arrays([lists, pa.array(sums, type=pa.int64()), pa.array(same, type=pa.bool_())], names=["ids", "ids_crc32", "round_trip"])
            give_back()

    return encode


def decode_udf(path: str):
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path)
        for batch in batches:
            at = batch.offsets.to_numpy().astype(np.int64)
            texts = decode_batch(model, batch.flatten().to_numpy(zero_copy_only=False), at - at[0])
            yield pa.array([t.decode("utf-8", "replace") for t in texts], type=pa.string())

    return decode


def encode_texts(docs: DataFrame, model: str, text_col: str = "text", into: str = "encoded") -> DataFrame:
    """docs with a struct column: ids (as the library encodes the whole text, no control ids), ids_crc32 and round_trip.

    ids_crc32 is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers.
    round_trip tells whether decoding the ids gives the text back (a literal U+2581 comes back as a
    space). Null and empty texts have no ids and round_trip true. All rows and columns stay, repeated rows too.
    """
    return bounded_batches(docs).withColumn(into, encode_udf(model)(F.col(text_col)))


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (as in token_output), round_trip."""
    into = fresh_name(docs, "encoded")
    rows = encode_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, into=into)
    return rows.select("doc_id", F.size(f"{into}.ids").cast("long").alias("n_tokens"), F.col(f"{into}.ids_crc32").alias("ids_crc32"), F.col(f"{into}.round_trip").alias("round_trip"))
