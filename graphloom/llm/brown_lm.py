"""Scoring texts with a Brown class-based bigram model that is learned from the corpus.

Documents are cut into batches whose words are numbered within the batch, so a
batch is a few arrays. Counts of all words are merged by ranges of their
hashes, and each batch gets back the counts of its own words: no vocabulary is
ever in one place. Words are known by 64-bit hashes.

Classes start from an exchange over units, until none moves: each of the UNITS
most frequent words is a unit, and all other words begin in one of POOLS units
by their ending. The matrix of unit bigrams is of fixed size and counts every
training token. Then every other word of the training texts moves by itself, by
the classes beside it, counted over the corpus by ranges of hashes, in rounds
until few tokens move. Words that no training text has are of their pool's class.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, free_shuffles, materialize, temporary_tables, text_or_empty

UNITS = 1024
POOLS = 512
CLASSES = 64
ALPHA = 0.1
#: Rounds in which words choose their classes, at most, and the share of training tokens that move in a round worth another.
ROUNDS = 2
MOVING = 0.005
BATCH_BYTES = 8 << 20
#: Marks the class of a word that is a unit of its own.
SETTLED = 1 << 15
#: Unit 0 is the end of a text; frequent words follow, then pools.
END = 0
BATCH_SCHEMA = "batch long, doc_ids binary, nulls binary, held binary, lengths binary, tokens binary, h binary, c binary, pool binary"


def pool_of(word: bytes) -> int:
    stem = word.rstrip(b".,;:!?")
    return zlib.crc32(stem[-3:] + word[-1:] if len(stem) < len(word) else stem[-3:]) % POOLS


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, text) -> batches: words by rising hash with their training counts, and texts as word numbers."""
    part, k = TaskContext.get().partitionId() << 24, 0
    press = zstandard.ZstdCompressor(level=1)
    docs: list = []
    words: list[bytes] = []
    lengths: list[int] = []
    size = 0

    def flush():
        held = np.array([d[1] for d in docs], dtype=bool)
        n = np.array(lengths, dtype=np.int32)
        seen = dict.fromkeys(words, 0)
        found = list(seen)
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), dtype=np.uint64, count=len(found))
        h, place = np.unique(h, return_inverse=True)
        pool = np.zeros(len(h), dtype="<u2")
        pool[place] = np.fromiter(map(pool_of, found), dtype=np.uint16, count=len(found))
        seen = dict(zip(found, place.tolist()))
        tokens = np.fromiter(map(seen.__getitem__, words), dtype="<i4", count=len(words))
        c = np.bincount(tokens[np.repeat(~held, n)], minlength=len(h)).astype("<u4")
        ids = np.array([d[0] or 0 for d in docs], dtype="<i8")
        nulls = np.array([d[0] is None for d in docs], dtype=bool)
        row = (part | k, ids.tobytes(), nulls.tobytes(), held.tobytes(), n.tobytes(), press.compress(tokens.tobytes()), h.astype("<u8").tobytes(), c.tobytes(), pool.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [c.split()[0] for c in BATCH_SCHEMA.split(", ")])

    for b in batches:
        for doc, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            w = text.as_py().encode().lower().split()
            docs.append((doc, held))
            words += w
            lengths.append(len(w))
            size += sum(map(len, w)) + 16
            if size >= BATCH_BYTES:
                yield flush()
                docs, words, lengths, size, k = [], [], [], 0, k + 1
    if docs:
        yield flush()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: a row may be megabytes, and only one is copied at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _to_ranges(bits: int):
    """Cut the arrays of a batch into ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for row in _each(batches):
            h, c, pool = np.frombuffer(row["h"], "<u8"), np.frombuffer(row["c"], "<u4"), np.frombuffer(row["pool"], "<u2")
            at = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
            at = np.r_[at, len(h)]
            out = [(r, row["batch"], h[x:y].tobytes(), press.compress(c[x:y].tobytes()), pool[x:y].tobytes()) for r, (x, y) in enumerate(zip(at, at[1:])) if y > x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["range", "batch", "h", "c", "pool"])

    return run


MERGED_SCHEMA = "range long, batch long, counts binary, words long, tokens long, pool_words array<long>, pool_tokens array<long>, top_h array<long>, top_n array<long>, top_pool array<long>"


def _merge_ranges(units: int):
    """Rows sorted by range: for each batch the corpus counts of its words there, and one row about the range."""

    def merged(key, rows):
        unpack = zstandard.ZstdDecompressor()
        h = np.concatenate([np.frombuffer(r[1], "<u8") for r in rows])
        c = np.concatenate([np.frombuffer(unpack.decompress(r[2]), "<u4") for r in rows]).astype(np.int64)
        pool = np.concatenate([np.frombuffer(r[3], "<u2") for r in rows])
        own, first, place = np.unique(h, return_index=True, return_inverse=True)
        total = np.zeros(len(own), dtype=np.int64)
        np.add.at(total, place, c)
        back = total[place]
        cuts = np.cumsum([len(r[1]) // 8 for r in rows])[:-1]
        press = zstandard.ZstdCompressor(level=1)
        counts = [press.compress(x.astype("<i8").tobytes()) for x in np.split(back, cuts)]
        seen = total > 0
        of = pool[first]
        best = np.lexsort((own, -total))[:units]
        best = best[total[best] > 0]
        facts = (int(seen.sum()), int(total.sum()), np.bincount(of[seen], minlength=POOLS).tolist(), np.bincount(of, weights=total, minlength=POOLS).astype(np.int64).tolist(), own[best].view(np.int64).tolist(), total[best].tolist(), of[best].tolist())
        n = len(rows)
        columns = [[key] * (n + 1), [*(r[0] for r in rows), None], [*counts, None], *([None] * n + [x] for x in facts)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], [c.split()[0] for c in MERGED_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5))):
                if rows and r[0] != key:
                    yield merged(key, rows)
                    rows = []
                key = r[0]
                rows.append(r[1:])
        if rows:
            yield merged(key, rows)

    return run


@dataclass
class Vocabulary:
    """What is known of all training tokens: texts, words, and the frequent words by rising hash."""

    texts: int
    tokens: int
    words: int
    top: np.ndarray  # hashes
    top_tokens: np.ndarray
    top_pool: np.ndarray
    pool_words: np.ndarray
    pool_tokens: np.ndarray

    @property
    def units(self) -> int:
        return 1 + len(self.top) + POOLS

    def unit_of(self, h: np.ndarray, pool: np.ndarray) -> np.ndarray:
        out = 1 + len(self.top) + pool.astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
            out = np.where(self.top[at] == h, 1 + at, out)
        return out

    def unit_words(self) -> np.ndarray:
        rest = self.pool_words - np.bincount(self.top_pool, minlength=POOLS)
        return np.concatenate([[int(self.texts > 0)], np.ones(len(self.top), np.int64), rest])

    def unit_tokens(self) -> np.ndarray:
        rest = self.pool_tokens - np.bincount(self.top_pool, weights=self.top_tokens, minlength=POOLS).astype(np.int64)
        return np.concatenate([[self.texts], self.top_tokens, rest])


def _sequence(row: dict, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers with an end (-1) after each text, the units of these tokens, and where texts start."""
    n = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
    tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), "<i4")
    ends = np.cumsum(n + 1) - 1
    out = np.full(int((n + 1).sum()), -1, dtype=np.int64)
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = tokens
    unit = np.full(len(out), END, dtype=np.int64)
    unit[inner] = units[tokens]
    return out, unit, ends - n


def _bigrams(vocabulary: Vocabulary):
    """Per task the counts of unit pairs in training texts, by first unit."""
    u = vocabulary.units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(u * u, dtype=np.int64)
        for row in _each(batches):
            held = np.frombuffer(row["held"], dtype=bool)
            _, unit, starts = _sequence(row, vocabulary.unit_of(np.frombuffer(row["h"], "<u8"), np.frombuffer(row["pool"], "<u2")))
            before = np.r_[END, unit[:-1]]  # a text follows the end of another
            own = np.repeat(~held, np.diff(np.r_[starts, len(unit)]))
            cell, n = np.unique(before[own] * u + unit[own], return_counts=True)
            total[cell] += n
        cell = np.flatnonzero(total)
        if len(cell):
            first, at = np.unique(cell // u, return_index=True)
            parts = np.split(cell % u, at[1:]), np.split(total[cell], at[1:])
            yield pa.RecordBatch.from_arrays([pa.array(first), *(pa.array(p, pa.list_(pa.int64())) for p in parts)], ["a", "b", "n"])

    return run


def _sum_bigrams(units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(units, dtype=np.int64)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["a", "n"])

        for x in batches:
            for a, b, n in zip(x.column(0).to_pylist(), x.column(1), x.column(2)):
                if key is not None and a != key:
                    yield row()
                    total[:] = 0
                key = a
                total[b.values.to_numpy()] += n.values.to_numpy()
        if key is not None:
            yield row()

    return run


def exchange(m: np.ndarray, classes: int, rounds: int = 100) -> np.ndarray:
    """The class of each unit by the exchange algorithm: units move, most frequent first, to the class that raises the likelihood of the bigrams m most.

    The end of a text keeps class 0 to itself. Ties go to the smaller class.
    """
    units = len(m)
    order = np.argsort(-(m.sum(0) + m.sum(1)), kind="stable")
    order = order[order != END]
    cls = np.zeros(units, dtype=np.int64)
    cls[order] = 1 + np.arange(len(order)) % (classes - 1)
    hot = np.eye(classes)[cls]
    n = hot.T @ m @ hot

    def f(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    for _ in range(rounds):
        moved = 0
        for u in order:
            own = m[u, u]
            right = np.bincount(cls, weights=m[u], minlength=classes)
            left = np.bincount(cls, weights=m[:, u], minlength=classes)
            a = cls[u]
            right[a] -= own
            left[a] -= own
            if not (right.any() or left.any() or own):
                continue
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= own
            with_row, with_col = f(n + right[None, :]), f(n + left[:, None])
            now = f(n)
            gain = (with_row - now).sum(1) + (with_col - now).sum(0)
            d = np.arange(classes)
            gain += f(n[d, d] + right + left + own) - with_row[d, d] - with_col[d, d] + now[d, d]
            row, col = n.sum(1) + left, n.sum(0) + right  # tokens beside u count in their classes' totals wherever u goes
            gain -= f(row + right.sum() + own) - f(row) + f(col + left.sum() + own) - f(col)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b] += right
            n[:, b] += left
            n[b, b] += own
            moved += b != a
            cls[u] = b
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    vocabulary: Vocabulary
    cls: np.ndarray  # of units
    log_trans: np.ndarray  # from class to class
    class_tokens: np.ndarray
    class_words: np.ndarray

    @staticmethod
    def learn(vocabulary: Vocabulary, m: np.ndarray, classes: int = CLASSES) -> "ClassModel":
        cls = exchange(m, classes)
        hot = np.eye(classes)[cls]
        tokens = np.bincount(cls, weights=vocabulary.unit_tokens(), minlength=classes)
        words = np.bincount(cls, weights=vocabulary.unit_words(), minlength=classes)
        return ClassModel(vocabulary, cls, ClassModel.transitions(hot.T @ m @ hot), tokens, words)

    @staticmethod
    def transitions(n: np.ndarray) -> np.ndarray:
        """log10 chances from class to class, from class bigrams."""
        alone = (n.sum(0) + ALPHA) / (n.sum() + ALPHA * len(n))
        prior = 20.0  # a class's history counts as much as the unigram after so many tokens
        return np.log10((n + prior * alone[None, :]) / (n.sum(1, keepdims=True) + prior))

    def log_emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Of a word of its class; the unseen words of a class have one share between them."""
        return np.log10((count + ALPHA) / (self.class_tokens[cls] + ALPHA * (self.class_words[cls] + 1)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray | None, np.ndarray | None]]:
    """Rows sorted by batch, kind and range -> each batch with the corpus counts and the classes of its words, where there are rows of them."""
    unpack = zstandard.ZstdDecompressor().decompress
    batch, counts, classes = None, [], []
    for row in _each(batches):
        if row["batch"] != batch:
            batch, counts, classes = row["batch"], [], []
        if row["kind"] == 0:
            counts.append(np.frombuffer(unpack(row["found"]), "<i8"))
        elif row["kind"] == 1:
            classes.append(np.frombuffer(unpack(row["found"]), "<u2"))
        else:
            yield row, np.concatenate(counts) if counts else None, np.concatenate(classes).astype(np.int64) if classes else None


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of arrays of equal length."""
    total = None
    for b in batches:
        for x in b.column(0):
            own = x.values.to_numpy()
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["n"])


def _neighbours(model: ClassModel, bits: int, first: bool):
    """Cut the words of a batch into ranges of the hash, with their classes, training counts and the classes before and after them; and count class bigrams.

    The cells of a word are classes before it, and after them classes behind
    it; the frequent words have none, as their classes are settled. In the first
    round classes are those of the units.
    """
    v, k = model.vocabulary, len(model.class_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        pairs = np.zeros(k * k, dtype=np.int64)
        names = [c.split()[0] for c in NEIGHBOURS_SCHEMA.split(", ")]
        for row, _, known in ((r, None, None) for r in _each(batches)) if first else _gathered(batches):
            h = np.frombuffer(row["h"], "<u8")
            if first:
                units = v.unit_of(h, np.frombuffer(row["pool"], "<u2"))
                known = model.cls[units] | np.where(units <= len(v.top), SETTLED, 0)
            cls, free = known & (SETTLED - 1), known < SETTLED
            word, _, starts = _sequence(row, cls)
            of = np.r_[cls, model.cls[END]][word]
            before = np.r_[model.cls[END], of[:-1]]
            own = np.repeat(~np.frombuffer(row["held"], dtype=bool), np.diff(np.r_[starts, len(word)]))
            pairs += np.bincount(before[own] * k + of[own], minlength=k * k)
            c = np.bincount(word[own & (word >= 0)], minlength=len(h)).astype("<u4")
            at = np.flatnonzero(own & np.r_[free, False][word])
            cell, n = np.unique(np.concatenate([word[at] * 2 * k + before[at], word[at] * 2 * k + k + of[at + 1]]), return_counts=True)
            cells = np.bincount(cell // (2 * k), minlength=len(h))
            cut = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            upto = np.r_[0, np.cumsum(cells)]
            out = []
            for r, (x, y) in enumerate(zip(cut, np.r_[cut[1:], len(h)])):
                if y > x:
                    z = slice(upto[x], upto[y])
                    out.append((r, row["batch"], h[x:y].tobytes(), press(known[x:y].astype("<u2").tobytes()), press(c[x:y].tobytes()), press(cells[x:y].astype("<u4").tobytes()), press((cell[z] % (2 * k)).astype("<u2").tobytes()), press(n[z].astype("<u4").tobytes()), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _NEIGHBOURS)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([-1, None, *[None] * 6, pairs.tolist()], _NEIGHBOURS)], names)

    return run


NEIGHBOURS_SCHEMA = "range long, batch long, h binary, cls binary, c binary, cells binary, cell binary, n binary, pairs array<long>"
_NEIGHBOURS = [pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]
CHOSEN_SCHEMA = "range long, batch long, classes binary, class_words array<long>, class_tokens array<long>, moved long"


def best_classes(n: np.ndarray, cls: np.ndarray, word: np.ndarray, cell: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each word the class under which the classes beside it are likeliest, given the class bigrams n.

    (word, cell, times) are the sparse counts beside words, sorted by word. A
    word's own tokens are left out of its present class, which ties do not
    leave; no word joins the class of the end.
    """
    k, out, smooth = len(n), cls.copy(), 0.5
    row, col = n.sum(1), n.sum(0)
    gain = np.concatenate([np.log(n + smooth) - np.log(col + smooth * k)[None, :], (np.log(n + smooth) - np.log(row + smooth * k)[:, None]).T])
    for at in range(0, len(cls), 16384):
        x, y = np.searchsorted(word, [at, at + 16384])
        w, d, t = word[x:y] - at, cell[x:y], times[x:y].astype(float)
        a = cls[at : at + 16384]
        beside = np.zeros((len(a), 2 * k))
        beside[w, d] = t
        score = beside @ gain
        left = d < k
        mine, c = a[w], d % k
        now = np.where(left, n[c, mine], n[mine, c])
        own = np.where(left, beside[:, :k].sum(1)[w], beside[:, k:].sum(1)[w])
        total = np.where(left, col[mine], row[mine])
        less = np.log(np.maximum(now - t, 0) + smooth) - np.log(np.maximum(total - own, 0) + smooth * k) - gain[d, mine]
        i = np.arange(len(a))
        score[i, a] += np.bincount(w, weights=t * less, minlength=len(a))
        score[:, END] = -np.inf
        best = score.argmax(1)
        out[at : at + 16384] = np.where(score[i, best] > score[i, a] + 1e-9, best, a)
    return out


def _choose(n: np.ndarray):
    """Rows sorted by range: for each batch the classes of its words there, and one row of words and tokens by class."""
    k = len(n)

    def chosen(key, rows):
        unpack, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        read = lambda i, kind: np.concatenate([np.frombuffer(unpack(r[i]), kind) for r in rows]).astype(np.int64)
        own, first, place = np.unique(np.concatenate([np.frombuffer(r[1], "<u8") for r in rows]), return_index=True, return_inverse=True)
        known = read(2, "<u2")[first]
        cls, settled = known & (SETTLED - 1), known & SETTLED
        total = np.bincount(place, weights=read(3, "<u4"), minlength=len(own)).astype(np.int64)
        cell, at = np.unique(np.repeat(place, read(4, "<u4")) * 2 * k + read(5, "<u2"), return_inverse=True)
        times = np.bincount(at, weights=read(6, "<u4"), minlength=len(cell))
        moving = np.flatnonzero(np.bincount(cell // (2 * k), minlength=len(own)) > 0)
        was = cls.copy()
        number = np.full(len(own), -1)
        number[moving] = np.arange(len(moving))
        word = number[cell // (2 * k)]
        cls[moving] = best_classes(n, cls[moving], word[word >= 0], (cell % (2 * k))[word >= 0], times[word >= 0])
        parts = np.split((cls | settled)[place], np.cumsum([len(r[1]) // 8 for r in rows])[:-1])
        facts = np.bincount(cls[total > 0], minlength=k).tolist(), np.bincount(cls, weights=total, minlength=k).astype(np.int64).tolist(), int(total[cls != was].sum())
        columns = [[key] * (len(rows) + 1), [*(r[0] for r in rows), None], [*(press(p.astype("<u2").tobytes()) for p in parts), None], *([None] * len(rows) + [x] for x in facts)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], [c.split()[0] for c in CHOSEN_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(8))):
                if rows and r[0] != key:
                    yield chosen(key, rows)
                    rows = []
                key = r[0]
                rows.append(r[1:])
        if rows:
            yield chosen(key, rows)

    return run


LABELLED_SCHEMA = "doc_ids binary, nulls binary, held binary, lengths binary, known binary, base binary, emission binary, classes binary"


def _label(model: ClassModel):
    """Batches with counts and classes of their words -> sums over each text that need no class bigrams, and the classes of all tokens."""
    v = model.vocabulary
    tokens, words = v.tokens + v.texts, v.words + int(v.texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for row, counts, classes in _gathered(batches):
            none = np.zeros(0, dtype=np.int64)
            count = np.r_[none if counts is None else counts, v.texts]  # the last is the end's
            of = np.r_[none if classes is None else classes & (SETTLED - 1), model.cls[END]]
            base = np.log10((count + ALPHA) / (tokens + ALPHA * (words + 1)))
            emit = model.log_emission(count, of)
            word, _, starts = _sequence(row, of[:-1])
            n = np.diff(np.r_[starts, len(word)])
            sums = [np.add.reduceat(x, starts) for x in ((count[word] > 0).astype("<i8"), base[word], emit[word])]
            out = (row["doc_ids"], row["nulls"], row["held"], n.astype("<i8").tobytes(), *(x.tobytes() for x in sums), press.compress(of[word].astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], [c.split()[0] for c in LABELLED_SCHEMA.split(", ")])

    return run


def _class_sequence(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class before each token, its class, and the numbers of tokens of texts."""
    c = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["classes"]), "<u2").astype(np.int64)
    return np.r_[c[-1:], c[:-1]], c, np.frombuffer(row["lengths"], "<i8")  # the last token is an end, and a text follows the end of another


def _class_bigrams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, dtype=np.int64)
        for row in _each(batches):
            before, c, n = _class_sequence(row)
            own = np.repeat(~np.frombuffer(row["held"], dtype=bool), n)
            total += np.bincount(before[own] * k + c[own], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["n"])

    return run


def _scorer(model: ClassModel):
    tokens = model.vocabulary.tokens + model.vocabulary.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            before, c, n = _class_sequence(row)
            ids, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], dtype=bool)
            score = np.frombuffer(row["emission"], "<f8") + np.add.reduceat(model.log_trans[before, c], np.cumsum(n) - n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=nulls), pa.array(np.frombuffer(row["held"], dtype=bool)), pa.array(n), pa.array(np.frombuffer(row["known"], "<i8")), pa.array(np.full(len(n), tokens, dtype=np.int64)), pa.array(np.frombuffer(row["base"], "<f8")), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _vocabulary(merged: DataFrame, texts: int, units: int) -> Vocabulary:
    facts = merged.where("batch is null")
    total = facts.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    pools = facts.select(F.posexplode(F.arrays_zip("pool_words", "pool_tokens")).alias("p", "x")).groupBy("p").agg(F.sum("x.pool_words").alias("w"), F.sum("x.pool_tokens").alias("t")).collect()
    top = facts.select(F.explode(F.arrays_zip("top_h", "top_n", "top_pool")).alias("x")).select("x.*").orderBy(F.desc("top_n"), "top_h").limit(units).collect()
    pool_words, pool_tokens = np.zeros(POOLS, np.int64), np.zeros(POOLS, np.int64)
    for r in pools:
        pool_words[r["p"]], pool_tokens[r["p"]] = r["w"], r["t"]
    h = np.array([r["top_h"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(texts, total["t"], total["w"], h[order], np.array([r["top_n"] for r in top], np.int64)[order], np.array([r["top_pool"] for r in top], np.int64)[order], pool_words, pool_tokens)


def score_texts(docs: DataFrame, units: int = UNITS, classes: int = CLASSES, holdout: tuple[int, int] = (10, 0), rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; one end
    follows each text and is a token. Rows whose crc32(doc_id as text) mod m is
    r are held out from learning; a null doc_id is hashed as empty. A null text
    is empty and scores its end. score is the log10 probability of the text
    under the class model: class given the last class, word given its class.
    Equal rows count as often as they occur; a very long text is a batch of its
    own; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    m, r = holdout
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % m == r
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text_or_empty().alias("text"))
    with temporary_tables(spark):
        batched = materialize(rows.mapInArrow(_batched, BATCH_SCHEMA), "word-batches")
        texts = rows.where(~F.col("held")).count()
        n_batches = batched.count()
        # a range is merged by one task, in memory: ranges and what each batch gives one grow alike, as the root of the corpus
        bits = max(6, math.ceil(math.log2(8 * math.sqrt(n_batches + 1))))
        by_batch = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_batches)

        def by_range(pieces: DataFrame, bits: int) -> DataFrame:
            return pieces.repartitionById(1 << bits, F.col("range").cast("int")).sortWithinPartitions("range", "batch")

        ranges = batched.select("batch", "h", "c", "pool").mapInArrow(_to_ranges(bits), "range long, batch long, h binary, c binary, pool binary")
        merged = materialize(by_range(ranges, bits).mapInArrow(_merge_ranges(units), MERGED_SCHEMA), "word-counts")
        del ranges
        vocabulary = _vocabulary(merged, texts, units)
        # a task sends its whole matrix: their number follows the cluster, not the corpus
        tasks = 4 * spark.sparkContext.defaultParallelism
        pairs = batched.select("held", "lengths", "tokens", "h", "pool").coalesce(tasks).mapInArrow(_bigrams(vocabulary), "a long, b array<long>, n array<long>")
        lines = pairs.repartition("a").sortWithinPartitions("a").mapInArrow(_sum_bigrams(vocabulary.units), "a long, n array<long>").collect()
        matrix = np.zeros((vocabulary.units, vocabulary.units))
        for x in lines:
            matrix[x["a"]] = x["n"]
        del pairs, lines
        model = ClassModel.learn(vocabulary, matrix, classes)
        fields = ["doc_ids", "nulls", "held", "lengths", "tokens", "h"]

        def together(parts: list[tuple[int, DataFrame, str]], wanted: list[str]) -> DataFrame:
            """Batches, each after what is known of its words."""
            none = [F.lit(None).cast("binary").alias(c) for c in wanted]
            out = batched.select("batch", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("range"), F.lit(None).cast("binary").alias("found"), *wanted)
            for kind, rows, column in parts:
                out = out.union(rows.where("batch is not null").select("batch", F.lit(kind).alias("kind"), "range", F.col(column).alias("found"), *none))
            return out.repartition(by_batch, "batch").sortWithinPartitions("batch", "kind", "range")

        chosen = None
        for _ in range(rounds):
            free_shuffles(spark)
            source = batched if chosen is None else together([(1, chosen, "classes")], fields[2:])
            beside = materialize(source.mapInArrow(_neighbours(model, bits + 1, chosen is None), NEIGHBOURS_SCHEMA), "neighbours")
            n = np.zeros(classes * classes)
            for x in beside.where("range < 0").select("pairs").coalesce(tasks).mapInArrow(_summed, "n array<long>").collect():
                n += np.array(x["n"])
            if chosen is not None:
                drop_scratch(chosen)
            chosen = materialize(by_range(beside.where("range >= 0").drop("pairs"), bits + 1).mapInArrow(_choose(n.reshape(classes, classes)), CHOSEN_SCHEMA), "word-classes")
            drop_scratch(beside)
            del source, beside
            moved = chosen.agg(F.sum("moved")).first()[0] or 0
            if moved <= MOVING * max(1, vocabulary.tokens):
                break
        model.class_words, model.class_tokens = np.zeros(classes), np.zeros(classes)
        for x in chosen.where("batch is null").select(F.posexplode(F.arrays_zip("class_words", "class_tokens")).alias("c", "x")).groupBy("c").agg(F.sum("x.class_words").alias("w"), F.sum("x.class_tokens").alias("t")).collect():
            model.class_words[x["c"]], model.class_tokens[x["c"]] = x["w"], x["t"]
        model.class_words[model.cls[END]] += int(texts > 0)
        model.class_tokens[model.cls[END]] += texts
        free_shuffles(spark)
        met = together([(0, merged, "counts"), (1, chosen, "classes")], fields[:5])
        labelled = materialize(met.mapInArrow(_label(model), LABELLED_SCHEMA), "labelled", outlives=True)
        counts = np.zeros((classes, classes))
        for x in labelled.select("held", "lengths", "classes").coalesce(tasks).mapInArrow(_class_bigrams(classes), "n array<long>").collect():
            counts += np.array(x["n"]).reshape(classes, classes)
        model.log_trans = ClassModel.transitions(counts)
    return labelled.mapInArrow(_scorer(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
