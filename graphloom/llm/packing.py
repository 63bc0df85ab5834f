"""Packing documents into token sequences by sum-of-squares placement."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing, text_or_empty
from .tokens import TokenizerSpec, encoder

#: Partitions whose open windows one task packs on.
FAN_IN = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Online packing of token runs into windows of a fixed capacity.

    ``levels[h]`` is the number of partially filled windows at fill h. A run of
    r tokens goes to the level h (0: a new window) for which the sum of squares
    of ``levels`` over 0 < h < capacity becomes least; ties go to the fuller
    window. Full windows leave at once. Where more than ``most_open`` are open,
    the emptiest is cut to fill the fullest, and the array goes on with the
    others. ``finish`` does so until one open window at most is left, and splits
    that one into lengths that are powers of two; ``leave`` gives the open runs
    away instead, to a packer that goes on with them.
    """

    def __init__(self, capacity: int = 2048, most_open: int = 4096):
        self.capacity, self.most_open = capacity, most_open
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.closed: list[list] = []

    def add(self, doc_id, start: int, ids: np.ndarray, n: int) -> None:
        """A run of a document of n tokens, from its token ``start`` on."""
        cap = self.capacity
        whole = len(ids) - len(ids) % cap
        for at in range(0, whole, cap):
            self.closed.append([(doc_id, start + at, ids[at : at + cap], n)])
        if whole < len(ids):
            self._place((doc_id, start + whole, ids[whole:], n))
            while self.n_open > self.most_open:
                self._relieve()

    def _place(self, piece: tuple) -> None:
        r, cap, levels = len(piece[2]), self.capacity, self.levels
        change = 2 * (levels[r:] - levels[: cap + 1 - r]) + 2  # moving a window from h to h + r
        change[0] -= 1  # a new window leaves no level
        change[-1] -= 1  # a full one enters none
        shut = levels[: cap + 1 - r] == 0
        shut[0] = False
        change[shut] = np.iinfo(np.int64).max
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        if h:
            window = self.open[h].pop()
            levels[h] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if h + r == cap:
            self.closed.append(window)
        else:
            self.open.setdefault(h + r, []).append(window)
            levels[h + r] += 1
            self.n_open += 1

    def _close(self, h: int) -> list:
        """Take an open window of fill h out of the array."""
        window = self.open[h].pop()
        self.levels[h] -= 1
        self.n_open -= 1
        return window

    def _relieve(self) -> None:
        """Cut the emptiest open window to fill the fullest ones; what fills none up is put into the fullest."""
        pieces = self._close(int(np.flatnonzero(self.levels)[0]))
        while pieces:
            h = int(np.flatnonzero(self.levels)[-1])
            window, room = self._close(h), self.capacity - h
            while room and pieces:
                doc, start, ids, n = pieces.pop()
                keep = max(0, len(ids) - room)
                window.append((doc, start + keep, ids[keep:], n))
                room -= len(ids) - keep
                if keep:
                    pieces.append((doc, start, ids[:keep], n))
            if room:
                h = self.capacity - room
                self.open.setdefault(h, []).append(window)
                self.levels[h] += 1
                self.n_open += 1
            else:
                self.closed.append(window)
            if pieces and not self.n_open:
                h = sum(len(p[2]) for p in pieces)
                self.open.setdefault(h, []).append(pieces)
                self.levels[h] += 1
                self.n_open += 1
                return

    def leave(self) -> list[tuple]:
        """The runs of all open windows, fullest first."""
        out = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        return out

    def finish(self) -> None:
        while self.n_open > 1:
            self._relieve()
        left = self.leave()
        while left:
            room = 1 << (sum(len(p[2]) for p in left).bit_length() - 1)
            part: list = []
            while room:
                doc, start, ids, n = left.pop(0)
                part.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    left.insert(0, (doc, start + room, ids[room:], n))
                room -= len(part[-1][2])
            self.closed.append(part)

    def take(self) -> list[list]:
        done, self.closed = self.closed, []
        return done


def _rows(windows: list[list], first: int) -> list[tuple]:
    out = []
    for k, window in enumerate(windows, first):
        at = 0
        for doc, start, ids, n in window:
            out.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()), n, k, at))
            at += len(ids)
    return out


#: A piece, or a run that is left to the next round: then ids are those of the run, and the last fields tell its order.
ROUND_SCHEMA = f"{SCHEMA}, ids binary, task long, k long"
_KIND = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in ROUND_SCHEMA.split(", "))])


def _round(items, capacity: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pack (doc_id, start, ids, doc_tokens) and give on what is open in the end, or finish it."""
    task = TaskContext.get().partitionId()
    packer, k, left = SumOfSquares(capacity), (level << 56) | (task << 32), []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KIND.types)], schema=_KIND)

    for item in items:
        packer.add(*item)
        if len(packer.closed) >= 512:
            done = packer.take()
            yield batch([(*r, None, None, None) for r in _rows(done, k)])
            k += len(done)
    if last:
        packer.finish()
    else:
        left = [(doc, start, len(ids), None, n, None, None, np.ascontiguousarray(ids, dtype="<u4").tobytes(), task, i) for i, (doc, start, ids, n) in enumerate(packer.leave())]
    if rows := [(*r, None, None, None) for r in _rows(packer.take(), k)] + left:
        yield batch(rows)


def _first_round(spec: TokenizerSpec, capacity: int, eos: int, last: bool):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(spec), np.array([eos], dtype=np.uint32)

        def items():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = np.concatenate([enc.encode(text.as_py()), end])
                    yield doc, 0, ids, len(ids)

        yield from _round(items(), capacity, 0, last)

    return run


def _next_round(capacity: int, level: int, last: bool):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for b in batches:
                for doc, start, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                    yield doc, start, np.frombuffer(ids, "<u4"), n

        yield from _round(items(), capacity, level, last)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, eos: int = 1) -> DataFrame:
    """Pack every row of docs (doc_id, text) into sequences of at most ``capacity`` tokens.

    A null or empty text is the end id alone; equal rows are packed as often as
    they occur; a null doc_id stays null; a text of very many tokens fills
    sequences of its own as it is read; further columns are not read; no rows
    give no sequences.

    Each input partition is packed in one pass without a shuffle. The runs of
    its windows that are open then, some hundreds whatever its size, go to a
    task that packs those of FAN_IN partitions on in the same way, and so on; so
    windows are cut to close others only once, at the very end. Rounds are
    written to the shared folder, so a lost executor changes no sequence.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    done, level = [], 0
    now = materialize(rows.mapInArrow(_first_round(TokenizerSpec.from_file(tokenizer_path), capacity, eos, False), ROUND_SCHEMA), "packed")
    while True:
        done.append(now.where("ids IS NULL").select(names))
        left = now.where("ids IS NOT NULL")
        most = left.agg(F.max("task")).first()[0]
        if most is None:
            return reduce(DataFrame.union, done)
        level += 1
        groups = most // FAN_IN + 1
        met = left.repartitionById(groups, F.floor(F.col("task") / FAN_IN).cast("int")).sortWithinPartitions("task", "k")
        now = materialize(met.mapInArrow(_next_round(capacity, level, groups == 1), ROUND_SCHEMA), "packed")
