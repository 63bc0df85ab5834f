"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block, and of a block of queries.
BLOCK = 16384
QUERIES = 128
#: Blocks of the index that one task holds while queries pass; queries are copied once for each such group.
GROUP = 32
#: Bytes of copied queries that are shuffled at a time, unless the index is larger.
ROUND_BYTES = 1 << 30
#: Components from here on are kept as whole numbers of any length, in blocks of their own.
WIDE = 1 << 31


class SlicedBlock:
    """Rows of integer vectors, sorted by id, as bit slices of each attribute.

    Attribute j is kept as u = x - lo[j] >= 0 in as many slices as its range
    needs, whole numbers of any length (dtype object) included. ``bank`` holds
    the slices and then their complements (of rows that exist), each as 64-bit
    words over the rows.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], vectors[order]
        n, dims = x.shape
        self.lo = x.min(0) if dims else np.zeros(0, np.int64)
        u = x - self.lo
        bits = [int(m).bit_length() for m in (u.max(0) if dims else [])]
        self.full = [(1 << b) - 1 for b in bits]
        words = -(-n // 64)
        self.rows = self._pack(np.ones((1, n), dtype=bool), words)[0]
        slices = [(u[:, j] >> s) & 1 for j, b in enumerate(bits) for s in range(b)]
        bank = self._pack(np.array(slices, dtype=bool).reshape(len(slices), n), words)
        self.bank = np.concatenate([bank, ~bank & self.rows])
        self.dim = np.array([j for j, b in enumerate(bits) for _ in range(b)], dtype=np.int64)
        self.place = np.array([s for b in bits for s in range(b)], dtype=np.int64)

    @staticmethod
    def _pack(bits: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros((bits.shape[0], words * 8), dtype=np.uint8)
        out[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1, bitorder="little")
        return out.view("<u8")

    def score_slices(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores less a constant, least significant first, and the constant.

        Each set bit of a weight adds the attribute's slices, shifted, to the
        columns of equal significance; a negative weight adds complements.
        Columns are summed by carry-save adders.
        """
        size, neg = np.abs(q), q < 0
        base = sum(w * int(low) - (-w * full if w < 0 else 0) for w, low, full in zip(map(int, q), self.lo, self.full))
        pick = np.arange(len(self.dim)) + np.where(neg[self.dim], len(self.dim), 0)
        columns: dict[int, list[np.ndarray]] = {}
        for t in range(int(size.max()).bit_length() if len(size) else 0):
            on = np.flatnonzero(((size >> t) & 1).astype(bool)[self.dim])
            place = self.place[on] + t
            for w in np.unique(place):
                columns.setdefault(int(w), []).append(pick[on[place == w]])
        out: list[np.ndarray] = []
        carries: list[np.ndarray] = []
        w = 0
        last = max(columns, default=-1)
        while w <= last or carries:
            parts = ([self.bank[np.concatenate(columns[w])]] if w in columns else []) + carries
            x = np.concatenate(parts) if parts else np.zeros((0, len(self.rows)), np.uint64)
            carries = []
            while len(x) > 1:
                k = len(x) // 3
                if k:
                    a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                    half = a ^ b
                    carries.append((a & b) | (c & half))
                    x = np.concatenate([half ^ c, x[3 * k :]])
                else:
                    carries.append((x[0] & x[1])[None])
                    x = (x[0] ^ x[1])[None]
            out.append(x[0] if len(x) else np.zeros_like(self.rows))
            w += 1
        return out, base

    def top(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but those of id ``own``; ties go to the smaller id."""
        slices, base = self.score_slices(q)
        open_ = self.rows.copy()
        for i in range(*np.searchsorted(self.ids, [own, own + 1])):
            open_[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure, need = np.zeros_like(open_), k
        for s in reversed(slices):
            if int(np.bitwise_count(open_).sum()) <= need:
                break
            high = open_ & s
            n = int(np.bitwise_count(high).sum())
            if n >= need:
                open_ = high
            else:
                sure |= high
                need -= n
                open_ = open_ & ~s
        at = self._positions(sure)
        at = np.concatenate([at, self._positions(open_)[:need]])
        scores = [base + sum(((int(s[i >> 6]) >> (i & 63)) & 1) << w for w, s in enumerate(slices)) for i in at.tolist()]
        return list(zip(self.ids[at].tolist(), scores))

    @staticmethod
    def _positions(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _quantised(vectors: pa.Array, scale: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """floor(scale * x) of all components, and exactly that of the rows with a component beyond WIDE.

    Shorter vectors are filled with zeros, which add nothing to a score.
    """
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    with np.errstate(over="ignore"):
        whole = np.floor(out * scale)
    wide = np.flatnonzero((np.abs(whole) >= WIDE).any(1))
    exact = {int(i): [int(Fraction(v) * scale // 1) for v in out[i].tolist()] for i in wide}
    whole[wide] = 0
    return whole.astype(np.int64), exact


def _packed(m: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the narrowest form that holds it."""
    if m.dtype == object:
        return "wide", ",".join(map(str, m.reshape(-1).tolist())).encode()
    form = "<i2" if m.size == 0 or -(1 << 15) <= m.min() and m.max() < 1 << 15 else "<i4"
    return form, m.astype(form).tobytes()


def _unpacked(form: str, data: bytes, rows: int) -> np.ndarray:
    if form != "wide":
        return np.frombuffer(data, dtype=form).reshape(rows, -1).astype(np.int64)
    flat = np.empty(data.count(b",") + 1, dtype=object)
    flat[:] = [int(x) for x in data.split(b",")]
    return flat.reshape(rows, -1)


BLOCKS_SCHEMA = "part long, kind long, number long, ids binary, form string, m binary"


def _blocks(size: int, kind: int, scale: int):
    """Rows (vec_id, v) -> one row a block: its part, the kind, a number, ids and the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        waiting: dict[bool, list] = {False: [], True: []}
        k = 0

        def block(wide: bool):
            ids = np.concatenate([x[0] for x in waiting[wide]])
            width = max(x[1].shape[1] for x in waiting[wide])
            m = np.concatenate([np.pad(x[1], ((0, 0), (0, width - x[1].shape[1]))) for x in waiting[wide]])
            waiting[wide] = []
            form, data = _packed(m)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (task + k, kind, task << 32 | k, ids.astype("<i8").tobytes(), form, data)], [c.split()[0] for c in BLOCKS_SCHEMA.split(", ")])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            whole, exact = _quantised(b.column(1), scale)
            narrow = np.ones(len(ids), dtype=bool)
            narrow[list(exact)] = False
            parts = [(False, ids[narrow], whole[narrow])]
            if exact:
                big = np.empty((len(exact), whole.shape[1]), dtype=object)
                big[:] = list(exact.values())
                parts.append((True, ids[list(exact)], big))
            for wide, own, m in parts:
                at = 0
                while at < len(own):
                    room = size - sum(len(x[0]) for x in waiting[wide])
                    waiting[wide].append((own[at : at + room], m[at : at + room]))
                    at += room
                    if sum(len(x[0]) for x in waiting[wide]) == size:
                        yield block(wide)
                        k += 1
        for wide in (False, True):
            if waiting[wide]:
                yield block(wide)
                k += 1

    return run


def as_long(score: int) -> tuple[int, str]:
    """The score, at the ends of what a long holds if it is beyond, and then a text that sorts as the score does."""
    if score >= (1 << 63) - 1:
        digits = str(score)
        return (1 << 63) - 1, f"{len(digits):05d}{digits}"
    if score <= -(1 << 63):
        digits = str(-score)
        return -(1 << 63), f"{99999 - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits)
    return score, ""


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            out = []
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], dtype="<i8")
                m = _unpacked(row["form"], row["m"], len(ids))
                if row["part"] != part:
                    part, held = row["part"], []
                if row["kind"] == 0:
                    held.append(SlicedBlock(ids, m))
                    continue
                for block in held:
                    dims = len(block.lo)
                    for i, own in enumerate(ids.tolist()):
                        q = np.zeros(dims, dtype=m.dtype)
                        q[: min(dims, m.shape[1])] = m[i, :dims]
                        out += [(row["number"], i, own, v, *as_long(s)) for v, s in block.top(q, own, k)]
            if out:
                kinds = [pa.int64()] * 5 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["number", "i", "query_id", "vec_id", "score", "beyond"])

    return run


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v array<double>) of rows without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity here
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The k rows of highest integer inner product for each row whose vec_id is divisible by ``every``.

    Rows with a null id or vector, or with null or non-finite components, take
    no part; all others do, whatever their size: ranks follow the exact score,
    and a score beyond a long is given as the nearest long. Vectors of unequal
    length count as filled with zeros; rows that share the query's vec_id are
    its own and left out; equal rows each count; two rows of one query id are
    two queries. No rows give no rows.

    The rows are cut into blocks where they are read, so no vec_id is hot. Each
    group of GROUP blocks is sliced by one task, which the query blocks visit;
    only k rows of each visit are shuffled. Queries are copied once a group, in
    rounds whose copies are no larger than the index, or ROUND_BYTES.
    """
    spark = vectors.sparkSession
    rows = finite_vectors(vectors)
    index = materialize(rows.mapInArrow(_blocks(BLOCK, 0, scale), BLOCKS_SCHEMA), "vector-blocks")
    queries = materialize(rows.where(F.col("vec_id") % every == 0).mapInArrow(_blocks(QUERIES, 1, scale), BLOCKS_SCHEMA), "query-blocks")
    size = F.coalesce(F.sum(F.octet_length("m") + F.octet_length("ids")), F.lit(0)).alias("bytes")
    whole, asked = (t.agg(F.count("*").alias("blocks"), size).first() for t in (index, queries))
    groups = max(1, min(whole["blocks"], max(spark.sparkContext.defaultParallelism, -(-whole["blocks"] // GROUP))))
    rounds = max(1, -(-asked["bytes"] * groups // max(ROUND_BYTES, whole["bytes"])))
    index = index.withColumn("part", F.pmod("part", F.lit(groups)))
    found = []
    for r in range(rounds):
        now = queries if rounds == 1 else queries.where(F.pmod(F.xxhash64("number"), F.lit(rounds)) == r)
        visits = now.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        met = index.unionByName(visits).repartitionById(groups, F.col("part").cast("int")).sortWithinPartitions("part", "kind", "number")
        best = met.mapInArrow(_search(k), "number long, i long, query_id long, vec_id long, score long, beyond string")
        found.append(best if rounds == 1 else materialize(best, "visits"))
    rank = F.row_number().over(Window.partitionBy("number", "i").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, r.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), t AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
