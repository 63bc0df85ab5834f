"""SimHash near-duplicates by bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flag_among, free_shuffles, materialize, shuffles_held, task_count, temporary_tables, text_or_empty
from .components import connected_components
from .planes import bit_planes

SEED = 42
#: 64 bits in six runs. Fingerprints at 4 or fewer differing bits agree on two runs at least.
RUNS = (11, 11, 11, 11, 10, 10)
RADIUS = 4
#: Rows of one key that one task compares; more are split into pairs of chunks.
MOST = 4096


def fingerprint(text: str, shingle: int = 4) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes of the shingles; no word: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))]
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f)], ["doc_id", "tx", "fp"])

    return run


def _shift_down(planes: np.ndarray, d: int) -> np.ndarray:
    """Bit i of the result is bit i + d of the plane; planes are rows of 64-bit words."""
    words, bits = divmod(d, 64)
    out = np.zeros_like(planes)
    src = planes[:, words:]
    out[:, : src.shape[1]] = src >> np.uint64(bits)
    if bits and src.shape[1] > 1:
        out[:, : src.shape[1] - 1] |= src[:, 1:] << np.uint64(64 - bits)
    return out


def _within(planes: np.ndarray, d: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i at which the fingerprints i and i + d differ in ``radius`` bits or fewer, as a bitmap.

    Each plane's differences are added to counters of three bits that lie
    vertically, all lanes of a word at once; a fourth bitmap keeps what has run
    over. Words in which no lane is left within the radius are abandoned.
    """
    at = np.flatnonzero(lanes)
    if not len(at):
        return lanes
    other = _shift_down(planes, d)
    mine, other, alive = planes[:, at], other[:, at], lanes[at]
    ones, twos, fours, over = (np.zeros(len(at), dtype=np.uint64) for _ in range(4))
    for p in range(64):
        x = mine[p] ^ other[p]
        c = ones & x
        ones ^= x
        x = twos & c
        twos ^= c
        over |= fours & x
        fours ^= x
        if p % 8 == 7:
            above = over | (fours & (ones | twos)) if radius == 4 else over | _above(ones, twos, fours, radius)
            alive = alive & ~above
            keep = np.flatnonzero(alive)
            if not len(keep):
                return np.zeros_like(lanes)
            if len(keep) * 2 < len(alive):
                at, alive, mine, other = at[keep], alive[keep], mine[:, keep], other[:, keep]
                ones, twos, fours, over = ones[keep], twos[keep], fours[keep], over[keep]
    out = np.zeros_like(lanes)
    out[at] = alive
    return out


def _above(ones, twos, fours, radius: int):
    out = np.zeros_like(ones)
    for v in range(radius + 1, 8):
        out |= (fours if v & 4 else ~fours) & (twos if v & 2 else ~twos) & (ones if v & 1 else ~ones)
    return out


def link_sorted(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS, within=_within) -> np.ndarray:
    """Rows sorted by key; for each row the position of the first row that its links within the key lead to.

    ``within`` compares each lane with one further on; _within() knows 64 bits and radii under 8.
    """
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label
    planes = bit_planes(fps)
    words = planes.shape[1]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))  # one past each row's key
    left = ends - np.arange(n) - 1  # rows of its key that follow

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for d in range(1, int(left.max()) + 1):
        mask = np.zeros(words * 64, dtype=np.uint8)
        mask[:n] = left >= d
        hit = within(planes, d, np.packbits(mask, bitorder="little").view("<u8"), radius)
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        lanes = np.unpackbits(hit[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
        w, k = np.nonzero(lanes)
        i = at[w] * 64 + k
        i = i[label[i] != label[i + d]]
        for a in i.tolist():
            x, y = root(a), root(a + d)
            if x != y:
                label[max(x, y)] = min(x, y)
        if len(i):
            while not np.array_equal(label, label[label]):
                label = label[label]
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, chunk, fp) sorted by both -> edges between a fingerprint and the first one it is linked to."""

    def fresh(k, c):
        return np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]

    def links(k, c, f):
        label = link_sorted(np.cumsum(fresh(k, c)), f.view(np.uint64))
        i = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(f[label[i]]), pa.array(f[i])], ["a", "b"])

    parts: list[tuple] = []
    waiting = 0
    for b in batches:
        parts.append(tuple(b.column(i).to_numpy() for i in range(3)))
        waiting += b.num_rows
        if waiting >= 20_000:
            k, c, f = (np.concatenate(x) for x in zip(*parts))
            cut = int(np.flatnonzero(fresh(k, c))[-1])  # the last key may go on in the next batch
            if cut:
                yield links(k[:cut], c[:cut], f[:cut])
            parts, waiting = [(k[cut:], c[cut:], f[cut:])], len(k) - cut
    if waiting:
        yield links(*(np.concatenate(x) for x in zip(*parts)))


def _keyed(fps: DataFrame) -> DataFrame:
    """One row for each two runs of bits that a fingerprint may share with another."""
    starts = [sum(RUNS[:i]) for i in range(len(RUNS))]
    run = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, RUNS)]
    keys = [F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(run[i].cast("long"), 11)).bitwiseOR(run[j].cast("long")) for k, (i, j) in enumerate(combinations(range(len(RUNS)), 2))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _split_hot(keyed: DataFrame) -> DataFrame:
    """Add chunk: 0, or for keys with over MOST rows the number of a pair of chunks; each row goes to all pairs of its own chunk."""
    hot = materialize(keyed.groupBy("key").count().where(F.col("count") > MOST).select("key", F.ceil(F.col("count") * 2 / MOST).cast("int").alias("s")), "hot-keys")
    if hot.isEmpty():
        return keyed.select("key", F.lit(0).alias("chunk"), "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("s"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s").cast("long") - 1), lambda o: (F.least(own, o) * F.col("s") + F.greatest(own, o)).cast("int"))
    return keyed.join(hot, "key", "left").select("key", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("chunk"), "fp")


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp long) distinct -> (fp, root) for those with a link."""
    keyed = _keyed(fps)
    rows = _split_hot(keyed).repartition(task_count(keyed), "key", "chunk").sortWithinPartitions("key", "chunk", "fp")
    return connected_components(rows.mapInArrow(_links, "a long, b long")).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text) -> doc_id, tx, fp, root, component_id: fingerprints at RADIUS or fewer differing bits are linked.

    Every row of docs is returned. A null text is empty; texts without a word
    have fingerprint zero and are linked like any other; equal fingerprints
    are one node, so copies never meet in pairs; component_id is the smallest
    doc_id that links lead to (null only if all those are null); root is one of
    the component's fingerprints and tells components apart where an id occurs
    in several; tx is a hash of the text. Further columns are not read, and no
    rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("tx"))
    one = materialize(rows.mapInArrow(_fingerprints(shingle), "doc_id long, tx long, fp long"), "fingerprints")
    with temporary_tables(docs.sparkSession):
        nodes = materialize(one.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        roots = fingerprint_components(nodes.select("fp"))
        of = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = of.groupBy("root").agg(F.min("least").alias("component_id"))
        known = materialize(of.join(least, "root").select("fp", "root", "component_id"), "components", outlives=True)
    return one.join(known, "fp").select("doc_id", "tx", "fp", "root", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 4, radius: int = RADIUS, least: float | None = None) -> DataFrame:
    """The rows of docs, one of each group of near copies: that of the smallest doc_id, null last; of rows that share it, one of the smallest text hash.

    Without ``least`` a group is a component of fingerprints at RADIUS or fewer
    differing bits; with it, of texts whose fingerprints (of their distinct
    shingles) differ in ``radius`` bits or fewer and whose shingle sets have
    that Jaccard similarity or more, exactly. A null text is empty; texts
    without a word are copies of each other; further columns, whatever their
    names, are unchanged; no rows give no rows.
    """
    from . import near_copies

    held = shuffles_held(docs.sparkSession)
    with temporary_tables(docs.sparkSession):
        if least is not None:
            keep, found = near_copies.groups(docs, shingle, radius, least)
        else:
            found = materialize(near_duplicates(docs, shingle), "near-duplicates")
            first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tx")).alias("r")
            keep = found.groupBy("fp", "root").agg(first).groupBy("root").agg(F.min("r").alias("r")).select("r.doc_id", "r.tx")
        keep = materialize(keep.select(F.col("doc_id").alias("d"), F.col("tx").alias("t")), "kept", outlives=True)
        doubtful = materialize(_doubtful(found.select("doc_id", "tx"), keep), "doubtful")
        repeated = not doubtful.where("n > 1").isEmpty()
        rows = docs.select(F.struct("*").alias("r")).select("r", F.xxhash64(F.coalesce("r.text", F.lit(""))).alias("x"))
        rows = flag_among(rows, F.xxhash64(F.col("r.doc_id").cast("long"), "x"), doubtful.select("h"))
    free_shuffles(docs.sparkSession, held)  # texts may have been shuffled above
    out = rows.where("among").join(keep, F.col("r.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("x") == F.col("t")))
    if repeated:
        out = out.dropDuplicates(["d", "t"])
    return rows.where("not among").select("r.*").union(out.select("r.*"))


def _doubtful(found: DataFrame, keep: DataFrame) -> DataFrame:
    """(h, n) of the keys of rows that go, or of which there are several; all other rows of the table stay as they are. n: rows of that key."""
    both = found.select("doc_id", "tx", F.lit(1).alias("n"), F.lit(0).alias("k")).union(keep.select("d", "t", F.lit(0), F.lit(1)))
    of = both.groupBy("doc_id", "tx").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return of.where("n > 1 or k = 0").select(F.xxhash64("doc_id", "tx").alias("h"), "n")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
