"""SimHash near-dedup at a wide radius: one text of each group of Jaccard similarity LEAST or more.

Fingerprints of word-shingle sets are compared on 256 bits: sets at 0.8 differ
in 39 of them as a rule, unlike ones in some 128, and a radius between the two
tells them apart. No run of bits is sure to be equal at such a radius, so rounds
deal the bits (and as many more) into keys again and again, until odds are under
MISS that a pair at LEAST shares none. Fingerprints that share a key are compared
bit-sliced; sets of those that links lead to are then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flag_among, free_shuffles, materialize, pieces, releasing, shuffles_held, task_count, temporary_tables, text_or_empty
from .components import connected_components
from .planes import bit_planes, near_lanes, near_shifted
from .simhash import link_sorted

SEED = 42
SHINGLE = 5
LEAST = 0.8
#: Bits that keys are made of, and how many of them, the first, are compared.
BITS, COMPARED = 512, 256
WORDS = [f"f{i}" for i in range(BITS // 64)]
SENT = WORDS[: COMPARED // 64]
#: Of fingerprints of pairs at 0.8 one in some 1e6 differs in more bits; of unlike ones one in 1e9 does not.
RADIUS = 78
#: The most of the first half of the bits, so that most comparisons end there; one such pair in some 1e6 differs in more.
HALF = 44
#: The most odds that sets of four shingles and five share no key, which differ in more bits than any other pair at 0.8. Others miss each other far less often.
MISS = 1e-3
#: Bits of a key; more, once that leaves over CROWD fingerprints a key on average.
WIDTH, CROWD = 13, 32
#: Texts of one group that one task compares; more are split into pairs of chunks.
MOST = 1024
#: The same for fingerprints of one key.
MOST_OF_KEY = 4096


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Rising distinct XXH64 hashes of the shingles; a shorter text is one shingle, a text without a word has none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64, count=len(grams)))


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """The hashes, and further words of bits made of them."""
    x = h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = h
    return x


def fingerprint_words(own: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A bit is 1 if it is set in over half the hashes of a set; no hash: 0."""
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(own), 255):  # so many ones fit a byte
        ones += np.unpackbits(_mixed(own[at : at + 255], bits // 64).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(own), bitorder="little").view("<u8")


def set_fingerprint(own: np.ndarray) -> int:
    return int.from_bytes(fingerprint_words(own, COMPARED).tobytes(), "little")


def _sketches(shingle: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, 2)):
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(2)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            words = np.array([fingerprint_words(s) for s in sets], dtype=np.uint64).reshape(-1, len(WORDS)).view(np.int64)
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), size, *(pa.array(w) for w in words.T.copy())], ["doc_id", "tx", "node", "size", *WORDS])

    return run


def most_difference(least: float, upto: int = 40) -> float:
    """The odds that a fingerprint bit differs between two sets of that similarity, for sizes where they are highest."""

    def odds(common: int, a: int, b: int) -> float:
        above = lambda extra, n, x: sum(math.comb(extra, i) for i in range(extra + 1) if x + i > n // 2) / 2**extra
        out = 0.0
        for x in range(common + 1):
            p, q = above(a, common + a, x), above(b, common + b, x)
            out += math.comb(common, x) / 2**common * (p * (1 - q) + q * (1 - p))
        return out

    worst = math.acos(2 * least / (1 + least)) / math.pi
    for common in range(1, upto):
        more = int(common * (1 / least - 1) + 1e-6)
        worst = max([worst, *(odds(common, a, more - a) for a in range(more // 2 + 1))])
    return worst


def missed(width: int, keys: int, odds: float) -> float:
    """The odds that fingerprints whose bits differ with those odds share none of the keys."""
    out = 0.0
    for d in range(BITS + 1):
        share = math.comb(BITS - d, width) / math.comb(BITS, width)
        out += math.comb(BITS, d) * odds**d * (1 - odds) ** (BITS - d) * (1 - share) ** keys
    return out


def plan(n: int, least: float) -> tuple[int, int]:
    """Bits of a key and rounds of keys for n fingerprints; each round cuts all bits into keys."""
    width, rounds, odds = max(WIDTH, math.ceil(math.log2(max(n, 1) / CROWD))), 1, most_difference(least)
    while missed(width, rounds * (BITS // width), odds) > MISS:
        rounds += 1
    return width, rounds


def _keys(width: int, round_: int):
    """Rows (node, words) -> also keys: the number of a key and its bits, in the order dealt for the round."""
    many = BITS // width
    order = np.random.default_rng([SEED, round_]).permutation(BITS)[: many * width]
    worth = 1 << np.arange(width, dtype=np.int64)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([b.column(i).to_numpy() for i in range(1, 1 + len(WORDS))], axis=1)
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, order]
            keys = bits.reshape(-1, many, width) @ worth | np.arange(many) << 32
            offsets = pa.array(np.arange(0, keys.size + 1, many, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + len(SENT)], pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["node", *SENT, "keys"])

    return run


def _linked(radius: int):
    """Rows (key, node, words) sorted by key -> edges between a node and the first one of its key that it is linked to."""

    def links_of(key, node, *words):
        label = link_sorted(key, np.stack(words, axis=1).view(np.uint64), radius, partial(near_shifted, half=HALF))
        i = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[label[i]]), pa.array(node[i])], ["a", "b"])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        waiting = 0
        for b in batches:
            parts.append(tuple(c.to_numpy() for c in b.columns))
            waiting += b.num_rows
            if waiting >= 65_536:
                rows = [np.concatenate(x) for x in zip(*parts)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on in the next batch
                if cut:
                    yield links_of(*(x[:cut] for x in rows))
                parts, waiting = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
        if waiting:
            yield links_of(*(np.concatenate(x) for x in zip(*parts)))

    return run


def _split_hot(keyed: DataFrame) -> DataFrame:
    """Keys with over MOST_OF_KEY fingerprints become keys of pairs of chunks; each fingerprint goes to all pairs of its own chunk."""
    hot = keyed.groupBy("key").count().where(F.col("count") > MOST_OF_KEY)
    hot = materialize(hot.select(F.col("key").alias("hot"), F.ceil(F.col("count") * 2 / MOST_OF_KEY).alias("s")), "hot-keys")
    if hot.isEmpty():
        return keyed
    own = F.pmod(F.xxhash64("node"), F.col("s"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o)))
    return keyed.join(hot, keyed.key == hot.hot, "left").select(F.explode(F.when(F.col("s").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "node", *SENT)


def linked_nodes(nodes: DataFrame, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """(node, f0, ...) with nodes distinct -> edges (a, b) that join nodes as all pairs that share a key and are within the radius would."""
    spark = nodes.sparkSession
    n = nodes.count()
    width, rounds = plan(n, least)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (BITS // width) * 56 >> 24))
    free_shuffles(spark)
    out, held = None, shuffles_held(spark)
    for r in range(rounds):
        keyed = nodes.mapInArrow(_keys(width, r), f"node long, {', '.join(f'{w} long' for w in SENT)}, keys array<long>").select(F.explode("keys").alias("key"), "node", *SENT)
        rows = _split_hot(keyed).repartition(tasks, "key").sortWithinPartitions("key")
        found = materialize(rows.mapInArrow(_linked(radius), "a long, b long").distinct(), "links")
        out = found if out is None else out.union(found)
        free_shuffles(spark, held)  # else the next round's files would come on top of this one's
    return out


def links(sets: list[np.ndarray], least: float = LEAST, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs at ``least`` or more that join the sets of a group as all such pairs would.

    A set is compared with those only that nothing has led to yet, and exactly
    only with those whose fingerprint is within the radius.
    """
    sizes = np.array([len(s) for s in sets])
    _, all_ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(all_ids, np.cumsum(sizes)[:-1])
    marked = np.zeros(int(all_ids.max(initial=-1)) + 1, dtype=np.int64)
    words = np.array([fingerprint_words(s, COMPARED) for s in sets])
    planes = bit_planes(words)
    rest = np.ones(len(sets), dtype=bool)
    out: list[tuple[int, int]] = []
    queue: list[int] = []
    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first] = False
        queue = [first]
        while queue and rest.any():
            i = queue.pop()
            met = np.flatnonzero(near_lanes(planes, int.from_bytes(words[i].tobytes(), "little"), radius, rest))
            if not len(met):
                continue
            marked[parts[i]] = 1
            upto = np.r_[0, np.cumsum(marked[np.concatenate([parts[j] for j in met])])]
            marked[parts[i]] = 0
            ends = np.cumsum(sizes[met])
            common = upto[ends] - upto[ends - sizes[met]]
            union = sizes[met] + sizes[i] - common
            near = (common >= least * np.maximum(union, 1) - 1e-6) & (common / np.maximum(union, 1) >= least) | (union == 0)
            found = met[near].tolist()
            out += [(i, j) for j in found]
            rest[found] = False
            queue += found
    return out


def _compared(shingle: int, least: float, radius: int):
    """Rows (root, chunk, node, text) sorted by the first two -> edges between nodes whose texts are near copies."""

    def edges(rows: dict[int, str]):
        nodes = list(rows)
        pairs = links([shingle_set(t, shingle) for t in rows.values()], least, radius)
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for b in batches:
            for root, chunk, node, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (root, chunk) != key:
                    if len(rows) > 1:
                        yield edges(rows)
                    key, rows = (root, chunk), {}
                rows[node] = text
        if len(rows) > 1:
            yield edges(rows)

    return run


def _chunked(nodes: DataFrame) -> DataFrame:
    """Add chunk to (node, root): 0, or for groups of over MOST nodes the number of a pair of chunks."""
    hot = nodes.groupBy("root").count().where(F.col("count") > MOST).select("root", F.ceil(F.col("count") * 2 / MOST).cast("int").alias("s"))
    own = F.pmod(F.xxhash64("node"), F.col("s"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s").cast("long") - 1), lambda o: (F.least(own, o) * F.col("s") + F.greatest(own, o)).cast("int"))
    return nodes.join(materialize(hot, "hot-groups"), "root", "left").withColumn("chunks", F.when(F.col("s").isNull(), F.array(F.lit(0))).otherwise(pairs)).drop("s")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tx) of the first text of each group, and of all rows of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tx"), text_or_empty().alias("text"))
    with temporary_tables(spark):
        one = materialize(rows.mapInArrow(_sketches(shingle), f"doc_id long, tx long, node long, size long, {', '.join(f'{w} long' for w in WORDS)}"), "sketches", outlives=True)
        # of each set one text: the smallest (doc_id, tx)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tx")).alias("r")
        nodes = materialize(one.groupBy("node").agg(first, *(F.min(c).alias(c) for c in ("size", *WORDS))), "nodes")
        # of different sets, one shingle more than they share makes least > common / (common + 1) where they share fewer than this
        fewest = math.ceil(least / (1 - least) - 1e-6) if least < 1 else 1 << 62
        near = connected_components(linked_nodes(nodes.where(F.col("size") >= fewest).select("node", *WORDS), radius, least))
        near = materialize(_chunked(near).join(nodes, "node").select("node", "root", "chunks", F.col("r.doc_id").alias("id"), F.col("r.tx").alias("t")), "groups")
        # of most texts nothing else is near: they do not go through the shuffle of the join
        some = flag_among(rows, F.xxhash64("doc_id", "tx"), near.select(F.xxhash64("id", "t").alias("h"))).where("among")
        texts = some.join(near, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tx") == F.col("t"))).select("root", F.explode("chunks").alias("chunk"), "node", "text")
        met = texts.repartition(task_count(rows), "root", "chunk").sortWithinPartitions("root", "chunk", "node")
        roots = connected_components(met.mapInArrow(_compared(shingle, least, radius), "a long, b long"))
        of_root = nodes.join(roots, "node", "left").select("r", F.coalesce("root", "node").alias("root"))
        keep = materialize(of_root.groupBy("root").agg(F.min("r").alias("r")).select("r.doc_id", "r.tx"), "representatives", outlives=True)
        return keep, one.select("doc_id", "tx")
