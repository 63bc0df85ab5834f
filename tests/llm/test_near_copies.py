import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import common, near_copies, planes, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_kept(rows):
    """Ids of the first of each group that pairs of Jaccard similarity 0.8 or more link."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i] | sets[j])
            if not union or both / union >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if up[i] == i}


def edited(seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = r.choices(words, k=40)  # a passage that many texts hold
    rows = []
    for _ in range(60):
        base = r.choices(words, k=r.choice([4, 7, 80, 150, 400])) + (common if r.random() < 0.5 else [])
        for _ in range(r.choice([1, 2, 6])):
            t = list(base)
            for _ in range(r.randrange(0, 2 + len(base) // 30)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t).title() if r.random() < 0.2 else " ".join(t)))
    return [*rows, (900, None), (901, ""), (902, " \n")]


@pytest.mark.parametrize("most", [1024, 3])
def test_stage_by_brute_force(make_docs, spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "MOST", most)  # with 3, groups are split into pairs of chunks
    rows = edited()
    df = make_docs(rows)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(plain_kept(rows))


def test_odd_rows(odd):
    df, rows = odd
    kept = simhash.keep_representatives(df, shingle=5, radius=28, least=0.8).collect()
    assert len({(x["doc_id"], x["text"]) for x in kept}) == len(kept) < len(rows)
    assert sum(x["doc_id"] in (100, 101, 102) for x in kept) == 1
    assert simhash.keep_representatives(df.limit(0), shingle=5, radius=28, least=0.8).count() == 0


@pytest.mark.parametrize("n,radius", [(1, 0), (5, 3), (64, 20), (65, 28), (500, 25)])
def test_lanes_by_counting(n, radius):
    r = np.random.default_rng(n)
    fps = r.integers(0, 1 << 64, n, dtype=np.uint64)
    fps[::3] = fps[0] ^ (np.uint64(1) << r.integers(0, 64, len(fps[::3]), dtype=np.uint64))
    lanes = r.random(n) < 0.7
    got = planes.near_lanes(planes.bit_planes(fps), int(fps[0]), radius, lanes)
    assert got.tolist() == (lanes & (np.bitwise_count(fps ^ fps[0]) <= radius)).tolist()


def test_pairs_at_the_least_similarity_are_within_the_radius():
    """Fingerprints of sets at 0.8 or a little above, of all sizes."""
    r = np.random.default_rng(3)
    far = 0
    for n in (4, 5, 8, 9, 12, 18, 45, 90, 400):
        for _ in range(300):
            common = r.integers(0, 1 << 64, n, dtype=np.uint64)
            more = int(n * 0.25)
            a = int(r.integers(0, more + 1))
            x, y = (np.r_[common, r.integers(0, 1 << 64, k, dtype=np.uint64)] for k in (a, more - a))
            assert n / (n + more) >= 0.8
            far = max(far, (near_copies.set_fingerprint(x) ^ near_copies.set_fingerprint(y)).bit_count())
    assert far <= near_copies.RADIUS


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"the same text {i // 2} in two rows of this table", i, "a", "b") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __lg_id int, r string, t string")
    for kept in (simhash.keep_representatives(df, shingle=5, radius=28, least=0.8), simhash.keep_representatives(df)):
        assert kept.columns == df.columns and sorted(tuple(x) for x in kept.collect()) == rows[::2]


@pytest.mark.parametrize("most", [4096, 1])
def test_texts_meet_by_bits_of_their_fingerprints(spark, monkeypatch, most):
    """Fingerprints alone, without a text or a set: those that differ in 16 % of their bits are joined, unlike ones are not."""
    monkeypatch.setattr(near_copies, "MOST_OF_KEY", most)  # with 1, keys are split into pairs of chunks
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 64, (100, 8), dtype=np.uint64)
    flips = np.packbits(r.random((100, 512)) < 0.16, axis=1, bitorder="little").view("<u8")
    rows = [(i, *f) for i, f in enumerate(np.concatenate([base, base ^ flips]).view(np.int64).tolist())]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{i} long" for i in range(8)))
    assert {(min(e), max(e)) for e in near_copies.linked_nodes(nodes).collect()} == {(i, i + 100) for i in range(100)}


@pytest.mark.parametrize("d", [1, 3, 63, 64, 65, 130, 640, 699])
@pytest.mark.parametrize("share", [0.02, 0.9])
def test_shifted_lanes_by_counting(d, share):
    r = np.random.default_rng(d)
    fps = r.integers(0, 1 << 64, (700, 4), dtype=np.uint64)
    fps[d:] = np.where(r.random((700 - d, 1)) < 0.3, fps[:-d] ^ np.packbits(r.random((700 - d, 256)) < 0.25, axis=1, bitorder="little").view("<u8"), fps[d:])
    live = np.zeros(704, dtype=bool)
    live[: 700 - d] = r.random(700 - d) < share
    got = planes.near_shifted(planes.bit_planes(fps), d, np.packbits(live, bitorder="little").view("<u8"), 66, 34)
    x = np.bitwise_count(fps[d:] ^ fps[:-d]).astype(int)
    want = np.r_[(x.sum(1) <= 66) & (x[:, :2].sum(1) <= 34), np.zeros(d + 4, dtype=bool)] & live
    assert np.unpackbits(got.view(np.uint8), bitorder="little").astype(bool).tolist() == want.tolist()


def shuffled_bytes(spark):
    """What all stages so far have written for others."""
    store = spark.sparkContext._jsc.sc().statusStore()
    return sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())))


@pytest.mark.parametrize("least", [0.8, None])
def test_texts_without_near_copies_are_not_shuffled(spark, make_docs, least):
    r = random.Random(2)
    rows = [(i, " ".join(f"{r.getrandbits(128):032x}" for _ in range(2000))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(2)] + [rows[5]]
    df = simhash.materialize(make_docs(rows), "input")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        before = shuffled_bytes(spark)
        kept = simhash.materialize(simhash.keep_representatives(df, shingle=5, radius=78, least=least), "kept-rows")
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(x["doc_id"] for x in kept.select("doc_id").collect()) == list(range(60))
    assert moved < sum(len(t) for _, t in rows) * 0.7


@pytest.mark.parametrize("most", [1 << 20, 4, 1])
def test_filter_lets_all_rows_of_the_few_pass(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FILTER_WORDS", most)  # with 1, most bits are set
    rows = spark.range(2000).select("id", F.xxhash64("id").alias("x"), F.lit("among").alias("h"))
    few = rows.where("id % 40 = 3").select(F.col("x").alias("h"))
    got = {i: a for i, _, _, a in common.flag_among(rows, F.col("x"), few).collect()}
    assert len(got) == 2000 and all(got[i] for i in range(3, 2000, 40))
    assert most == 1 or not all(got.values())
    none = common.flag_among(rows, F.col("x"), few.limit(0))
    assert none.columns == [*rows.columns, "among"] and none.where("among").count() == 0 and none.count() == 2000
