from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import bitsliced, mixing
from graphloom.llm.bitsliced import SlicedBlock, top_inner_products


@pytest.mark.parametrize("seed", range(12))
def test_slices_give_the_best_rows(seed):
    r = np.random.default_rng(seed)
    n, d = int(r.choice([1, 5, 63, 64, 65, 300])), int(r.choice([1, 3, 16]))
    x = r.integers(-300, 300, (n, d)) if seed % 3 else r.integers(0, 2, (n, d))
    ids = r.permutation(n) * 3
    block = SlicedBlock(ids, x)
    for _ in range(8):
        q = r.integers(-300, 300, d) if seed % 4 else np.zeros(d, dtype=np.int64)
        own, k = int(r.choice(ids)), int(r.choice([1, 5]))
        want = sorted(((-int(v @ q), int(i)) for i, v in zip(ids, x) if i != own))[:k]
        assert sorted((-s, i) for i, s in block.top(q, own, k)) == want


def test_top_k_table(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(v) for v in r.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(400, None), (450, [float("nan")] * 8), (None, [1.0] * 8), (500, [1.0, None] + [0.0] * 6), (550, [float("inf")] * 8), (600, []), (650, [0.5, 0.5])]
    rows += [(i, [0.25] * 8) for i in range(1000, 1100)] + [(50, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, score string")
    q = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v))
    good = [(i, q(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in good:
        if i % 50 == 0:
            best = sorted((-int(np.dot(v, w)), j) for j, w in good if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(x) for x in top_inner_products(df).collect()) == sorted(want)
    assert top_inner_products(df.limit(0)).count() == 0
    assert top_inner_products(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("round_bytes", [1 << 30, 500])
def test_components_of_any_size(spark, monkeypatch, round_bytes):
    """Finite components take part however large; ranks are exact, scores end where a long does."""
    monkeypatch.setattr(bitsliced, "ROUND_BYTES", round_bytes)
    monkeypatch.setattr(bitsliced, "BLOCK", 16)
    r = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in r.normal(0, 0.3, 4)]) for i in range(60)]
    rows += [(100, [1e20, 0.0, -1.0, 0.25]), (150, [-1e20, 1e20, 0.5, 0.0]), (101, [1e300, -1e300, 1.0, 2.0]), (102, [-1e300, 0.0, 0.0, 0.0]), (103, [3e9 + 0.3, -2.0**40 - 0.7, 1.0, 0.0]), (104, [1.7e308, 1.0, 1.0, 1.0])]
    rows += [(200, [2.0**23, 2.0**23, 2.0**23, 2.0**23]), (201, [2.0**22.99] * 4), (202, [-(2.0**22.99)] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = {i: [int(Fraction(x) * 256 // 1) for x in v] for i, v in rows}
    want = []
    for i in (i for i in q if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i)[:5]
        want += [(i, k + 1, j, max(-(2**63), min(2**63 - 1, -s))) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(x) for x in top_inner_products(df).collect()) == sorted(want)
    order = sorted([0, 5, 2**63, 2**63 - 2, 2**63 - 1, 10**30, 10**29 + 1, -(2**63), -(2**63) + 1, -(10**30), -(10**25)])
    assert sorted(order, key=bitsliced.as_long) == order


def test_one_id_of_very_many_rows(spark):
    hot = spark.range(100_000).selectExpr("1L AS vec_id", "array(float(id % 7), 1.0f, float(-id % 3)) AS embedding")
    df = hot.union(spark.range(2, 61).selectExpr("id AS vec_id", "array(float(id), 0.0f, 1.0f) AS embedding"))
    got = top_inner_products(df).orderBy("rank").collect()
    assert [(x["query_id"], x["rank"], x["vec_id"]) for x in got] == [(50, 1, 60), (50, 2, 59), (50, 3, 58), (50, 4, 57), (50, 5, 56)]


def water_fill(sizes, weights):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        over = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(2))
def test_mix(make_docs, seed):
    r = np.random.default_rng(seed)
    sources = ["b", "a", "é", "Z", None, "tiny"]
    rows = [(int(i), " ".join(["w"] * int(r.integers(0, 60))), "en", sources[int(r.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1]))]) for i in range(3000)]
    rows += [(9001, "one two", "en", "tiny"), (9002, None, "en", "empty"), (None, "a b c", "en", "a"), rows[0], rows[0]]
    rows += [(i, "the very same words here", "en", "b") for i in range(20_000, 24_500)]  # more equal sizes than are ranked together
    df = make_docs(rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes, taken, target = {}, {}, {}
    for x in out:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        target[x["source"]] = x["target"]
        assert x["taken"] % max(1, x["size"]) == 0 and x["taken"] <= 3 * x["size"]
    assert all(x["source_size"] == sizes[x["source"]] for x in out)
    want = water_fill(sizes, (5, 2, 1))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 0.005 * target[s] + 4, s
    if seed == 0:  # reruns agree, however rows are spread
        assert sorted(map(repr, mixing.digest(mixing.mix(df.repartition(7))).collect())) == sorted(map(repr, mixing.digest(mixing.mix(df)).collect()))


def plain_balance(groups, target, most=3.0, ridge=mixing.RIDGE):
    """The same dual by coordinate descent: each multiplier in turn by bisection. groups: source, size, n."""
    w = np.array([n * size for _, size, n in groups], dtype=float)
    x = np.log([size for _, size, _ in groups])
    mean = (w * x).sum() / w.sum()
    c = np.clip((x - mean) / np.sqrt((w * (x - mean) ** 2).sum() / w.sum()), -mixing.REACH, mixing.REACH)
    z = np.stack([c - (w * c).sum() / w.sum(), c**2 - (w * c**2).sum() / w.sum()])
    of = np.array([g[0] for g in groups])
    total = {s: w[of == s].sum() for s in target}
    fixed = {s: target[s] >= most * total[s] * (1 - 1e-9) for s in target}
    lam, mu = {s: 0.0 for s in target}, np.zeros(2)

    def rate():
        return np.array([most if fixed[s] else 1.0 for s in of]) * np.where([fixed[s] for s in of], 1, np.minimum(most, np.exp([lam[s] for s in of] + mu @ z)))

    def solve(put, gradient):
        low, high = -30.0, 30.0
        for _ in range(100):
            put((low + high) / 2)
            low, high = (low, (low + high) / 2) if gradient() > 0 else ((low + high) / 2, high)

    for _ in range(150):
        for s in target:
            if not fixed[s]:
                solve(lambda v: lam.__setitem__(s, v), lambda: (w * rate())[of == s].sum() - target[s])
        for j in range(2):
            solve(lambda v: mu.__setitem__(j, v), lambda: (w * rate() * z[j]).sum() + ridge * sum(target.values()) * mu[j])
    return rate(), mu


def test_rates_by_plain_balancing(spark):
    r = np.random.default_rng(5)
    groups = [(s, size, int(r.integers(1, 9))) for s, low, high in (("a", 1, 900), ("b", 30, 400), ("c", 100, 2000), ("d", 5, 50)) for size in sorted({int(v) for v in r.integers(low, high, 25)})]
    total = {s: float(sum(n * size for k, size, n in groups if k == s)) for s in "abcd"}
    target = {"a": 2.6 * total["a"], "b": 1.4 * total["b"], "d": 3 * total["d"]}
    target["c"] = sum(total.values()) - sum(target.values())
    df = mixing.with_moments(spark.createDataFrame(groups, "source string, size long, n long")).cache()
    targets = spark.createDataFrame([(s, int(total[s]), target[s]) for s in "abcd"], "source string, source_size long, target double")
    got = {(x["source"], x["size"]): x["rate"] for x in mixing.tilted_rates(df, targets).collect()}
    want, mu = plain_balance(groups, target)
    assert max(abs(mu)) > 0.05  # rates depend on documents
    assert [got[s, size] for s, size, _ in groups] == pytest.approx(list(want), rel=1e-3)
    for s in "abcd":
        assert sum(n * size * got[s, size] for k, size, n in groups if k == s) == pytest.approx(target[s], rel=1e-6)
        assert len({round(got[k, size], 6) for k, size, _ in groups if k == s}) > 1 or s == "d"


def test_targets_by_sql(spark, make_docs, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    r = np.random.default_rng(3)
    rows = [(int(i), " \t".join(["w\u00e9"] * int(r.integers(0, 90))), "en", f"s{int(r.integers(0, 9)) ** 2}") for i in range(900)] + [(1000, None, None, None), (1001, "x y", "en", None)]
    make_docs(rows).write.parquet(str(tmp_path / "d"))
    want = duckdb.sql(mixing.TARGETS_SQL.replace("FROM documents", f"FROM '{tmp_path}/d/*.parquet'")).fetchall()
    got = [(x["doc_id"], x["size"], x["source_size"], x["target"]) for x in mixing.mix(make_docs(rows)).collect()]
    assert [(g[:3], pytest.approx(g[3])) for g in sorted(got)] == [(w[:3], w[3]) for w in sorted(want)]


def test_expand(make_docs):
    rows = [(i, "w " * (i % 9 + 1), "en", "a" if i % 4 else "b") for i in range(400)] + [(1000, "", "en", "a"), (1001, None, None, None)] + [(5, "w " * 6, "en", "a")]
    df = make_docs(rows)
    out = mixing.expand(df)
    assert out.columns == df.columns
    plan = {}
    for x in mixing.mix(df).collect():
        plan[x["doc_id"]] = plan.get(x["doc_id"], 0) + (x["copies"] if x["size"] else 1)
    got = {}
    for x in out.collect():
        got[x["doc_id"]] = got.get(x["doc_id"], 0) + 1
    assert got == {k: v for k, v in plan.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.expand(df.limit(0)).count() == 0


def test_odd_rows(odd):
    df, rows = odd
    out = mixing.mix(df).collect()
    assert sorted(map(repr, (x["doc_id"] for x in out))) == sorted(map(repr, (r[0] for r in rows)))
