import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, quality, queries, simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=4):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("seed,radius", [(0, 4), (1, 4), (2, 4), (3, 2), (4, 6)])
def test_bit_sliced_links(seed, radius):
    r = random.Random(seed)
    keys, fps = [], []
    for key in range(30):
        centre = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 5, 150])):
            x = centre
            for b in r.sample(range(64), r.randrange(0, 9)):
                x ^= 1 << b
            keys.append(key)
            fps.append(x)
    label = simhash.link_sorted(np.array(keys), np.array(fps, dtype=np.uint64), radius)
    for key in set(keys):
        at = [i for i, k in enumerate(keys) if k == key]
        want = classes([fps[i] for i in at], radius)
        assert label[at].tolist() == [at[w] for w in want]


def near_copies(seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(25):
        base = r.choices(words, k=r.choice([3, 60, 200]))
        for _ in range(r.choice([1, 1, 2, 12])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), " ".join(t).title() if r.random() < 0.3 else " ".join(t), "en", "s"))
    return rows


@pytest.mark.parametrize("most", [4096, 3])
def test_near_duplicates(make_docs, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)  # with 3, keys are split into pairs of chunks
    rows = near_copies() + [(900, None), (901, ""), (902, " \n"), (903, "ÄB äb"), (None, "w1 w2 w3 w4 w5 w6"), (5, "an id twice, another text")]
    fps = [plain_fingerprint(r[1]) for r in rows]
    want_root = classes(fps)
    least = {}
    for r, c in zip(rows, want_root):
        if r[0] is not None:
            least[c] = min(least.get(c, 10**9), r[0])
    want = sorted(repr((r[0], f"{f:016x}", least.get(c))) for r, f, c in zip(rows, fps, want_root))
    df = make_docs(rows)
    assert sorted(repr(tuple(x)) for x in simhash.digest(simhash.near_duplicates(df)).collect()) == want
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns and kept.count() == len(set(want_root))
    assert {x["doc_id"] for x in kept.collect()} == set(least.values()) | {None}


def test_one_large_group(make_docs):
    r = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:k] + ["zz"] + base[k + 1 :])) for i in range(300) for k in [r.randrange(400)]] + [(1000 + i, "copy of one text only") for i in range(500)]
    fps = [plain_fingerprint(t) for _, t in rows]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(make_docs(rows)).collect()}
    roots = classes(fps)
    assert got == {r[0]: rows[c][0] for r, c in zip(rows, roots)}


def test_near_duplicates_of_odd_rows(odd):
    df, rows = odd
    out = simhash.near_duplicates(df).collect()
    assert sorted(map(repr, (x["doc_id"] for x in out))) == sorted(map(repr, (r[0] for r in rows)))
    assert {x["component_id"] for x in out if x["doc_id"] in (100, 101, 102)} == {100}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_representatives(df.limit(0)).count() == 0
    assert simhash.keep_representatives(df).count() == len({x["root"] for x in out})


# -- lines


def h64(x, seed=42):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(x, seed)))[0]


def plain_line_dedup(rows, run, gram):
    """The same rules line by line in plain Python; rows of (doc_id, text) with distinct ids."""
    docs = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        x = [(h64(l.encode()), len(re.findall(r"[^\x20\x09-\x0D]+", l)), i) for i, l in enumerate(lines)]
        docs[doc] = [t for t in x if t[1]]

    def end(x, i, least):
        n = 0
        for j in range(i, len(x)):
            n += x[j][1]
            if n >= least:
                return j
        return None

    def fold(x, i, j):
        a = 42
        for k in range(i, j + 1):
            a = h64(struct.pack("<q", x[k][0]), a % 2**64)
        return a

    chosen, reaches = set(), []
    for doc, x in docs.items():
        for i in range(len(x)):
            e = end(x, i, run)
            if e is not None:
                grams = [(fold(x, j, g), j) for j in range(i, e + 1) for g in [end(x[: e + 1], j, gram)] if g is not None]
                fp, j = min(grams)
                chosen.add((doc, j, fp))
                reaches.append((doc, i, e, tuple(t[0] for t in x[i : e + 1])))
    first = {}
    for doc, j, fp in sorted(chosen):
        first.setdefault(fp, (doc, j))
    cut = {d: set() for d in docs}

    def around(x, j, way):
        """Places of lines that begin less than ``run`` words after j begins, or up to ``run`` words before."""
        start = np.cumsum([0] + [t[1] for t in x])
        return [q for q in (range(j, len(x)) if way > 0 else range(j - 1, -1, -1)) if (start[q] - start[j] < run if way > 0 else start[j] - start[q] <= run)]

    for doc, j, fp in chosen:
        d0, j0 = first[fp]
        if (d0, j0) == (doc, j):
            continue
        a, b = docs[doc], docs[d0]
        ends = []
        for way in (1, -1):
            last = j
            for q, q0 in zip(around(a, j, way), around(b, j0, way)):
                if a[q][0] != b[q0][0]:
                    break
                last = q
            ends.append(last)
        cut[doc] |= set(range(a[ends[1]][2], a[ends[0]][2] + 1))
    seen = set()
    for doc, i, e, whole in sorted(reaches):
        if whole in seen:
            cut[doc] |= set(range(docs[doc][i][2], docs[doc][e][2] + 1))
        seen.add(whole)
    return {doc: None if text is None else "\n".join(l for i, l in enumerate(text.split("\n")) if i not in cut[doc]) for doc, text in rows}


def shared_passages(seed):
    r = random.Random(seed)
    line = lambda k: " ".join(f"w{r.randrange(3000)}" for _ in range(k))
    passages = [[line(r.choice([3, 10, 30, 70])) for _ in range(r.randrange(1, 6))] for _ in range(8)]
    common = [line(6) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            kind = r.random()
            lines += r.choice(passages) if kind < 0.4 else [r.choice(common)] if kind < 0.6 else [""] if kind < 0.7 else [line(r.randrange(1, 30))]
        rows.append((i, "\n".join(lines)))
    return rows


def earlier_runs(rows, least):
    """Lines (doc, place) that begin a run of ``least`` words seen at an earlier place."""
    seen, out = set(), 0
    for doc, text in sorted(rows):
        x = [l for l in (text or "").split("\n") if l.split()]
        for i in range(len(x)):
            n, j = 0, i
            while j < len(x) and n < least:
                n += len(x[j].split())
                j += 1
            if n >= least:
                g = "\n".join(x[i:j])
                out += g in seen
                seen.add(g)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_by_plain_rules(make_docs, seed):
    rows = shared_passages(seed) + [(100, None), (101, ""), (102, "\n\n"), (103, "again and again\n" * 40)]
    df = make_docs(rows)
    out = line_dedup.dedup_lines(df, 50, 25)
    assert out.schema == df.schema
    got = {x["doc_id"]: x["text"] for x in out.collect()}
    assert got == plain_line_dedup(rows, 50, 25)
    assert earlier_runs(rows, 50) > 0 and earlier_runs(list(got.items()), 50) == 0  # the guarantee
    counts = {x["doc_id"]: (x["n_lines"], x["n_removed"]) for x in line_dedup.digest(df, 50, 25).collect()}
    assert counts[100] == (0, 0) and counts[103][1] >= 35


def test_runs_that_are_not_in_the_first_document(make_docs, spark, tmp_path):
    """The first document has only the gram that is least in a passage of two later ones."""
    r = random.Random(7)
    line = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(10))
    rows = []
    for _ in range(150):
        passage = [line() for _ in range(7)]
        at = r.randrange(0, 5)
        for part in (passage[at : at + 3], passage, passage):
            rows.append((len(rows), "\n".join([line() for _ in range(3)] + part + [line() for _ in range(3)])))
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x["text"].split("\n") for x in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    left = {doc for doc, text in rows if doc % 3 == 2 and got[doc] != text.split("\n")[:3] + text.split("\n")[-3:]}
    assert not left


def test_clean_lines_stay(make_docs):
    r = random.Random(2)
    rows = [(i, "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(12)) for _ in range(9)) + "\nAll rights reserved.") for i in range(30)]
    assert {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(make_docs(rows)).collect()} == dict(rows)


def test_line_dedup_of_odd_rows(odd):
    df, rows = odd
    out = line_dedup.dedup_lines(df)
    assert out.count() == len(rows)
    texts = [x["text"] for x in out.where("doc_id = 3").collect()]
    assert len(texts) == 3 and len(set(texts)) == 1  # equal rows count as one
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("line,times", [("the same line of text", 16_000), ("x", 200_000), ("one\ntwo three four\nfive", 40_000)])
def test_repetitive_texts_take_no_quadratic_time(make_docs, line, times):
    began = time.time()
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(make_docs([(1, "\n".join([line] * times)), (2, "alone")])).collect()}
    assert len(got[1].split()) <= 60 and got[2] == "alone" and time.time() - began < 60


def test_columns_of_any_name_stay(spark):
    rows = [(i, "w " * 60 + "\nown " + str(i), i, "a", "b", "c") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __lg_lines int, r string, cuts string, kept string")
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [x.asDict() | {"text": None} for x in got] == [dict(zip(df.columns, r)) | {"text": None} for r in rows]
    assert [x["text"] for x in got] == [rows[0][1], "own 1", "own 2"]


# -- quality


def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    covered = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(3)}
    lines = [l for l in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(odd, make_docs):
    df, rows = odd
    r = random.Random(9)
    more = [(300 + i, "".join(r.choices(["a", "b", "é", "\U0001f600", " ", "\n", "\t", "\x0b", " ", "#", "|", "! "], k=60))) for i in range(60)]
    for table, source in ((df, rows), (make_docs(more), more)):
        out = quality.digest(quality.judge(table)).collect()
        got = sorted(repr((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])) for x in out)
        assert got == sorted(repr((s[0], *plain_counts(s[1]))) for s in source)
        for x in out:
            assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
            assert not (x["kept"] and x["base_failed"])
    assert quality.judge(df.limit(0)).count() == 0


def test_posterior_tells_junk_from_clean(make_docs):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(3, 9)))
    text = lambda n=120: " ".join(word() for _ in range(n))
    rows = [(i, text()) for i in range(300)]
    rows += [(1000 + i, text().replace(" ", "### ")) for i in range(15)] + [(1100 + i, text().upper().replace(" ", "!! ")) for i in range(15)]
    rows += [(1200 + i, " ".join([text(6)] * 20)) for i in range(15)]
    kept = {x["doc_id"]: x["kept"] for x in quality.judge(make_docs(rows)).collect()}
    assert all(kept[i] for i in range(300)) and not any(v for i, v in kept.items() if i >= 1000)


def plain_em(said, prior, steps):
    """The same model, text by text."""
    v = np.array(said)
    share, on_good, on_bad = 0.9, np.full(v.shape[1], 0.05), np.full(v.shape[1], 0.5)
    for _ in range(steps):
        like = [np.prod(np.where(v < 0, b, np.where(v > 0, 1 - b, 1.0)), axis=1) for b in (on_good, on_bad)]
        p = share * like[0] / (share * like[0] + (1 - share) * like[1])
        share = (p.sum() + 0.9) / (len(v) + 1)
        on_good, on_bad = ((b0 + (w[:, None] * (v < 0)).sum(0)) / (b0 + g0 + (w[:, None] * (v != 0)).sum(0)) for w, (b0, g0) in zip((p, 1 - p), prior))
    return share, on_good, on_bad


def test_em_by_plain_em(spark):
    r = np.random.default_rng(0)
    names = ["a", "b", "c", "d", "e"]
    good, bad = [0.02, 0.3, 0.01, 0.1, 0.05], [0.9, 0.35, 0.8, 0.6, 0.5]
    said = []
    for _ in range(4000):
        p = good if r.random() < 0.8 else bad
        said.append([0 if r.random() < 0.2 else -1 if r.random() < p[k] else 1 for k in range(5)])
    votes = spark.createDataFrame([tuple(map(int, s)) for s in said], ", ".join(f"v_{n} int" for n in names))
    patterns = quality.patterns_of(votes, names)
    assert sum(n for _, n in patterns) == 4000
    m = quality.LabelModel(names).fit(patterns)
    share, on_good, on_bad = plain_em(said, m.PRIOR, m.steps)
    assert m.steps < quality.EM_STEPS and m.share == pytest.approx(share) and m.bad_on_good == pytest.approx(list(on_good)) and m.bad_on_bad == pytest.approx(list(on_bad))
    assert abs(m.share - 0.8) < 0.03 and all(abs(x - y) < 0.07 for x, y in zip(m.bad_on_bad, bad))
    # a vote of a rule that blames good texts as often does not decide
    one = votes.limit(1).select(*(F.lit(x).alias(f"v_{n}") for n, x in zip(names, (1, -1, 1, 1, 1)))).select(m.quality().alias("q"))
    assert one.first()["q"] > 0.95


def test_posterior_keeps_texts_that_break_a_rule(make_docs):
    r = random.Random(4)
    word = lambda: r.choice(["the", "of", "a"]) if r.random() < 0.3 else "".join(r.choices("abcdefghij", k=r.randrange(3, 9)))
    text = lambda end: " ".join(word() for _ in range(120)) + end
    rows = [(i, text("." if i % 10 else ":")) for i in range(300)] + [(1000 + i, text("").replace(" ", "### ")) for i in range(20)]
    got = {x["doc_id"]: x for x in quality.judge(make_docs(rows)).collect()}
    assert got[0]["v_ends"] == got[1000]["v_ends"] == -1
    assert all(got[i]["kept"] for i in range(300)) and not any(got[1000 + i]["kept"] for i in range(20))
    assert quality.LabelModel(["a"]).fit([]).share == 0.9
