import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import brown_lm, common, language, queries
from graphloom.llm.tokens import default_tokenizer

from test_dedup_quality import plain_line_dedup
from test_near_copies import plain_kept


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def language_rows(n=400, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"{p}{r.randrange(30)}" for p in ("the", "of")] if i % 2 else ["der", "und"]
        pool = [f"{'e' if i % 2 else 'd'}{k}" for k in range(60)]
        rows.append((i, " ".join(r.choice(words) if k % 2 else r.choice(pool) for k in range(r.randrange(5, 50)))))
    return rows


def plain_base(rows):
    c = Counter()
    for doc, text, *_ in rows:
        if not held(doc):
            c.update(tokens(text))
    n, v = sum(c.values()), len(c)
    return [(doc, held(doc), len(t := tokens(text)), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for doc, text, *_ in rows]


def check_base(out, rows):
    key = lambda x: (repr(x[0]), x[2], x[3], x[5])
    got = sorted(((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"]) for x in out), key=key)
    for a, b in zip(got, sorted(plain_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_scores(make_docs, monkeypatch):
    monkeypatch.setattr(brown_lm, "BATCH_BYTES", 4000)  # several batches
    rows = language_rows()
    out = brown_lm.score_texts(make_docs(rows), units=40, classes=12).collect()
    check_base(out, rows)
    test = [x for x in out if x["held_out"]]
    assert len(test) > 20 and sum(x["score"] for x in test) > sum(x["base_score"] for x in test)
    assert all(x["score"] < 0 for x in out)


def test_scores_by_plain_model(make_docs, monkeypatch):
    """Given the words' classes: bigram counts, chances and the sum over each text, token by token."""
    kept, models = {}, []
    real, label = brown_lm.materialize, brown_lm._label

    def keep(df, name, **options):
        out = real(df, name, **options)
        if name in ("word-batches", "word-classes"):
            kept[name] = out.collect()
        return out

    monkeypatch.setattr(brown_lm, "materialize", keep)
    monkeypatch.setattr(brown_lm, "_label", lambda model: (models.append(model), label(model))[1])
    monkeypatch.setattr(brown_lm, "BATCH_BYTES", 4000)
    rows = language_rows() + [(5000, None), (5001, ""), (5003, "the1 the1 never-seen")]
    out = {x["doc_id"]: x for x in brown_lm.score_texts(make_docs(rows), units=30, classes=9).collect()}
    model, cls = models[0], {}
    for b in kept["word-batches"]:
        h = np.frombuffer(b["h"], "<u8")
        parts = sorted((x["range"], x["classes"]) for x in kept["word-classes"] if x["batch"] == b["batch"])
        found = np.concatenate([np.frombuffer(zstandard.decompress(c), "<u2") for _, c in parts]).tolist() if parts else []
        for k, c in zip(h.tolist(), found):
            assert cls.setdefault(k, int(c) % brown_lm.SETTLED) == int(c) % brown_lm.SETTLED  # a word has one class
    of = lambda w: model.cls[brown_lm.END] if w is None else cls[xxhash.xxh64_intdigest(w)]
    count, pairs = Counter(), np.zeros((9, 9))
    for doc, text in rows:
        if not held(doc):
            t = tokens(text)
            count.update(t)
            for a, b in zip([None, *t], t):
                pairs[of(a), of(b)] += 1
    in_class, words = np.zeros(9), np.zeros(9)
    for w, n in count.items():
        in_class[of(w)] += n
        words[of(w)] += 1
    alone = (pairs.sum(0) + 0.1) / (pairs.sum() + 0.9)
    for doc, text in rows:
        t, want = tokens(text), 0.0
        for a, b in zip([None, *t], t):
            x, y = of(a), of(b)
            want += math.log10((pairs[x, y] + 20 * alone[y]) / (pairs[x].sum() + 20)) + math.log10((count[b] + 0.1) / (in_class[y] + 0.1 * (words[y] + 1)))
        assert out[doc]["score"] == pytest.approx(want, rel=1e-9), doc


def test_scores_of_odd_rows(odd):
    df, rows = odd
    check_base(brown_lm.score_texts(df).collect(), rows)
    assert brown_lm.score_texts(df.limit(0)).count() == 0
    only = [r for r in rows if held(r[0])]
    check_base(brown_lm.score_texts(df.where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 = 0")).collect(), only)


def likelihood(m, cls, k):
    hot = np.eye(k)[cls]
    n = hot.T @ m @ hot
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum()
    return f(n) - f(n.sum(1)) - f(n.sum(0))


def test_exchange_never_lowers_the_likelihood():
    r = np.random.default_rng(1)
    m = r.poisson(1.5, (30, 30)).astype(float) * np.kron(np.array([[1, 4, 1], [1, 1, 4], [4, 1, 1]]), np.ones((10, 10)))
    by_round = [likelihood(m, brown_lm.exchange(m, 5, rounds=k), 5) for k in (0, 1, 2, 6)]
    assert all(b >= a - 1e-9 for a, b in zip(by_round, by_round[1:])) and by_round[-1] > by_round[0]
    cls = brown_lm.exchange(m, 5, rounds=60)
    assert cls[brown_lm.END] == 0 and (cls[1:] > 0).all()
    best = likelihood(m, cls, 5)
    for u in range(1, 30):  # no single move gains
        for b in range(1, 5):
            other = cls.copy()
            other[u] = b
            assert likelihood(m, other, 5) <= best + 1e-6


def test_the_model_is_a_distribution():
    """Over a class's seen words and its share for unseen ones, and over classes, chances sum to one."""
    v = brown_lm.Vocabulary(5, 100, 7, np.array([10, 20], np.uint64), np.array([40, 30]), np.array([3, 3]), np.bincount([3, 3, 4, 4, 4, 5, 6], minlength=brown_lm.POOLS), np.bincount([3, 4, 5, 6], [72, 20, 5, 3], minlength=brown_lm.POOLS).astype(int))
    r = np.random.default_rng(0)
    model = brown_lm.ClassModel.learn(v, r.poisson(1, (v.units, v.units)).astype(float), 8)
    assert np.allclose((10**model.log_trans).sum(1), 1)
    for c in range(8):
        units = np.flatnonzero(model.cls == c)
        words, total = v.unit_words()[units], v.unit_tokens()[units]
        seen = (total.sum() + brown_lm.ALPHA * words.sum()) / (model.class_tokens[c] + brown_lm.ALPHA * (model.class_words[c] + 1))
        assert seen + 10 ** model.log_emission(np.array(0), np.array(c)) == pytest.approx(1)


def test_pipeline(odd, spark, tmp_path):
    df, _ = odd
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    lengths = defaultdict(int)
    for x in out:
        lengths[x["sequence_id"]] += x["length"]
    assert all(n <= 2048 for n in lengths.values())
    def tables():
        folder = f"{common.shared_dir(spark)}/graphloom"
        return {t for t in os.listdir(folder) if "packed" not in t}

    there = tables()
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert tables() == there  # all but the result is deleted
    assert {x["doc_id"] for x in again.collect()} == {x["doc_id"] for x in docs.select("doc_id").collect()}
    empty = str(tmp_path / "empty")
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_by_plain_versions(make_docs, spark, tmp_path):
    """Each stage of run() over what the stage before kept, against its plain version."""
    r = random.Random(11)
    line = lambda chars, k: " ".join("".join(r.choices(chars, k=r.randrange(3, 8))) for _ in range(k))
    alphabets = {"xx": "abcdefgh", "yy": "uvwxyzst"}
    passage = {k: "\n".join(line(c, 15) for _ in range(5)) for k, c in alphabets.items()}
    rows = []
    for i in range(160):
        lang = r.choice(["xx", "yy"])
        lines = [line(alphabets[lang], r.randrange(4, 20)) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.3:
            lines.insert(r.randrange(len(lines) + 1), passage[lang])
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}"))
    for i in range(160, 190):  # near copies: a word is another
        doc = r.choice(rows[:160])
        words = doc[1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), doc[2], "s1"))
    rows += [(300, "12 34 56", "xx", "s0"), (301, None, "xx", "s0"), (302, "", None, None)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    out = corpus_pipeline.language_id(spark, docs, "")
    model = language.fit(docs)
    found = model.tagger().predict([x[1] for x in rows])
    kept = [x for x, (lang, score) in zip(rows, found) if lang != "und" and score >= 0.4]
    assert sorted(x["doc_id"] for x in out.collect()) == [x[0] for x in kept] and len(kept) >= 180

    out = corpus_pipeline.dedup_lines(spark, corpus_pipeline.materialize(out, "a"), "")
    want = plain_line_dedup([x[:2] for x in kept], 50, 25)
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in out.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()} and sum(want[x[0]] != x[1] for x in kept) > 20

    out = corpus_pipeline.near_dedup(spark, corpus_pipeline.materialize(out, "b"), "")
    left = plain_kept(sorted(want.items()))
    assert {x["doc_id"] for x in out.collect()} == left and len(left) < len(want)

    out = corpus_pipeline.materialize(out, "c")
    mixed = corpus_pipeline.materialize(corpus_pipeline.mix_sources(spark, out, ""), "d")
    copies = Counter(x["doc_id"] for x in mixed.collect())
    sizes = {k: len((want[k] or "").split()) for k in left}
    for source in ("s0", "s1", "s2"):
        own = [x[0] for x in kept if x[3] == source and x[0] in left]
        target = corpus_pipeline.mixing.mix(out).where(F.col("source") == source).first()["target"]
        assert abs(sum(copies[k] * sizes[k] for k in own) - target) <= max(sizes[k] for k in own) / 2 + 1
    assert max(copies.values()) <= 3 and all(copies[k] == 1 for k in left if not sizes[k])

    pieces = corpus_pipeline.pack(spark, mixed, "").collect()
    encode = Tokenizer.from_file(default_tokenizer()).encode
    tokens_of = {k: len(encode(want[k] or "", add_special_tokens=False).ids) + 1 for k in copies}
    assert Counter({k: sum(x["length"] for x in pieces if x["doc_id"] == k) for k in copies}) == Counter({k: n * tokens_of[k] for k, n in copies.items()})
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x["doc_id"], x["doc_tokens"]) for x in whole if x["start"] == 0) == Counter((x["doc_id"], x["doc_tokens"]) for x in pieces if x["start"] == 0)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries()) and set(entry.oracle_sql()) <= set(names)


def test_rare_words_choose_their_class(make_docs):
    """Words of two uses share one pool; only classes of their own tell which of them comes next."""
    r = random.Random(4)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{r.randrange(150)}ing" for k in range(40))) for i in range(600)]
    starts = [(1000 + i, " ".join(f"{w}{r.randrange(150)}ing" for w in ("a", "b") for _ in "1")) for i in range(300)]
    rows += starts
    out = brown_lm.score_texts(make_docs(rows), units=2, classes=6).collect()
    check_base(out, rows)
    test = [x for x in out if x["held_out"] and x["n_tokens"] > 10]
    gain = sum(x["score"] - x["base_score"] for x in test) / sum(x["n_tokens"] for x in test)
    assert len(test) > 20 and gain > 0.25  # of log10(2) = 0.30 that the use of the last word is worth
