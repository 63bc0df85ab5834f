import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing
from graphloom.llm import token_counts as counting
from graphloom.llm.packing import SumOfSquares, pack_documents
from graphloom.llm.token_counts import TokenCountCache, token_counts
from graphloom.llm.tokens import Encoder, TokenizerSpec, default_tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_both_encoders_agree(library):
    enc = Encoder(TokenizerSpec.from_file(default_tokenizer()))
    assert enc._fast is not None
    r = random.Random(2)
    plain = [chr(c) for c in range(32, 127)] + list("\t\n\r '") + ["'s", "'LL", "  ", "<|endoftext|>", "€", "–", "“"] + [chr(c) for c in range(0xA1, 0x250)]
    other = plain + list("\u0085 　\x1c\x00日本") + ["\U0001f600", "́", "﻿", "ŉ"]
    for pool in (plain, other):
        for _ in range(2500):
            t = "".join(r.choices(pool, k=r.randrange(60)))
            assert enc.encode(t).tolist() == ids(library, t), repr(t)
    for t in ("", " " * 5000, "a" * 50_000, "\n" * 999):
        assert enc.encode(t).tolist() == ids(library, t)


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", False)])
def test_other_files_go_through_the_library(name, kind):
    import public_tokenizers

    enc = Encoder(TokenizerSpec.from_file(public_tokenizers.path(name)))
    assert (enc._fast is not None) is kind
    assert enc.encode("Some Text").tolist() == Tokenizer.from_file(public_tokenizers.path(name)).encode("Some Text", add_special_tokens=False).ids


def test_level_is_the_one_of_least_squares():
    """Each placement against trying all levels in turn."""
    r = np.random.default_rng(0)
    p = SumOfSquares(32)
    for i in range(3000):
        n = int(r.integers(1, 32))
        before = p.levels.copy()
        p.add(i, 0, np.arange(n, dtype=np.uint32), n)
        after = p.levels[1:32]
        best = min(
            sum(x * x for x in trial[1:32])
            for h in range(33 - n)
            if h == 0 or before[h]
            for trial in [[x - (k == h and h > 0) + (k == h + n and k < 32) for k, x in enumerate(before)]]
        )
        assert int((after * after).sum()) == best
        assert all(len(v) == p.levels[h] for h, v in p.open.items())


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_whole(seed):
    r = np.random.default_rng(seed)
    p = SumOfSquares(64, most_open=8 if seed % 2 else 4096)
    docs = {i: r.integers(0, 1000, int(r.choice([1, 3, 20, 63, 64, 65, 500]))).astype(np.uint32) for i in range(int(r.integers(0, 200)))}
    for k, v in docs.items():
        p.add(k, 0, v, len(v))
    p.finish()
    windows = p.take()
    sizes = [sum(len(x[2]) for x in w) for w in windows]
    assert all(s == 64 or s & (s - 1) == 0 for s in sizes) and sum(s < 64 for s in sizes) <= 7
    got = defaultdict(list)
    for w in windows:
        for doc, start, part, n in w:
            assert n == len(docs[doc]) and len(part)
            got[doc].append((start, part))
    for k, v in docs.items():
        at = 0
        for start, part in sorted(got[k], key=lambda x: x[0]):
            assert start == at
            at += len(part)
        assert np.concatenate([x[1] for x in sorted(got[k], key=lambda x: x[0])]).tolist() == v.tolist()


def test_packed_rows(odd, library):
    df, rows = odd
    out = [x.asDict() for x in pack_documents(df, default_tokenizer()).collect()]
    by_seq = defaultdict(list)
    for x in out:
        by_seq[x["sequence_id"]].append(x)
    for parts in by_seq.values():
        at = 0
        for x in sorted(parts, key=lambda x: x["offset"]):
            assert x["offset"] == at and x["length"] > 0
            at += x["length"]
        assert at <= 2048
    padding = sum(2048 - s for s in (sum(x["length"] for x in v) for v in by_seq.values()) if s & (s - 1))
    assert padding == 0
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*ids(library, r[1]), 1])
    assert sum(x["length"] for x in out) == sum(len(v) for vs in want.values() for v in vs)
    for doc, texts in want.items():
        if len(texts) == 1:
            v = texts[0]
            pieces = sorted((x for x in out if x["doc_id"] == doc), key=lambda x: x["start"])
            assert [x["start"] for x in pieces] == [0, *np.cumsum([x["length"] for x in pieces])[:-1].tolist()] and all(x["doc_tokens"] == len(v) for x in pieces)
            for x in pieces:
                assert x["ids_crc32"] == zlib.crc32(np.array(v[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
    again = sorted(tuple(x) for x in pack_documents(df.limit(0), default_tokenizer()).collect())
    assert again == []


@pytest.mark.parametrize("fan_in", [64, 2])
def test_windows_are_cut_at_the_end_only(make_docs, monkeypatch, fan_in):
    """However many partitions there are, no more documents are cut than one packer has windows open."""
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    r = random.Random(1)
    rows = [(i, " ".join(["word"] * r.randrange(5, 1500))) for i in range(1200)]
    cut = []
    for parts in (1, 9):
        out = pack_documents(make_docs(rows).repartition(parts), default_tokenizer()).collect()
        assert sum(x["length"] for x in out) == sum(x["doc_tokens"] for x in out if x["start"] == 0)
        assert len({x["sequence_id"] for x in out}) <= sum(x["length"] for x in out) // 2048 + 12
        cut.append(sum(x["start"] > 0 for x in out))
    assert cut[1] <= cut[0] + 60


def test_second_run_is_served_by_the_cache(make_docs, spark, tmp_path, monkeypatch):
    import public_tokenizers

    rows = [(i, f"text {i % 40}") for i in range(100)]
    path = str(tmp_path / "cache")
    for few in (200_000, 0):  # missing texts found by a broadcast, and by a shuffle
        monkeypatch.setattr(counting, "FEW", few)
        where = f"{path}-{few}"
        token_counts(make_docs(rows), cache_path=where).collect()
        assert spark.read.parquet(where).count() == 40
        # a count that encoding would not give shows where results come from
        digest = spark.sql("SELECT unhex(sha2(CAST('text 7' AS BINARY), 256)) AS digest").first()["digest"]
        spec = TokenizerSpec.from_file(default_tokenizer())
        spark.createDataFrame([(spec.digest, digest, 77)], "tokenizer string, digest binary, n_tokens long").write.mode("append").parquet(where)
        got = {x["doc_id"]: x["n_tokens"] for x in token_counts(make_docs([*rows, (500, "a new text"), (501, "a new text")]), cache_path=where).collect()}
        assert got[7] == got[47] == 77 and got[500] == got[501] == 3 and got[8] == 2
        assert spark.read.parquet(where).count() == 42  # the forged row and one content that was missed
        other = public_tokenizers.path("word_bpe_49k.json")
        again = {x["doc_id"]: x["n_tokens"] for x in token_counts(make_docs(rows), other, cache_path=where).collect()}
        assert spark.read.parquet(where).count() == 82 and again[7] == again[47] != 77  # another tokenizer misses


def test_counts(odd, library, spark, tmp_path, monkeypatch):
    df, rows = odd
    path = str(tmp_path / "cache")
    got = sorted((tuple(x) for x in token_counts(df, cache_path=path).collect()), key=repr)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(ids(library, r[1])), n > 512) for r in rows), key=repr)
    assert got == want
    cache = spark.read.parquet(path)
    assert cache.count() == len({r[1] or "" for r in rows})  # each content once
    assert sorted((tuple(x) for x in token_counts(df, cache_path=path).collect()), key=repr) == want
    assert spark.read.parquet(path).count() == cache.count()  # nothing was missed the second time
    assert token_counts(df.limit(0), cache_path=str(tmp_path / "none")).count() == 0
    assert TokenCountCache(spark, path).read("another tokenizer").count() == 0
