"""Language identification of words in code-switched text by a conditional random field."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, releasing
from .crf import ChainCrf, Features, forward_backward, train

#: The classifier is fitted on stretches of about this many documents of each language at most,
SAMPLE_PER_LANGUAGE = 300
#: of this many characters at most, from a place that a hash tells,
STRETCH = 8000
#: and on this many runs of their words for each language.
RUNS_PER_LANGUAGE = 1500
DIM = 1 << 16
ORDERS = (2, 3, 4)
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def word_features(words: list[str]) -> Features:
    """Hashed n-grams of the word's bytes between two marks, and the word itself.

    N-grams that touch a mark are the affixes; the word itself is the entry of
    a learned lexicon.
    """
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(b))  # bytes of the word from here on
    columns = np.zeros((len(b), len(ORDERS) + 1), dtype=np.int64)
    h = b + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(1099511628211) + b[n - 1 :] if len(h) > 1 else h[:0]
        if n in ORDERS:
            i = _slot(h + np.uint64(n))
            columns[: len(i), ORDERS.index(n)] = np.where(left[: len(i)] >= n, i, 0)
    columns[start, -1] = _slot(np.array([zlib.crc32(r) for r in raw], dtype=np.uint64) + np.uint64(1 << 40))
    return Features(np.r_[0, np.cumsum(size)] * columns.shape[1], columns.reshape(-1))


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(DIM - 1)).astype(np.int64) + 1


@dataclass
class LanguageModel:
    languages: list[str]
    crf: ChainCrf
    holdout: tuple[int, int] | None = None

    def tagger(self) -> "Tagger":
        return Tagger(self)


class Tagger:
    """Labels batches of texts; emissions of words are kept between batches."""

    def __init__(self, model: LanguageModel, most: int = 150_000):
        self.model, self.most = model, most
        self.weights = model.crf.weights.astype(np.float32)
        self.trans, self.start = model.crf.trans.astype(np.float32), model.crf.start.astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.model.languages)), dtype=np.float32)

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior probabilities of all words, and the number of words of each text."""
        if len(self.index) > self.most:
            self._forget()
        index, fresh, ids = self.index, [], []
        for t in texts:  # words become numbers text by text, so those of one text alone are held as strings
            words = words_of(t) if t else []
            for x in dict.fromkeys(words):
                if x not in index:
                    index[x] = len(index)
                    fresh.append(x)
            ids.append(np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words)))
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        if fresh:
            made = []
            for at in range(0, len(fresh), 20_000):
                f = word_features(fresh[at : at + 20_000])
                k = len(ORDERS) + 1
                per_byte = self.weights[f.indices[0::k]]
                for c in range(1, k):
                    per_byte = per_byte + self.weights[f.indices[c::k]]
                made.append(np.add.reduceat(per_byte, f.indptr[:-1] // k, axis=0))
            self.emit = np.concatenate([self.emit, *made])
        if not lengths.any():
            return np.zeros((0, len(self.model.languages)), np.float32), lengths
        at = np.concatenate(ids)
        some = lengths[lengths > 0]
        return forward_backward(self.emit[at], some, self.trans, self.start), lengths

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language with the highest mean posterior over the words, and that mean."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        post, lengths = self.posteriors(texts)
        out = [(UNKNOWN, 0.0)] * len(texts)
        full = np.flatnonzero(lengths)
        if len(full):
            n = lengths[full]
            mean = np.add.reduceat(post.astype(np.float64), np.cumsum(n) - n, axis=0) / n[:, None]
            best = mean.argmax(1)
            for i, k, s in zip(full.tolist(), best.tolist(), mean.max(1).tolist()):
                out[i] = (self.model.languages[k], min(1.0, s))
        return out


def _remainder(of: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, holdout: tuple[int, int] | None = (4, 2), seed: int = 7) -> LanguageModel:
    """Learn from text and lang of a bounded sample; with ``holdout`` (m, r) never from rows whose crc32(doc_id) mod m is r.

    Every lang value with a text that has a letter is learned. Documents are
    drawn by a hash of doc_id and text, for each language apart, and of a drawn
    one a stretch of STRETCH characters comes to the driver; so what it gathers
    is bounded in bytes too, by the number of languages. Rows that are equal in
    both are drawn together; beyond the bound they are left out by their order.
    Training sequences are runs of words from several documents one after
    another, so that transitions between languages are learned too.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if holdout:
        rows = rows.where(_remainder(holdout[0]) != holdout[1])
    span = 1 << 40
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)), F.lit(span)).alias("draw"))
    counts = rows.groupBy("lang").count().collect()
    # one row a language: the model, which every worker holds, has DIM weights for each
    share = docs.sparkSession.createDataFrame([(c["lang"], int(span * min(1.0, per_language / c["count"]))) for c in counts], "lang string, most long")
    start = F.col("draw") % F.greatest(F.lit(1), F.length("text") - STRETCH + 1) + 1
    drawn = rows.join(F.broadcast(share), "lang").where("draw < most").select("lang", "draw", F.substring("text", start.cast("int"), F.lit(STRETCH)).alias("text"))
    sample = drawn.orderBy("draw", "lang", "text").limit(2 * per_language * max(1, len(counts))).collect()
    names = sorted({r["lang"] for r in sample if words_of(r["text"])})
    if not names:
        return LanguageModel([], ChainCrf(np.zeros((DIM, 0)), np.zeros((0, 0)), np.zeros(0)), holdout)
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    texts = []
    for r in sample:
        ids = np.array([index.setdefault(w, len(index)) for w in words_of(r["text"])], dtype=np.int64)
        if len(ids):
            texts.append((ids, names.index(r["lang"])))
    sequences = []
    for _ in range(min(RUNS_PER_LANGUAGE * len(names), 8 * len(texts))):
        items, truth = [], []
        for k in rng.integers(0, len(texts), rng.integers(1, 4)):
            ids, label = texts[k]
            n = int(rng.integers(5, 30))
            at = int(rng.integers(0, max(1, len(ids) - n + 1)))
            items.append(ids[at : at + n])
            truth.append(np.full(len(items[-1]), label))
        sequences.append((np.concatenate(items), np.concatenate(truth)))
    return LanguageModel(names, train(word_features(list(index)), sequences, len(names), DIM, epochs=3, seed=seed), holdout)


def _predictor(model: LanguageModel):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.tagger()
        for b in batches:
            for piece in pieces(b, 0):
                found = tagger.predict(piece.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*piece.schema.names[1:], "lang_pred", "score"]
                )

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, lang_pred, score for every row.

    score is the mean posterior of the predicted language over the words. A
    null or empty text, or one without a letter, is ``und`` with score 0, and
    so is any text if nothing could be learned. lang, source and doc_id are no
    inputs of a prediction; equal rows get equal results; a null doc_id counts
    as an empty one; held_out follows the remainder that the model was fitted
    without; all words of a very long text are labelled, in one task; no rows
    give no rows.
    """
    held = _remainder(model.holdout[0]) == model.holdout[1] if model.holdout else F.lit(False)
    rows = docs.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"))
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _accepting(model: LanguageModel, least: float):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.tagger()
        for b in batches:
            texts = b.schema.get_field_index("text")
            for piece in pieces(b, texts):
                found = tagger.predict(piece.column(texts).to_pylist())
                keep = [x[0] != UNKNOWN and x[1] >= least for x in found]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more; their columns, whatever their names, are unchanged.

    Null texts and those without a letter go; equal rows share their fate.
    """
    return docs.mapInArrow(_accepting(model, least), docs.schema)
