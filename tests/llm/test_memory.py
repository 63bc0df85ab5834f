"""What Python workers hold at once, and what they keep."""

import numpy as np
import pyarrow as pa

from graphloom.llm import common, language, near_copies, packing
from graphloom.llm.crf import ChainCrf

MODEL = language.LanguageModel(["a", "b"], ChainCrf(np.zeros((language.DIM, 2)), np.zeros((2, 2)), np.zeros(2)))


def test_language_batches_are_bounded_in_bytes(monkeypatch):
    held = []
    predict = language.Tagger.predict

    def seen(self, texts):
        held.append(sum(len(t or "") for t in texts))
        return predict(self, texts)

    monkeypatch.setattr(language.Tagger, "predict", seen)
    texts = ["word " * 6000] * 120 + [None, "", "one"] + ["long " * 400_000] + ["two"] * 5
    b = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    kept = [t for piece in language._accepting(MODEL, 0.0)(iter([b])) for t in piece.column(0).to_pylist()]
    assert kept == [t for t in texts if t]
    assert sum(held) == sum(len(t or "") for t in texts)
    assert sorted(held)[-1] == 2_000_000 and sorted(held)[-2] <= 1 << 20  # a longer text is alone


def test_posteriors_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b"], ChainCrf(rng.normal(size=(language.DIM, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)))
    texts = ["one two one", None, "", "three", "two four five one", "12 34"]
    whole, lengths = model.tagger().posteriors(texts)
    tagger = language.Tagger(model, most=2)  # forgets words in between
    parts = [tagger.posteriors([t]) for t in texts]
    assert lengths.tolist() == [n for _, x in parts for n in x.tolist()] == [3, 0, 0, 1, 4, 0]
    np.testing.assert_allclose(whole, np.concatenate([p for p, _ in parts]), rtol=1e-5)


def test_pipeline_workers_release_memory(monkeypatch):
    made = []
    monkeypatch.setattr(common, "release_memory", lambda: made.append(1))
    runs = [language._accepting(MODEL, 0.0), language._predictor(MODEL), near_copies._sketches(5), near_copies._keys(13, 0), near_copies._linked(78), near_copies._compared(5, 0.8, 78)]
    for run in runs:
        assert list(run(iter([]))) == []
    assert len(made) == len(runs)
    assert packing._next_round(8, 1, True).__wrapped__ and packing._first_round(None, 8, 1, True).__wrapped__
