"""A linear-chain conditional random field over sparse features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Features:
    """Features of distinct observations: those of observation i are indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray


def sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Row sums of consecutive groups; empty groups give zero."""
    out = np.zeros((len(indptr) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(np.diff(indptr))
    if len(full):
        out[full] = np.add.reduceat(values, indptr[full], axis=0)
    return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posterior label probabilities of every position; sequences lie one after another in ``emit`` (log scores).

    All sequences advance together, one position a step, so the cost of a step
    is shared. With ``pairs`` also the expected transition counts.
    """
    labels = emit.shape[1]
    e = np.exp(emit - emit.max(1, keepdims=True))
    a = np.exp(trans - trans.max()).astype(e.dtype)
    order = np.argsort(-lengths, kind="stable")
    at = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    live = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    alpha, beta = np.empty_like(e), np.empty_like(e)
    first = np.exp(start - start.max()).astype(e.dtype)
    for t in range(longest):
        rows = at[: live[t]] + t
        x = e[rows] * (first if t == 0 else now[: live[t]] @ a)
        now = x / x.sum(1, keepdims=True)
        alpha[rows] = now
    expected = np.zeros((labels, labels))
    back = np.ones((0, labels), dtype=e.dtype)
    for t in range(longest - 1, -1, -1):
        n, rows = live[t], at[: live[t]] + t
        if len(back) < n:
            back = np.concatenate([back, np.full((n - len(back), labels), 1 / labels, dtype=e.dtype)])
        beta[rows] = back
        if t:
            x = e[rows] * back
            if pairs:
                before = alpha[rows - 1]
                z = ((before @ a) * x).sum(1, keepdims=True)
                expected += (before / z).T @ x
            x = x @ a.T
            back = x / x.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    return (post, expected * a) if pairs else post


def viterbi(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray | None = None) -> list[int]:
    """The best labels of one sequence; the smaller label wins a tie."""
    score, back = start + emit[0], []
    for row in emit[1:]:
        x = score[:, None] + trans
        best = x.argmax(0)
        back.append(best)
        score = x[best, np.arange(len(best))] + row
    if end is not None:
        score = score + end
    path = [int(score.argmax())]
    for best in reversed(back):
        path.append(int(best[path[-1]]))
    return path[::-1]


@dataclass
class ChainCrf:
    weights: np.ndarray  # feature x label; row 0 is no feature and stays zero
    trans: np.ndarray
    start: np.ndarray

    def emissions(self, f: Features) -> np.ndarray:
        return sums(self.weights[f.indices], f.indptr)


def train(f: Features, sequences: list[tuple[np.ndarray, np.ndarray]], labels: int, dim: int, epochs: int = 4, batch: int = 256, rate: float = 0.3, decay: float = 1e-5, seed: int = 0) -> ChainCrf:
    """Maximise the conditional likelihood of (observations, labels) sequences by AdaGrad over batches."""
    rng = np.random.default_rng(seed)
    model = ChainCrf(np.zeros((dim, labels)), np.zeros((labels, labels)), np.zeros(labels))
    seen = [np.full_like(x, 1e-6) for x in (model.weights, model.trans, model.start)]
    sequences = [s for s in sequences if len(s[0])]
    width = np.diff(f.indptr)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for b in range(0, len(order), batch):
            part = [sequences[i] for i in order[b : b + batch]]
            items = np.concatenate([s[0] for s in part])
            truth = np.concatenate([s[1] for s in part])
            lengths = np.array([len(s[0]) for s in part])
            own, item = np.unique(items, return_inverse=True)
            indptr = np.r_[0, np.cumsum(width[own])]
            indices = f.indices[np.repeat(f.indptr[own] - indptr[:-1], width[own]) + np.arange(indptr[-1])]
            emit = sums(model.weights[indices], indptr)[item]
            post, expected = forward_backward(emit, lengths, model.trans, model.start, pairs=True)
            first = np.cumsum(lengths) - lengths
            inner = np.ones(len(items), dtype=bool)
            inner[first] = False
            j = np.flatnonzero(inner)
            g_trans = np.zeros((labels, labels))
            np.add.at(g_trans, (truth[j - 1], truth[j]), 1)
            g_trans -= expected
            g_token = -post
            g_token[np.arange(len(truth)), truth] += 1
            g_start = g_token[first].sum(0)
            g_weights = np.empty_like(model.weights)
            for k in range(labels):
                g = np.bincount(item, weights=g_token[:, k], minlength=len(own))
                g_weights[:, k] = np.bincount(indices, weights=np.repeat(g, width[own]), minlength=dim)
            for x, g, s in zip((model.weights, model.trans, model.start), (g_weights, g_trans, g_start), seen):
                g = g / len(part) - decay * x
                s += g * g
                x += rate * g / np.sqrt(s)
            model.weights[0] = 0
    return model
