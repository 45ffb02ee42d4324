"""A linear-chain conditional random field in numpy: training and batched Viterbi decoding.

Sequences are given by the categorical features of their tokens; a token's score for a label
is the sum of its features' weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    emit: np.ndarray  # feature value x label
    move: np.ndarray  # label x label
    start: np.ndarray  # label

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Token x label, for features token x kind whose values index ``emit``."""
        out = np.zeros((len(features), self.emit.shape[1]), np.float32)
        for column in features.T:
            out += self.emit[column]
        return out

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of many sequences that lie one behind the other; all take each step together, the longest first."""
        n_labels = scores.shape[1]
        order = np.argsort(-lengths, kind="stable")
        lengths_ = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        steps = int(lengths_[0]) if len(lengths_) else 0
        active = np.searchsorted(-lengths_, -np.arange(1, steps + 1), "right")
        back = np.zeros(scores.shape, np.int8)
        labels = np.zeros(len(scores), np.int8)
        best = np.zeros((len(order), n_labels), np.float32)
        if not steps:
            return labels
        k = active[0]
        best[:k] = scores[starts[:k]] + self.start
        for t in range(1, steps):
            k = active[t]
            now = best[:k]
            top = now[:, :1] + self.move[0]
            source = np.zeros((k, n_labels), np.int8)
            for a in range(1, n_labels):
                way = now[:, a : a + 1] + self.move[a]
                better = way > top
                top = np.where(better, way, top)
                source[better] = a
            back[starts[:k] + t] = source
            best[:k] = top + scores[starts[:k] + t]
        state = best.argmax(1).astype(np.int8)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            labels[starts[:k] + t] = state[:k]
            if t:
                state[:k] = back[starts[:k] + t, state[:k]]
        return labels


def train(features: list[np.ndarray], labels: list[np.ndarray], n_values: int, n_labels: int, rounds: int = 80, decay: float = 0.01) -> Crf:
    """Maximise the penalised conditional likelihood by full-batch gradient steps with per-weight scaling. Everything is deterministic."""
    longest, n = max(map(len, features)), len(features)
    x = np.zeros((n, longest, features[0].shape[1]), np.int64)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for k, (f, lab) in enumerate(zip(features, labels, strict=True)):
        x[k, : len(f)], y[k, : len(f)], live[k, : len(f)] = f, lab, True
    hot = np.eye(n_labels)
    weights = [np.zeros((n_values, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for r in range(1, rounds + 1):
        emit, move, start = weights
        score = emit[x].sum(2)
        fore, aft = np.zeros((n, longest, n_labels)), np.zeros((n, longest, n_labels))
        fore[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            fore[:, t] = np.where(live[:, t, None], score[:, t] + _log_sum(fore[:, t - 1, :, None] + move, 1), fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            aft[:, t] = np.where(live[:, t + 1, None], _log_sum(move + (score[:, t + 1] + aft[:, t + 1])[:, None, :], 2), aft[:, t + 1])
        whole = _log_sum(fore[:, -1], 1)
        given = np.exp(fore + aft - whole[:, None, None]) * live[..., None]
        wanted = hot[y] * live[..., None]
        gap = wanted - given
        gradient = [np.zeros_like(emit), np.zeros_like(move), gap[:, 0].sum(0)]
        for j in range(x.shape[2]):
            np.add.at(gradient[0], x[..., j].ravel(), gap.reshape(-1, n_labels))
        for t in range(1, longest):
            both = np.exp(fore[:, t - 1, :, None] + move + (score[:, t] + aft[:, t])[:, None, :] - whole[:, None, None])
            gradient[1] += ((wanted[:, t - 1, :, None] * wanted[:, t, None, :] - both) * live[:, t, None, None]).sum(0)
        for w, g, (m, v) in zip(weights, gradient, moments, strict=True):
            g = g / n - decay * w / n
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            w += 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
    return Crf(*[w.astype(np.float32) for w in weights])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))
