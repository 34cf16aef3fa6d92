"""A linear-chain conditional random field with two labels, for many chains at once.

Chains of any length are laid out by step, longest first, so that one step of the recursion
is one vector operation over all chains that reach it. Messages are log-odds of label 1.
"""

from __future__ import annotations

import numpy as np

_LIMIT = 40.0


class Layout:
    """Order of the positions of chains of the given lengths, by step."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        total = int(lengths.sum())
        longest = int(lengths.max()) if len(lengths) else 0
        self.width = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
        self.offset = np.concatenate([[0], np.cumsum(self.width)])
        step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        #: place in the layout of each position in the chains' own order
        self.place = self.offset[step] + np.repeat(rank, lengths)
        self.steps = longest


def marginals(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(label 1) at every position, by forward-backward.

    unary: score of label 1 over label 0 by position; trans: scores of 00, 01, 10, 11. With
    ``pairs``, also the expected number of each transition.
    """
    lay = Layout(lengths)
    u = np.empty(len(unary))
    u[lay.place] = unary
    e = np.exp(trans)
    fore, back = np.empty_like(u), np.zeros_like(u)
    off, width = lay.offset.tolist(), lay.width.tolist()
    for t in range(lay.steps):
        a, n = off[t], width[t]
        if t:
            x = np.exp(np.clip(fore[off[t - 1] : off[t - 1] + n], -_LIMIT, _LIMIT))
            fore[a : a + n] = u[a : a + n] + np.log((e[1] + e[3] * x) / (e[0] + e[2] * x))
        else:
            fore[:n] = u[:n]
    for t in range(lay.steps - 2, -1, -1):
        a, b, n = off[t], off[t + 1], width[t + 1]
        x = np.exp(np.clip(u[b : b + n] + back[b : b + n], -_LIMIT, _LIMIT))
        back[a : a + n] = np.log((e[2] + e[3] * x) / (e[0] + e[1] * x))
    p = (1 / (1 + np.exp(-np.clip(fore + back, -_LIMIT, _LIMIT))))[lay.place]
    if not pairs:
        return p
    expected = np.zeros(4)
    f, g = fore[lay.place], (u + back)[lay.place]
    ends = np.cumsum(lengths)
    inner = np.ones(len(unary), bool)
    inner[ends[np.asarray(lengths) > 0] - 1] = False
    i = np.flatnonzero(inner)
    f, g = np.clip(f[i], -_LIMIT, _LIMIT), np.clip(g[i + 1], -_LIMIT, _LIMIT)
    joint = np.stack([np.full(len(i), trans[0]), trans[1] + g, trans[2] + f, trans[3] + f + g])
    joint = np.exp(joint - joint.max(0))
    expected += (joint / joint.sum(0)).sum(1)
    return p, expected


#: Positions that are worked on at a time, whole chains of them.
_POSITIONS = 1 << 20


def batches(lengths: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(from, to, lengths) of runs of chains of some positions each."""
    ends = np.cumsum(lengths)
    out, chain, at = [], 0, 0
    while chain < len(lengths):
        upto = max(chain + 1, int(np.searchsorted(ends, at + _POSITIONS, side="right")))
        out.append((at, int(ends[upto - 1]), lengths[chain:upto]))
        chain, at = upto, int(ends[upto - 1])
    return out


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit(unary_of, back_of, n_weights: int, labels: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.1, ridge: float = 1e-3):
    """Weights and transition scores of greatest likelihood.

    unary_of(w) gives the positions' scores; back_of(g) sums positions' gradients into the weights'.
    """
    lengths = np.asarray(lengths, np.int64)
    w, trans = np.zeros(n_weights), np.zeros(4)
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.bincount(2 * labels[i] + labels[i + 1], minlength=4).astype(float) if len(i) else np.zeros(4)
    up, up_t = Adam(n_weights, rate), Adam(4, rate)
    n = max(1, len(labels))
    parts = batches(lengths)
    for _ in range(rounds):
        p, expected = unary_of(w), np.zeros(4)
        for a, b, some in parts:
            p[a:b], e = marginals(p[a:b], some, trans, pairs=True)
            expected += e
        w = w + up.step(back_of(labels - p) / n - ridge * w)
        trans = trans + up_t.step((seen - expected) / n - ridge * trans)
    return w, trans


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression with a constant (last weight), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + d / max(1.0, np.abs(d).max() / 5)
        if np.abs(d).max() < 1e-8:
            break
    return w
