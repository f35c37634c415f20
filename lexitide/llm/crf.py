"""Linear-chain conditional random fields in numpy: training by forward-backward gradients, exact marginals of long
chains in segments, and Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights of features by label, of label pairs and of first labels."""

    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels
    first: np.ndarray  # labels


#: Features whose weights are gathered at a time.
HELD_FEATURES = 200_000


def emissions(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of feature weights of each observation; observation i has features flat[starts[i]:starts[i + 1]], one at least."""
    n = len(starts) - 1
    out = np.zeros((max(0, n), weights.shape[1]), weights.dtype)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + HELD_FEATURES, side="right")) - 1)
        out[a:b] = np.add.reduceat(weights[flat[starts[a] : starts[b]]], starts[a:b] - starts[a], axis=0)
        a = b
    return out


def train(flat: np.ndarray, starts: np.ndarray, chains: np.ndarray, labels: np.ndarray, n_features: int, n_labels: int, steps: int = 40, rate: float = 0.15, decay: float = 1e-4) -> Chain:
    """chains: observation ids, one row a chain, -1 behind its end; labels: the same shape. Adam on the mean
    log-likelihood of all chains; the gradient is true counts less the counts that forward-backward expects."""
    K, (B, L) = n_labels, chains.shape
    real = chains >= 0
    obs, lab = np.where(real, chains, 0), np.where(real, labels, 0)
    n_obs, counts = len(starts) - 1, np.diff(starts)
    total = max(1, int(real.sum()))
    truth = np.zeros((n_obs, K))
    np.add.at(truth, (obs[real], lab[real]), 1)
    pair = real[:, :-1] & real[:, 1:]
    true_moves = np.bincount((lab[:, :-1] * K + lab[:, 1:])[pair], minlength=K * K).reshape(K, K)
    true_first = np.bincount(lab[:, 0][real[:, 0]], minlength=K)
    x = [np.zeros((n_features, K)), np.zeros((K, K)), np.zeros(K)]
    m, v = [np.zeros_like(a) for a in x], [np.zeros_like(a) for a in x]
    for step in range(1, steps + 1):
        e = emissions(x[0], flat, starts)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        move = np.exp(x[1])
        E = np.where(real[:, :, None], e[obs], 1.0)
        alpha = np.empty((B, L, K))
        a = E[:, 0] * np.exp(x[2])
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, L):
            a = (alpha[:, t - 1] @ move) * E[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        want, beta = np.zeros((K, K)), np.ones((B, K))
        expected = np.zeros((n_obs, K))
        for t in range(L - 1, -1, -1):
            p = alpha[:, t] * beta
            p /= p.sum(axis=1, keepdims=True)
            here = real[:, t]
            for k in range(K):
                expected[:, k] += np.bincount(obs[here, t], weights=p[here, k], minlength=n_obs)
            if t == 0:
                first = p[here].sum(axis=0)
            else:
                after = E[:, t] * beta
                joint = alpha[:, t - 1, :, None] * move * after[:, None, :]
                want += (joint / joint.sum(axis=(1, 2), keepdims=True))[here].sum(axis=0)
                back = after @ move.T
                beta = np.where(here[:, None], back / back.sum(axis=1, keepdims=True), 1.0)
        diff = (truth - expected) / total
        # A label at a time: with all of them a table has a row for each feature of each observation.
        g = [np.stack([np.bincount(flat, weights=np.repeat(diff[:, k], counts), minlength=n_features) for k in range(K)], axis=1), (true_moves - want) / total, (true_first - first) / B]
        for i in range(3):
            g[i] -= decay / total * x[i]
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
            x[i] = x[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
    return Chain(*x)


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray, segment: int = 128) -> np.ndarray:
    """Probabilities of each label at each place. e: exp of emissions of all chains one behind the other.

    Chains are cut into segments that run side by side; products of transfer matrices carry the messages from segment
    to segment, so the result is that of one pass over each whole chain.
    """
    K = e.shape[1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, K))
    segs = -(-lengths // segment)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    seg0 = np.concatenate([[0], np.cumsum(segs)[:-1]])
    S = int(segs.sum())
    owner = np.repeat(np.arange(len(lengths)), segs)
    nth = np.arange(S) - seg0[owner]
    begin = base[owner] + nth * segment
    size = np.minimum(segment, lengths[owner] - nth * segment)
    at = begin[:, None] + np.minimum(np.arange(segment)[None, :], size[:, None] - 1)
    real = np.arange(segment)[None, :] < size[:, None]
    E = e[at]
    A = np.exp(moves)
    P = np.broadcast_to(np.eye(K), (S, K, K)).copy()
    for t in range(segment):
        new = (P.reshape(S * K, K) @ A).reshape(S, K, K) * E[:, t, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        P = new if real[:, t].all() else np.where(real[:, t, None, None], new, P)
    into, out_of = np.empty((S, K)), np.ones((S, K))
    # A message into the first segment that, moved by A, gives the weights of first labels.
    lead = np.exp(first)
    for j in range(int(segs.max())):
        here = seg0[segs > j] + j
        if j == 0:
            into[here] = np.nan
        else:
            prev = here - 1
            if j == 1:
                f = _head(P, E, A, lead, prev, real, segment)
            else:
                f = np.einsum("sk,skl->sl", into[prev], P[prev])
            into[here] = f / f.sum(axis=1, keepdims=True)
    for j in range(int(segs.max()) - 2, -1, -1):
        here = seg0[segs > j + 1] + j
        f = np.einsum("skl,sl->sk", P[here + 1], out_of[here + 1])
        out_of[here] = f / f.sum(axis=1, keepdims=True)
    alpha = np.empty((S, segment, K))
    is_first = nth == 0
    carry = np.where(is_first[:, None], 1.0, into)
    for t in range(segment):
        moved = carry @ A
        if t == 0:
            moved = np.where(is_first[:, None], lead, moved)
        new = moved * E[:, t]
        carry = new / new.sum(axis=1, keepdims=True)
        alpha[:, t] = carry
    beta = out_of
    for t in range(segment - 1, -1, -1):
        alpha[:, t] *= beta
        back = (E[:, t] * beta) @ A.T
        back /= back.sum(axis=1, keepdims=True)
        beta = np.where(real[:, t, None], back, beta)
    got = alpha[real]
    return got / got.sum(axis=1, keepdims=True)


def _head(P, E, A, lead, rows, real, segment):
    """Forward message out of first segments, which start with the weights of first labels in place of a move."""
    f = lead * E[rows, 0]
    for t in range(1, segment):
        new = (f @ A) * E[rows, t]
        f = new / new.sum(axis=1, keepdims=True)
    return f


def viterbi(e: np.ndarray, moves: np.ndarray, first: np.ndarray) -> list[int]:
    """The best labels of one chain; e: emissions (logarithms), places x labels."""
    if not len(e):
        return []
    score, back = e[0] + first, []
    for row in e[1:]:
        step = score[:, None] + moves
        by = step.argmax(axis=0)
        back.append(by)
        score = step[by, np.arange(len(by))] + row
    path = [int(score.argmax())]
    for by in reversed(back):
        path.append(int(by[path[-1]]))
    return path[::-1]
