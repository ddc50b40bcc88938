"""Two-state chains by associative scans: a block of rows is a small matrix, and matrices of blocks multiply.

Steps of a chain are matrices from the state before to the state after. Their products in the usual algebra give
posteriors, in the (max, +) algebra the most likely path. Products are associative, so blocks of a sequence are worked on
apart, and only their matrices meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def scan(m: np.ndarray, combine: Combine) -> np.ndarray:
    """All prefixes ``m[0] * ... * m[i]``, with vectorised products and a depth that grows with the logarithm."""
    n = len(m)
    if n < 2:
        return m.copy()
    out = np.empty_like(m)
    half = scan(combine(m[: n - 1 : 2], m[1::2]), combine)
    out[0], out[1::2] = m[0], half
    if n > 2:
        out[2::2] = combine(half[: (n - 1) // 2], m[2::2])
    return out


def suffixes(m: np.ndarray, combine: Combine) -> np.ndarray:
    """All suffixes ``m[i] * ... * m[-1]``."""
    return scan(m[::-1], lambda a, b: combine(b, a))[::-1]


def sum_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = a @ b
    return p / p.sum((1, 2), keepdims=True)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = (a[:, :, :, None] + b[:, None, :, :]).max(2)
    return p - p.max((1, 2), keepdims=True)


def _composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.take_along_axis(a, b, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / v.sum(-1, keepdims=True)


def steps(log_e: np.ndarray, log_t: np.ndarray, log_s: np.ndarray, begins: bool) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of a block's rows in both algebras; the first row of a sequence comes from no state, whatever stands before."""
    plus = log_t[None] + log_e[:, None, :]
    if begins:
        plus[0] = log_s + log_e[0]
    top = log_e.max(1)[:, None, None]
    return np.exp(plus - top), plus


def block_products(log_e: np.ndarray, log_t: np.ndarray, log_s: np.ndarray, begins: bool) -> tuple[np.ndarray, np.ndarray]:
    product, plus = steps(log_e, log_t, log_s, begins)
    while len(product) > 1:
        odd = len(product) % 2
        product = np.concatenate([sum_product(product[: len(product) - odd : 2], product[1::2]), product[len(product) - odd :]])
        plus = np.concatenate([max_plus(plus[: len(plus) - odd : 2], plus[1::2]), plus[len(plus) - odd :]])
    return product[0] / product[0].sum(), plus[0] - plus[0].max()


def across_blocks(product: np.ndarray, plus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each block of a sequence, in order, gets from the others.

    The state distribution before it, the weight of each state behind it, the best score of each state before it, and the
    state of the best path at its end.
    """
    n = len(product)
    before, behind, score = np.full((n, 2), 0.5), np.full((n, 2), 0.5), np.zeros((n, 2))
    if n > 1:
        before[1:] = _unit(scan(product, sum_product)[:-1].sum(1))
        behind[:-1] = _unit(suffixes(product, sum_product)[1:].sum(2))
    best = scan(plus, max_plus).max(1)
    score[1:] = best[:-1]
    back = (score[:, :, None] + plus).argmax(1)  # by the state at a block's end: the one at the end of the block before
    last = int(best[-1].argmax())
    ends = np.full(n, last)
    if n > 1:
        ends[:-1] = suffixes(back, _composed)[1:, last]
    return before, behind, score, ends


def posteriors(log_e: np.ndarray, log_t: np.ndarray, log_s: np.ndarray, begins: bool, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State probabilities of a block's rows, expected steps between states, and its part of the log likelihood."""
    product, _ = steps(log_e, log_t, log_s, begins)
    ahead = _unit(before @ scan(product, sum_product))
    weight = np.empty_like(ahead)
    weight[-1] = behind
    if len(weight) > 1:
        weight[:-1] = _unit(suffixes(product, sum_product)[1:] @ behind)
    previous = np.concatenate([before[None], ahead[:-1]])
    moved = previous[:, :, None] * product * weight[:, None, :]
    moved = (moved / moved.sum((1, 2), keepdims=True))[int(begins) :].sum(0)
    scale = np.maximum((previous[:, None] @ product)[:, 0].sum(1), 1e-300)
    return _unit(ahead * weight), moved, float(np.log(scale).sum() + log_e.max(1).sum())


def best_path(log_e: np.ndarray, log_t: np.ndarray, log_s: np.ndarray, begins: bool, score: np.ndarray, end: int) -> np.ndarray:
    """The most likely states of a block's rows, given the scores before it and the state at its end."""
    _, plus = steps(log_e, log_t, log_s, begins)
    so_far = np.concatenate([score[None], (score[:, None] + scan(plus, max_plus)).max(1)[:-1]])
    back = (so_far[:, :, None] + plus).argmax(1)
    path = np.full(len(plus), end)
    if len(plus) > 1:
        path[:-1] = suffixes(back, _composed)[1:, end]
    return path


def packed(lengths: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole sequences side by side, longest first: the row of each step (steps by sequences) and how many have that step.

    Where a sequence has ended, its last row stands.
    """
    starts, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    k = 0
    while k < len(order):
        n = int(lengths[order[k]])
        which = order[k : k + max(1, most // n)]
        steps_ = np.arange(n)[:, None]
        yield starts[which] + np.minimum(steps_, lengths[which] - 1), (steps_ < lengths[which]).sum(1)
        k += len(which)


def whole_posteriors(log_e: np.ndarray, have: np.ndarray, log_t: np.ndarray, log_s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State probabilities, expected steps between states and log likelihood of packed sequences (steps, sequences, states)."""
    t, top = np.exp(log_t), log_e.max(2)
    e = np.exp(log_e - top[:, :, None])
    ahead, weight, scale = np.empty_like(e), np.full_like(e, 0.5), np.ones(top.shape)
    moved, there = np.zeros((2, 2)), np.arange(e.shape[1]) < have[:, None]
    for i, n in enumerate(have):
        a = np.exp(log_s) * e[0] if i == 0 else (ahead[i - 1, :n] @ t) * e[i, :n]
        scale[i, :n] = a.sum(1)
        ahead[i, :n] = a / scale[i, :n, None]
        ahead[i, n:] = 0.5
    for i in range(len(have) - 2, -1, -1):
        n = have[i + 1]
        weight[i, :n] = _unit((e[i + 1, :n] * weight[i + 1, :n]) @ t.T)
    if len(have) > 1:
        step = ahead[:-1, :, :, None] * t * (e[1:] * weight[1:])[:, :, None, :]
        moved = (step / step.sum((2, 3), keepdims=True))[there[1:]].sum(0)
    return _unit(ahead * weight), moved, float((np.log(np.maximum(scale, 1e-300)) + top)[there].sum())


def whole_paths(log_e: np.ndarray, have: np.ndarray, log_t: np.ndarray, log_s: np.ndarray) -> np.ndarray:
    """The most likely states of packed sequences."""
    back, score = np.zeros(log_e.shape, np.int64), log_s + log_e[0]
    for i in range(1, len(have)):
        n = have[i]
        plus = score[:n, :, None] + (log_t + log_e[i, :n, None, :])
        back[i, :n], score[:n] = plus.argmax(1), plus.max(1)
    path = np.tile(score.argmax(1), (len(have), 1))
    for i in range(len(have) - 2, -1, -1):
        n = have[i + 1]
        path[i, :n] = back[i + 1][np.arange(n), path[i + 1, :n]]
    return path
