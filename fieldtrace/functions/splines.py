"""The cubic smoothing spline: banded solves, many penalties side by side."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from fieldtrace.functions.chains import packed

#: Penalties that are tried, for points one apart.
PENALTIES = np.logspace(-4, 6, 60)


def _factored(x: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The second differences' weights, and the factors L D L' of R + lam Q'Q (five diagonals) for each penalty."""
    h = np.diff(x)
    q = np.stack([1 / h[:-1], -(1 / h[:-1] + 1 / h[1:]), 1 / h[1:]], 1)  # column j of Q acts on points j, j + 1, j + 2
    m = len(q)
    b0 = ((h[:-1] + h[1:]) / 3)[:, None] + lam * (q**2).sum(1)[:, None]
    b1, b2 = np.zeros((m, len(lam))), np.zeros((m, len(lam)))
    b1[:-1] = (h[1:-1] / 6)[:, None] + lam * (q[:-1, 1] * q[1:, 0] + q[:-1, 2] * q[1:, 1])[:, None]
    b2[:-2] = lam * (q[:-2, 2] * q[2:, 0])[:, None]
    d, e, f = b0, b1, b2
    for i in range(m):  # in place: a row needs the two before it
        if i > 1:
            d[i] -= f[i - 2] ** 2 * d[i - 2]
        if i:
            d[i] -= e[i - 1] ** 2 * d[i - 1]
            e[i] -= f[i - 1] * d[i - 1] * e[i - 1]
        e[i] /= d[i]
        f[i] /= d[i]
    return q, (d, e, f)


def _fitted(y: np.ndarray, lam: np.ndarray, q: np.ndarray, factors: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    d, e, f = factors
    m = len(q)
    z = np.repeat((q[:, 0] * y[:-2] + q[:, 1] * y[1:-1] + q[:, 2] * y[2:])[:, None], len(lam), 1)
    for i in range(1, m):
        z[i] -= e[i - 1] * z[i - 1]
        if i > 1:
            z[i] -= f[i - 2] * z[i - 2]
    z /= d
    for i in range(m - 2, -1, -1):
        z[i] -= e[i] * z[i + 1]
        if i < m - 2:
            z[i] -= f[i] * z[i + 2]
    bent = np.zeros((len(y), len(lam)))
    for k in range(3):
        bent[k : k + m] += q[:, k, None] * z
    return y[:, None] - lam * bent


def _leverages(lam: np.ndarray, q: np.ndarray, factors: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The diagonal of the smoother, from the central diagonals of the inverse of L D L'."""
    d, e, f = factors
    m = len(q)
    s0, s1, s2 = np.zeros((m + 2, len(lam))), np.zeros((m + 2, len(lam))), np.zeros((m + 2, len(lam)))
    for i in range(m - 1, -1, -1):
        s1[i] = -e[i] * s0[i + 1] - f[i] * s1[i + 1]
        s2[i] = -e[i] * s1[i + 1] - f[i] * s0[i + 2]
        s0[i] = 1 / d[i] - e[i] * s1[i] - f[i] * s2[i]
    # Point i is weighted by columns i - 2, i - 1 and i of Q.
    near = np.zeros((m + 2, len(lam)))
    for k in range(3):
        near[k : k + m] += q[:, k, None] ** 2 * s0[:m]
    near[1:m] += 2 * q[:-1, 1, None] * q[1:, 0, None] * s1[: m - 1]
    near[2 : m + 1] += 2 * q[:-1, 2, None] * q[1:, 1, None] * s1[: m - 1]
    if m > 2:
        near[2:m] += 2 * q[:-2, 2, None] * q[2:, 0, None] * s2[: m - 2]
    return 1 - lam * near


def scores(x: np.ndarray, y: np.ndarray, own: np.ndarray, lam: np.ndarray = PENALTIES) -> tuple[np.ndarray, np.ndarray]:
    """For each penalty the squared residuals and the leverages of the points that are ``own``, summed."""
    q, factors = _factored(x, lam)
    return ((y[:, None] - _fitted(y, lam, q, factors))[own] ** 2).sum(0), _leverages(lam, q, factors)[own].sum(0)


def fit(x: np.ndarray, y: np.ndarray, lam: float) -> np.ndarray:
    """The spline's values at its points."""
    one = np.array([lam])
    q, factors = _factored(x, one)
    return _fitted(y, one, q, factors)[:, 0]


@lru_cache(maxsize=16)
def _even(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors for points one apart; those of fewer points are their beginnings."""
    return _factored(np.arange(n, dtype=float), PENALTIES)[1]


@lru_cache(maxsize=4096)
def _even_leverage(n: int) -> np.ndarray:
    x = np.arange(n, dtype=float)
    return _leverages(PENALTIES, *_factored(x, PENALTIES)).sum(0)


def smoothed(y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Splines along many sequences of four or more points, one apart, that stand one behind the other in ``y``, side by side.

    Each takes the penalty of least generalised cross-validation, by the same steps as ``scores`` and ``fit``.
    """
    out = np.empty(len(y))
    for at, have in packed(lengths, 1 << 14):
        n, there = len(at), np.arange(at.shape[1]) < have[:, None]
        size = there.sum(0)
        value = np.where(there, y[at], 0.0)
        middle = value.sum(0) / size
        value = np.where(there, value - middle, 0.0)
        d, e, f = (c[: n - 2] for c in _even(1 << int(n - 1).bit_length()))
        z = np.where(there[2:], value[:-2] - 2 * value[1:-1] + value[2:], 0.0)[:, :, None].repeat(len(PENALTIES), 2)
        for i in range(1, n - 2):
            z[i] -= e[i - 1] * z[i - 1]
            if i > 1:
                z[i] -= f[i - 2] * z[i - 2]
        z /= d[:, None]
        z[~there[2:]] = 0.0
        for i in range(n - 4, -1, -1):
            k = have[i + 2]  # what comes behind a sequence's end is 0
            z[i, :k] -= e[i] * z[i + 1, :k]
            if i < n - 4:
                z[i, :k] -= f[i] * z[i + 2, :k]
        bent = np.zeros((*value.shape, len(PENALTIES)))
        for k, w in enumerate((1.0, -2.0, 1.0)):
            bent[k : k + n - 2] += w * z
        bent *= PENALTIES
        loose = np.maximum(1 - np.stack([_even_leverage(int(v)) for v in size]) / size[:, None], 1e-9)
        best = ((bent**2).sum(0) / size[:, None] / loose / loose).argmin(1)
        fitted = middle + (value - bent[:, np.arange(len(size)), best])
        out[at[there]] = fitted[there]
    return out
