"""Exact intervals of shares and rate ratios for whole batches, from the regularised incomplete beta function."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
#: The continued fraction takes about as many steps as the root of the larger count; the limit is far beyond.
STEPS, TINY = 200_000, 1e-300


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_lgamma(a) + _lgamma(b) - _lgamma(a + b)).astype(float)


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method; rows drop out as they converge."""
    out, at = np.empty(len(x)), np.arange(len(x))
    keep = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.ones(len(x)), 1 / keep(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, STEPS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / keep(1 + step * d), keep(1 + step / c)
            h = h * d * c
        going = np.abs(d * c - 1) > 1e-16 * 4
        if not going.all():
            out[at[~going]] = h[~going]
            at, x, a, b, c, d, h = at[going], x[going], a[going], b[going], c[going], d[going], h[going]
            if not len(at):
                return out
    out[at] = h
    return out


def log_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, log_b: np.ndarray) -> np.ndarray:
    """Logarithm of the beta distribution's function at x, 0 < x < 1."""
    front = a * np.log(x) + b * np.log1p(-x) - log_b
    swap = x > (a + 1) / (a + b + 2)
    with np.errstate(divide="ignore"):
        near = front - np.log(np.where(swap, b, a)) + np.log(_fraction(np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)))
        return np.where(swap, np.log1p(-np.minimum(np.exp(near), 1)), near)


def quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the beta distribution's function is p, a small tail: Newton's steps on its logarithm inside a bracket that halves where they would leave it."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not len(a):
        return a
    log_b, goal = log_beta(a, b), math.log(p)
    low, high = np.zeros(len(a)), np.ones(len(a))
    # A normal approximation of Fisher's z, for parameters above one, is near enough for a few steps.
    z, mean = NormalDist().inv_cdf(1 - p), a / (a + b)
    s, t = 1 / np.maximum(2 * a - 1, 1), 1 / np.maximum(2 * b - 1, 1)
    h, r = 2 / (s + t), (z * z - 3) / 6
    w = z * np.sqrt(np.maximum(h + r, 0)) / h - (t - s) * (r + 5 / 6 - 2 / (3 * h))
    x = np.where((a > 1) & (b > 1), a / (a + b * np.exp(np.clip(2 * w, -600, 600))), np.clip(mean - 2 * np.sqrt(mean * (1 - mean) / (a + b + 1)), mean / 20, None))
    for _ in range(200):
        value = log_cdf(x, a, b, log_b)
        low, high = np.where(value < goal, x, low), np.where(value < goal, high, x)
        slope = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - log_b - value)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            new = x - (value - goal) / slope
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        # The next step would be about the square of this one.
        if (np.abs(new - x) <= 1e-11 * x).all():
            return new
        x = new
    return x


def shares(k: np.ndarray, n: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The exact two-sided interval of k of n."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    tail, low, high = (1 - level) / 2, np.zeros(len(k)), np.ones(len(k))
    some, rest = k > 0, k < n
    low[some] = quantile(tail, k[some], (n - k + 1)[some])
    high[rest] = 1 - quantile(tail, (n - k)[rest], (k + 1)[rest])
    return low, high


def rate_ratios(k1, n1, k0, n0, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The exact interval of the ratio of two event rates, row by row; without events before, it has no upper bound. Unknown counts give an unknown interval."""
    k1, n1, k0, n0 = (np.asarray(x, float) for x in (k1, n1, k0, n0))
    low, high = np.full(len(k1), np.nan), np.full(len(k1), np.nan)
    known = np.isfinite(k1 + n1 + k0 + n0) & (k1 + k0 > 0) & (n1 > 0)
    a, b = shares(k1[known], (k1 + k0)[known], level)
    with np.errstate(divide="ignore"):
        scale = lambda q: np.where(q >= 1, np.inf, q / (1 - q) * (n0 / n1)[known])
        low[known], high[known] = scale(a), scale(b)
    return low, high
