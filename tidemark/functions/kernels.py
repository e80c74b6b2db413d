"""Sequential numerics that no column expression can state, for one series' array at a time."""

from __future__ import annotations

import math

import numpy as np


def normal_p(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(q: float) -> float:
    """By bisection of the distribution function."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < q else (lo, mid)
    return (lo + hi) / 2


def sen_slope(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Median of pairwise slopes, and median(y) - slope * median(x)."""
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    ok = dx > 0
    slope = float(np.median((y[j] - y[i])[ok] / dx[ok]))
    return slope, float(np.median(y) - slope * np.median(x))


def ranks(y: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    _, at, n = np.unique(y, return_inverse=True, return_counts=True)
    end = np.cumsum(n)
    return ((end - n + 1 + end) / 2.0)[at]


def kendall(y: np.ndarray) -> tuple[float, float]:
    """The statistic S and its variance under independence, ties allowed for."""
    n = len(y)
    i, j = np.triu_indices(n, 1)
    ties = np.unique(y, return_counts=True)[1]
    return float(np.sign(y[j] - y[i]).sum()), (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18


def z_of(s: float, var: float) -> float:
    if not var > 0:
        return math.nan if var < 0 or s else 0.0
    return (s - np.sign(s)) / math.sqrt(var)


def mann_kendall(y: np.ndarray, alpha: float, corrected_from: int) -> tuple[float, str]:
    """p-value and the test used: with the variance corrected for autocorrelation (Hamed and Rao 1998) from that many
    points if the correction leaves a variance, else the original one."""
    if np.ptp(y) == 0:
        return 1.0, "constant"
    n = len(y)
    s, var = kendall(y)
    if n >= corrected_from:
        x = np.arange(1, n + 1, dtype=float)
        r = ranks(y - x * sen_slope(y, x)[0])
        r = r - r.mean()
        acf = np.array([(r[k:] * r[: n - k]).sum() for k in range(1, n)]) / (r * r).sum()
        lag = np.arange(1, n)
        keep = np.abs(acf) > normal_quantile(1 - alpha / 2) / math.sqrt(n)
        weight = (n - lag) * (n - lag - 1.0) * (n - lag - 2.0)
        p = normal_p(z_of(s, var * (1 + 2 / (n * (n - 1) * (n - 2)) * float((weight * acf)[keep].sum()))))
        if math.isfinite(p):
            return p, "hamed_rao"
    p = normal_p(z_of(s, var))
    return (p if math.isfinite(p) else 1.0), "original"


def change_points(x: np.ndarray, least: int, penalty: float) -> list[int]:
    """Inner bounds of the cheapest segmentation: squared deviations from segment means plus a penalty a segment.

    Dynamic programming over end points with pruning of starts that can no
    longer win; all starts of an end are priced at once from running sums.
    """
    n = len(x)
    if n < least:
        return []
    x = x - x.mean()
    s1, s2 = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    cost, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    cost[0] = 0.0
    starts = np.empty(0, dtype=np.int64)
    for end in [*range(least, n), n]:
        new = end - least
        if new == 0 or np.isfinite(cost[new]):
            starts = np.append(starts, new)
        d = s1[end] - s1[starts]
        total = cost[starts] + np.maximum(s2[end] - s2[starts] - d * d / (end - starts), 0.0) + penalty
        best = int(total.argmin())
        cost[end], back[end] = total[best], starts[best]
        starts = starts[total <= cost[end] + penalty]
    out, at = [], n
    while at > 0:
        at = int(back[at])
        if at:
            out.append(at)
    return out[::-1]


def loess(y: np.ndarray, q: int, degree: int, weight: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Local regression of equally spaced values at positions (from 1) with tricube weights of the nearest q."""
    n = len(y)
    at = np.arange(1, n + 1) if at is None else at
    width = min(q, n)
    left = np.clip(at - (width + 1) // 2, 0, n - width)
    x = left[:, None] + np.arange(width) + 1.0
    h = np.maximum(at - x[:, 0], x[:, -1] - at) + max(0, (q - n) // 2)
    r = np.abs(x - at[:, None])
    w = np.where(r <= 0.999 * h[:, None], np.where(r > 0.001 * h[:, None], (1 - (r / h[:, None]) ** 3) ** 3, 1.0), 0.0)
    rows = left[:, None] + np.arange(width)
    w = w * weight[rows]
    total = w.sum(axis=1)
    ok = total > 0
    w = w / np.where(ok, total, 1)[:, None]
    if degree > 0:
        a = (w * x).sum(axis=1)
        b, c = at - a, (w * (x - a[:, None]) ** 2).sum(axis=1)
        tilt = np.sqrt(c) > 0.001 * (n - 1)
        b = np.where(tilt, b / np.where(c > 0, c, 1), 0.0)
        w = w * (b[:, None] * (x - a[:, None]) + 1)
    return np.where(ok, (w * y[rows]).sum(axis=1), y[np.clip(at - 1, 0, n - 1)])


def means(x: np.ndarray, k: int) -> np.ndarray:
    s = np.concatenate(([0.0], np.cumsum(x)))
    return (s[k:] - s[:-k]) / k


def odd_above(v: float) -> int:
    k = math.ceil(v)
    return k if k % 2 else k + 1


def stl_seasonal(y: np.ndarray, period: int, robust: bool = True, degree: int = 0, smoother: int = 7) -> np.ndarray:
    """Seasonal component by seasonal-trend decomposition (Cleveland et al. 1990): 2 inner passes and 15 robust rounds,
    or 5 inner passes without."""
    n = len(y)
    trend_q, low_q = odd_above(1.5 * period / (1 - 1.5 / smoother)), odd_above(period + 1)
    trend, weight, seasonal = np.zeros(n), np.ones(n), np.zeros(n)
    for round_ in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                part = (y - trend)[phase::period]
                w = weight[phase::period]
                cycle[phase::period] = loess(part, smoother, degree, w, np.arange(0, len(part) + 2))
            low = loess(means(means(means(cycle, period), period), 3), low_q, 1, np.ones(n))
            seasonal = cycle[period : period + n] - low
            trend = loess(y - seasonal, trend_q, 1, weight)
        if robust and round_ < 15:
            r = np.abs(y - seasonal - trend)
            h = 6 * np.median(r)
            if h == 0:
                weight = np.ones(n)
            else:
                weight = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0.0))
    return seasonal


def binomial_tail(k: int, n: int, q: float) -> float:
    """P(X >= k) of a binomial, from the logarithms of its terms."""
    if k <= 0:
        return 1.0
    if q <= 0 or q >= 1:
        return float(q >= 1)
    i = np.arange(k, n + 1)
    lg = np.array([math.lgamma(v + 1) for v in i]) + np.array([math.lgamma(n - v + 1) for v in i])
    return float(min(1.0, np.exp(math.lgamma(n + 1) - lg + i * math.log(q) + (n - i) * math.log1p(-q)).sum()))


def clopper_pearson(k: int, n: int, level: float) -> tuple[float, float]:
    """The exact two-sided interval of a share."""
    tail = (1 - level) / 2

    def solve(f):
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda q: binomial_tail(k, n, q) < tail)
    high = 1.0 if k == n else solve(lambda q: 1 - binomial_tail(k + 1, n, q) > tail)
    return low, high


def rate_ratio(k1: int, n1: int, k0: int, n0: int, level: float) -> tuple[float, float, float]:
    """Ratio of two event rates with its exact interval; without events before, it is unbounded."""
    scale = lambda q: math.inf if q >= 1 else q / (1 - q) * n0 / n1
    low, high = clopper_pearson(k1, k0 + k1, level)
    return scale(k1 / (k0 + k1)), scale(low), scale(high)
