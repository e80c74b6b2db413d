import math
import random
import time

import numpy as np

from tidemark.functions import intervals as I
from tidemark.functions import kernels as K


def test_equal_to_sums_of_all_terms():
    r = random.Random(1)
    rows = [(r.randint(0, 300), r.randint(1, 40), r.randint(0, 300), r.randint(1, 400)) for _ in range(150)] + [(0, 3, 5, 4), (5, 3, 0, 4), (0, 1, 1, 1), (1, 1, 0, 1), (1, 9, 1, 1), (2000, 7, 1, 28), (1, 7, 2000, 28)]
    rows = [x for x in rows if x[0] + x[2]]
    for level in (0.95, 0.5, 0.999):
        low, high = I.rate_ratios(*zip(*rows), level)
        for i, x in enumerate(rows):
            _, a, b = K.rate_ratio(*x, level)
            assert math.isclose(low[i], a, rel_tol=1e-9, abs_tol=1e-12) and (high[i] == b or math.isclose(high[i], b, rel_tol=1e-9)), x


def test_large_counts_and_unknown_ones():
    n = 10**6
    began = time.time()
    low, high = I.rate_ratios(np.full(1000, n), np.full(1000, 7.0), np.linspace(n // 2, 2 * n, 1000).astype(int), np.full(1000, 28.0), 0.95)
    assert (time.time() - began) / 1000 < 0.02 and (low < high).all()
    middle = n / 7 / (np.linspace(n // 2, 2 * n, 1000).astype(int) / 28)
    assert ((low < middle) & (middle < high) & (high / low < 1.01)).all()
    low, high = I.rate_ratios([1, math.nan, 0, 3], [7, 7, 7, 0], [0, 1, 0, 1], [28, 28, 28, 28], 0.95)
    assert low[0] > 0 and high[0] == math.inf and np.isnan([*low[1:], *high[1:]]).all()
    assert [len(x) for x in I.rate_ratios([], [], [], [], 0.95)] == [0, 0]


def test_quantiles_give_their_tail():
    r = np.random.default_rng(2)
    a, b = r.uniform(0.5, 5000, 200), r.uniform(0.5, 5000, 200)
    for p in (0.025, 0.25, 1e-6):
        x = I.quantile(p, a, b)
        assert np.allclose(np.exp(I.log_cdf(x, a, b, I.log_beta(a, b))), p, rtol=1e-9)
