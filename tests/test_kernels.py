import math
import random

import numpy as np
import pytest

from tidemark.config import Settings, SettingsError, load
from tidemark.functions import kernels as K


def cheapest(x, least, penalty):
    """Optimal partition, every start tried."""
    n = len(x)
    cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(least, n + 1):
        for at in range(end - least + 1):
            if math.isfinite(cost[at]):
                c = cost[at] + float(((x[at:end] - x[at:end].mean()) ** 2).sum()) + penalty
                if c < cost[end] - 1e-9:
                    cost[end], back[end] = c, at
    out, at = [], n
    while at > 0:
        at = back[at]
        if at:
            out.append(at)
    return out[::-1]


@pytest.mark.parametrize("seed", range(12))
def test_change_points_are_optimal(seed):
    r = np.random.default_rng(seed)
    n, least = int(r.integers(20, 110)), int(r.integers(2, 8))
    x = r.normal(size=n) + (np.arange(n) > n // 2) * float(r.choice([0, 1.5, 4]))
    assert K.change_points(x, least, 3 * math.log(n)) == cheapest(x, least, 3 * math.log(n))
    assert K.change_points(np.ones(5), 7, 1.0) == []


def test_seasonal_component_is_recovered_and_ignores_a_trend():
    t = np.arange(364)
    wave = 10 * np.sin(2 * np.pi * t / 52)
    assert np.abs(K.stl_seasonal(wave + 100, 52) - wave).max() < 1e-9
    assert np.abs(K.stl_seasonal(wave + 100 + 0.3 * t, 52) - wave).max() < 1e-9
    week = np.tile([1.0, 2, 3, 4, 5, 9, 9], 20)
    assert np.abs(K.stl_seasonal(week, 7) - (week - week.mean())).max() < 1e-9


def test_trend_statistics():
    y = np.array([1.0, 3, 2, 5, 4, 7])
    pairs = [(y[j] - y[i], j - i) for i in range(6) for j in range(i + 1, 6)]
    assert K.kendall(y)[0] == sum(np.sign(d) for d, _ in pairs)
    assert K.sen_slope(y, np.arange(6.0))[0] == np.median([d / n for d, n in pairs])
    assert K.mann_kendall(np.ones(20), 0.05, 10) == (1.0, "constant")
    assert K.mann_kendall(y, 0.05, 10)[1] == "original"
    r = np.random.default_rng(2)
    p, test = K.mann_kendall(r.normal(size=35) + np.arange(35), 0.05, 10)
    assert test == "hamed_rao" and p < 0.001
    assert np.array_equal(K.ranks(np.array([2.0, 1, 2, 3])), [2.5, 1, 2.5, 4])


def test_exact_interval():
    assert K.clopper_pearson(3, 20, 0.95) == pytest.approx((0.0320709, 0.3789268), abs=1e-6)
    assert K.clopper_pearson(0, 10, 0.95)[0] == 0 and K.clopper_pearson(10, 10, 0.95)[1] == 1
    assert K.rate_ratio(3, 7, 0, 20, 0.95)[0] == math.inf
    assert K.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_settings():
    assert load() == Settings()
    assert load({"min_slope": 0.02}).min_slope == 0.02
    with pytest.raises(SettingsError) as e:
        load({"recent_frac": 3.0, "min_slope": 0.001, "concentration_top1": 0.9})
    assert len(e.value.faults) == 3
    with pytest.raises(SettingsError) as e:
        load({"nothing": 1, "stl_robust": 3, "min_history": 5})
    assert len(e.value.faults) == 3


def test_missing_random_state_is_not_needed():
    random.seed(0)
    assert K.odd_above(10.2) == 11 and K.odd_above(11) == 11 and K.odd_above(12) == 13
