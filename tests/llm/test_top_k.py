import math
import random

import numpy as np
import pytest

from tidemark.llm import top_k

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, k=20, every=20):
    """Scores of all pairs in whole numbers of any size, those beyond 64 bits at that bound."""
    good = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((n, i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(64 * x))) for x in v]))
    out = []
    for n, i, v in good:
        if i % every == 0:
            found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for m, j, w in good if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def got(spark, rows, **more):
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as size", "'x' as v", "2 as cell", "0 as rank")
    return sorted(tuple(r) for r in top_k.top_k(frame.repartition(3), lambda i: i % 20 == 0, **more).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("size,seeds", [(64, 1024), (7, 30), (1, 5)])
def test_against_all_pairs(spark, monkeypatch, size, seeds):
    monkeypatch.setattr(top_k, "SEEDS", seeds)
    r = np.random.default_rng(size)
    rows = [(i, (r.normal(size=size) * (1 + (i % 7 == 0) * 3)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]
    assert got(spark, rows) == brute(rows)


def test_clusters_are_pruned():
    """Of a query near one cluster, the other clusters' blocks are left out by their bounds; nothing is lost."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(8, 16)) * 40
    v = np.floor(np.concatenate([c + r.normal(size=(300, 16)) for c in centres])).astype(np.int64)
    blocks = top_k.blocks_of(list(range(len(v))), list(range(len(v))), list(v), (v.astype(float) ** 2).sum(axis=1).tolist(), 100)
    seen, scores = [], top_k.scores
    top_k.scores = lambda a, b, top: seen.append(len(a) * len(b)) or scores(a, b, top)
    try:
        q = v[5::300]
        found = top_k.searched(blocks, np.arange(5, len(v), 300), q, 20, np.full(len(q), -(1 << 63)))
    finally:
        top_k.scores = scores
    for i, f in enumerate(found.found):
        exact = v @ q[i]
        exact[5 + 300 * i] = -(1 << 40)
        assert f[:, 1].tolist() == np.lexsort((np.arange(len(v)), -exact))[:20].tolist()
    assert sum(seen) < len(q) * len(v) / 2


def test_bounds_hold_at_each_level():
    r = np.random.default_rng(3)
    a, b = r.normal(size=(40, 21)) * 30, r.normal(size=(50, 21)) * 30
    bounds = [top_k.statistics(a, n) @ top_k.statistics(b, n).T for n in top_k.LEVELS]
    for coarse, fine in zip(bounds, [*bounds[1:], a @ b.T]):
        assert (coarse >= fine - 1e-6).all()


def test_awkward_vectors(spark):
    r = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [r.choice([-0.5, 0.0, 0.015625, 1.0]) for _ in range(3)]) for i in range(80)]
    rows += [(100, None), (120, [1.0, None, 2.0]), (140, [nan, 1.0, 1.0]), (160, [1.0, inf, 0.0]), (None, [1.0, 1.0, 1.0]), (180, []), (181, []), (182, []), (200, [1.0] * 5), (220, [1.0] * 7), (-20, [1.0, 1.0, 1.0])]
    rows += [(240, [1e30, -1e30, 1e17]), (241, [1e30, 1e30, 1e17]), (260, [1e8, 3e8, -1e8]), (261, [1e8, 1.0, 5e8]), (0, rows[0][1]), (0, rows[0][1])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(20, [1.0])]) == []


def test_grid_bounds_cells():
    for n_queries, n in ((0, 0), (1, 1), (513, 10_256), (4 * 10**6, 8 * 10**7), (10**6, 10**6)):
        columns, lines = top_k.grid(n_queries, n, 200)
        assert n_queries * n / (columns * lines) <= top_k.MOST_PAIRS
