import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from ridgework.llm import clustering as c

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, x int"


def brute(rows, k, rounds, dim, scale=64.0):
    kept = [(i, [math.floor(scale * v) for v in e]) for i, e in rows if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    cent = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, r)), i) for i, r in enumerate(cent))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        groups = [[x for (_, x), o in zip(kept, own) if o == i] for i in range(len(cent))]
        cent = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, cent)]
    final = [(i, *nearest(x)) for i, x in kept]
    fit = lambda v: v if v < 2**63 else None
    total = lambda ds: None if any(d >= 2**63 for d in ds) else fit(sum(ds))
    of = {o: total([d for _, d, p in final if p == o]) for o in range(len(cent))}
    all_ = None if None in of.values() else total([d for _, d, _ in final])
    return Counter((i, o, fit(d), of[o], all_, hashlib.sha256(",".join(map(str, cent[o])).encode()).hexdigest()) for i, d, o in final)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 1, "c", 2) for i, e in rows], SCHEMA)
    return Counter(map(tuple, c.cluster(df, **kw).collect()))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3, (9, 6))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.4, 6)).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # repeated vectors, ties
    assert run(spark, rows, k=8, rounds=4, dim=6) == brute(rows, 8, 4, 6)


def test_edge_rows(spark):
    ok = [float(i) for i in range(3)]
    rows = [(1, ok), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [math.nan, 1.0, 1.0]), (6, [math.inf, 1.0, 1.0]), (7, [1.0, 2.0]), (1, ok), (1, [9.0, 9.0, 9.0]), (None, [-0.01, -5.0, 0.0]), (8, [-0.0, 0.0, 1e-9])]
    assert run(spark, rows, k=16, rounds=3, dim=3) == brute(rows, 16, 3, 3)  # fewer vectors than centroids
    assert run(spark, rows[:1], k=16, rounds=3, dim=3) == brute(rows[:1], 16, 3, 3)
    assert run(spark, [], dim=3) == Counter() == run(spark, [(1, None)], dim=3)
    huge = [(i, [(-1) ** i * 10.0 ** (i % 40), float(i), 3e7]) for i in range(40)]  # beyond doubles' integers, and beyond longs
    assert run(spark, huge, k=5, rounds=3, dim=3) == brute(huge, 5, 3, 3)


def test_ties_between_centroids(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-6, 7) for y in range(-6, 7))]
    assert run(spark, rows, k=9, rounds=5, dim=2, scale=1.0) == brute(rows, 9, 5, 2, 1.0)


@pytest.mark.parametrize("keep", [1, 3, 7])
def test_bounds_hold_and_save_work(keep):
    rng = np.random.default_rng(keep)
    centres = rng.integers(-2000, 2000, (12, 8))
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.float64)
    cent = c.Centroids((centres + rng.integers(-90, 90, centres.shape)).tolist(), keep=keep)
    b = c.scan(x, cent, keep)
    for _ in range(4):
        cent = cent.replaced([[v + int(s) for v, s in zip(r, rng.integers(-9, 10, 8))] for r in cent.rows], keep)
        b = c.follow(x, b, cent)
        d = np.sqrt(c.squared(x, cent))
        assert (b.cluster == d.argmin(axis=1)).all() and (b.upper >= d.min(axis=1)).all()
        assert (b.lower[:, :-1] <= np.take_along_axis(d, b.near, axis=1)).all()
        rest = d.copy()
        np.put_along_axis(rest, np.hstack([b.cluster[:, None], b.near]), np.inf, axis=1)
        assert (b.lower[:, -1] <= rest.min(axis=1)).all()
        assert b.measured < x.shape[0] * 12 / 4
