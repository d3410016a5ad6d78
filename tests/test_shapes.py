"""Rings, overlaps and simplified lines against plain walks and dense counts."""

import math
import random

from pyspark.sql import functions as F

from ridgework.operators import overlap, rings, simplify

FRAGMENTS = "relation long, ord int, coords array<struct<lat:double,lng:double>>"


def square(lat, lng, size):
    return [(lat, lng), (lat, lng + size), (lat + size, lng + size), (lat + size, lng), (lat, lng)]


def test_rings_by_hand(spark):
    sw, se, ne, nw = (-35.0, 149.0), (-35.0, 149.02), (-34.98, 149.02), (-34.98, 149.0)
    rows = [
        (1, 0, [sw, se]), (1, 1, [se, ne]), (1, 2, [ne, nw, sw]),  # three fragments in order
        (2, 5, [se, sw]), (2, 3, [ne, se]), (2, 9, [sw, nw, ne]),  # in any order and direction
        (3, 0, square(-35.0, 150.0, 0.02)), (3, 1, square(-35.0, 151.0, 0.02)),  # two rings of one relation
        (4, 0, [se, ne]), (4, 1, [nw, ne]), (4, 2, [sw, nw]), (4, 3, [(0.0, 0.0), (0.0, 1.0)]),  # never closes
        (5, 0, [sw]), (5, 1, []), (6, 0, [sw, se, sw]),  # too few points; there and back is no ring
        (7, 0, [sw, (se[0] + 2e-8, se[1])]), (7, 1, [se, ne, nw, (sw[0], sw[1] - 3e-8)]),  # ends a hair apart
    ]
    got = {(r.relation, r.first): r for r in rings.stitch(spark.createDataFrame(rows, FRAGMENTS)).collect()}
    path = lambda k: [(p.lat, p.lng) for p in got[k].coords]
    assert path((1, 0)) == [sw, se, ne, nw, sw] and got[(1, 0)].closed
    assert path((2, 3)) == [ne, se, sw, nw, ne] and got[(2, 3)].closed  # begins with its least fragment, forwards
    assert got[(3, 0)].closed and got[(3, 1)].closed and path((3, 1)) == square(-35.0, 151.0, 0.02)
    assert path((4, 0)) == [se, ne, nw, sw] and not got[(4, 0)].closed and path((4, 3)) == [(0.0, 0.0), (0.0, 1.0)]
    assert not got[(6, 0)].closed and got[(7, 0)].closed and len(path((7, 0))) == 5
    assert set(got) == {(1, 0), (2, 3), (3, 0), (3, 1), (4, 0), (4, 3), (6, 0), (7, 0)}
    assert rings.stitch(spark.createDataFrame([], FRAGMENTS)).count() == 0


def test_a_ring_of_a_thousand_fragments(spark, monkeypatch):
    n, rng = 1000, random.Random(5)
    at = [(round(math.cos(2 * math.pi * i / n), 7), round(math.sin(2 * math.pi * i / n), 7)) for i in range(n)]
    ords = list(range(n))
    rng.shuffle(ords)
    rows = [(1, ords[i], [at[i], at[(i + 1) % n]][:: rng.choice((1, -1))]) for i in range(n)]
    rounds = []
    real = rings.written
    monkeypatch.setattr(rings, "written", lambda df, name: rounds.append(name) or real(df, name))
    ring = rings.stitch(spark.createDataFrame(rows, FRAGMENTS)).first()
    assert ring.closed and len(ring.coords) == n + 1 and {(p.lat, p.lng) for p in ring.coords} == set(at)
    steps = [at.index((p.lat, p.lng)) for p in ring.coords]
    assert {(b - a) % n for a, b in zip(steps, steps[1:])} in ({1}, {n - 1})
    assert rounds.count("ring-links") <= 2 * 12 + 2


def test_small_relations_are_walked_in_a_task_and_large_ones_followed_to_the_same_ways(spark, monkeypatch):
    rng, rows = random.Random(7), []
    for relation in range(8):
        points = [(float(i), float(rng.randrange(3))) for i in range(5)]
        rows += [(relation, o, [rng.choice(points), (9.0, o / 10), rng.choice(points)]) for o in range(rng.randrange(1, 7))]
    names = []
    real = rings.written
    monkeypatch.setattr(rings, "written", lambda df, name: names.append(name) or real(df, name))
    ways = lambda: {(r.relation, r.first, r.closed, tuple((p.lat, p.lng) for p in r.coords)) for r in rings.stitch(spark.createDataFrame(rows, FRAGMENTS)).collect()}
    walked = ways()
    assert len(walked) > 8 and "ring-links" not in names
    monkeypatch.setattr(rings, "MOST_FRAGMENTS", 3)
    assert ways() == walked and "ring-links" in names


def test_holes_go_to_the_ring_that_holds_them(spark):
    outer = [(1, 0, square(0.0, 0.0, 1.0)), (1, 1, square(0.0, 5.0, 1.0)), (2, 0, square(0.0, 0.0, 1.0)), (1, 2, [(8.0, 8.0), (9.0, 9.0)])]
    inner = [(1, 0, square(0.4, 5.4, 0.1)), (1, 1, square(0.2, 0.2, 0.1)), (1, 2, square(0.6, 0.6, 0.1)), (1, 3, square(3.0, 3.0, 0.1)), (1, 4, [(0.5, 0.5), (0.5, 0.6)])]
    df = rings.with_holes(rings.stitch(spark.createDataFrame(outer, FRAGMENTS)), rings.stitch(spark.createDataFrame(inner, FRAGMENTS)), 0.3)
    got = {(r.relation, r.first): None if r.holes is None else [h[0].lat for h in r.holes] for r in df.collect()}
    assert got == {(1, 0): [0.2, 0.6], (1, 1): [0.4], (2, 0): None, (1, 2): None}
    areas = df.filter("closed").select(F.round(rings.ring_area(F.col("coords")), 9)).distinct().collect()
    assert [a[0] for a in areas] == [1.0]


def inside(x, y, cx, cy, s):
    dx, dy = abs(x - cx), abs(y - cy)
    return dx <= s * 3**0.5 / 2 and dy <= s - dx / 3**0.5


def test_overlap_against_dense_points(spark):
    fine, coarse = 10.0, 31.0
    centre = lambda q, r, s: (s * (3**0.5 * q + 3**0.5 / 2 * r), s * 1.5 * r)
    cells, painted = [(q, r) for q in range(-3, 6) for r in range(-3, 6)], [(0, 0), (1, 0), (0, 1)]
    got = {(r.q, r.r): r.overlap for r in overlap.covered(spark.createDataFrame(cells, "q int, r int"), spark.createDataFrame(painted, "q int, r int"), fine, coarse).collect()}
    n = 60
    for c in cells:
        x, y = centre(*c, fine)
        points = [(x + (i / n - 0.5) * 2 * fine, y + (j / n - 0.5) * 2 * fine) for i in range(n + 1) for j in range(n + 1)]
        points = [p for p in points if inside(*p, x, y, fine)]
        share = sum(any(inside(*p, *centre(*k, coarse), coarse) for k in painted) for p in points) / len(points)
        assert abs(got[c] - share) < 0.03, c
    assert max(got.values()) == 1.0 and min(got.values()) == 0.0 and sum(0.05 < v < 0.95 for v in got.values()) > 5
    assert overlap.covered(spark.createDataFrame(cells, "q int, r int"), spark.createDataFrame([], "q int, r int"), fine, coarse).agg(F.max("overlap")).first()[0] == 0.0


def recursive(points, tolerance):
    """Indices that stay."""

    def off(a, b, p):
        k = 111320 * math.cos(math.radians(a[0]))
        bx, by, px, py = (b[1] - a[1]) * k, (b[0] - a[0]) * 111320, (p[1] - a[1]) * k, (p[0] - a[0]) * 111320
        t = 0.0 if bx * bx + by * by == 0 else max(0.0, min(1.0, (px * bx + py * by) / (bx * bx + by * by)))
        return round(math.hypot(px - t * bx, py - t * by), 6)

    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        lo, hi = stack.pop()
        worst, most = -1, tolerance
        for i in range(lo + 1, hi):
            if (d := off(points[lo], points[hi], points[i])) > most:
                worst, most = i, d
        if worst >= 0:
            keep.add(worst)
            stack += [(lo, worst), (worst, hi)]
    return keep


def test_simplify_equals_the_recursion(spark):
    rng, lines = random.Random(9), {}
    for line, n in enumerate((1, 2, 3, 40, 700, 4000)):
        lat, lng, points = -35.0, 149.0, []
        for _ in range(n):
            lat, lng = lat + rng.gauss(0.00003, 0.00012), lng + rng.gauss(0, 0.0002)
            points.append((lat, lng))
        lines[line] = points
    lines[10] = [(-35.0, 149.0)] * 5 + [(-35.0, 149.001), (-35.0, 149.0)]  # a closed line, repeated points
    lines[11] = [(-35.0, 149.0), (-35.0002, 149.001), (-35.0, 149.002), (-35.0002, 149.003), (-35.0, 149.004)]  # equally far: the first
    rows = [(k, i, *p) for k, points in lines.items() for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "line long, i long, lat double, lng double")
    got = {}
    for r in simplify.simplify(df).collect():
        got.setdefault(r.line, set()).add(r.i)
    assert got == {k: recursive(p, 12.0) for k, p in lines.items()}
    assert simplify.simplify(df.limit(0)).count() == 0
