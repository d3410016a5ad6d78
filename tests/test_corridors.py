import itertools
import math
import random

from pyspark.sql import functions as F

from ridgework.operators import corridors as co
from ridgework.operators.graph import connected_components, ranked

SIDES = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def union(nodes, pairs):
    """Least label of each node's component."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_connected_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)] + [(5000, 5000), (1, 0)]
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(nodes, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked_over_ranges(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 500, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, x long, i long").repartition(6)
    assert [r.rank for r in ranked(df, [F.col("x").desc(), "i"]).orderBy(F.col("x").desc(), "i").collect()] == list(range(1, 1501))
    got = ranked(df, ["x", "i"], "n", ["k"]).collect()
    for k in (None, 0, 1, 2):
        of = sorted((r.x, r.i, r.n) for r in got if r.k == k)
        assert [n for *_, n in of] == list(range(1, len(of) + 1))


def test_clusters_equal_all_pairs(spark):
    rng, near = random.Random(7), 100.0
    samples = []
    for route in range(260):
        base = [rng.choice((0, 230, 460, 640)) + rng.gauss(0, 35) for _ in range(6)] if route % 3 else [200.0] * 5 + [100.0 * (route % 6)]  # repeated, exactly at the limit
        samples.append((route, *base))
    close = lambda a, b: all(math.hypot(a[1 + 2 * k] - b[1 + 2 * k], a[2 + 2 * k] - b[2 + 2 * k]) <= near for k in range(3))
    want = union(range(260), [(a[0], b[0]) for a, b in itertools.combinations(samples, 2) if close(a, b)])
    df = spark.createDataFrame(samples, "route long, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
    assert {r.route: r.cluster for r in co.cluster_samples(df, near).collect()} == want
    assert co.cluster_samples(df.limit(0), near).count() == 0


def test_a_snake_over_many_tiles_is_one_component(spark):
    snake, r = [], 0
    for turn in range(6):  # rows joined at alternate ends
        snake += [(q, r) for q in range(30)]
        snake += [(29 if turn % 2 == 0 else 0, r + 1)]
        r += 2
    cells = [(1, q, r) for q, r in snake] + [(2, q, r) for q, r in snake if r % 2 == 0] + [(1, 100, 100)]
    got = {(x.cluster, x.q, x.r): (x.first.r, x.first.q) for x in co.components(spark.createDataFrame(cells, "cluster long, q int, r int"), tile=5).collect()}
    nodes = set(cells)
    pairs = [(a, (a[0], a[1] + dq, a[2] + dr)) for a in nodes for dq, dr in SIDES if (a[0], a[1] + dq, a[2] + dr) in nodes]
    first = {}
    label = union([(c, r, q) for c, q, r in nodes], [((a[0], a[2], a[1]), (b[0], b[2], b[1])) for a, b in pairs])
    for (c, r, q), (_, fr, fq) in label.items():
        first[(c, q, r)] = (fr, fq)
    assert got == first and len({v for k, v in got.items() if k[0] == 1}) == 2 and len({v for k, v in got.items() if k[0] == 2}) == 6


def test_field_by_hand(spark):
    """Two avenues with common ends stay apart; a small component is dropped; shares, widths and matches are plain arithmetic."""
    cells = spark.createDataFrame([(q, r) for q in range(0, 40) for r in range(0, 30)], "q int, r int")
    lines = {1: [(q, 5) for q in range(40)], 2: [(q, 5) for q in range(40)], 3: [(q, 24 if 4 <= q < 36 else 5) for q in range(40)]}
    routes = spark.createDataFrame([(n, i, q, r, 100.0 * n) for n, line in lines.items() for i, (q, r) in enumerate(line)], "route long, i int, q int, r int, seconds double")
    clusters = co.cluster_routes(routes)
    assert {r.route: r.cluster for r in clusters.collect()} == {1: 1, 2: 1, 3: 3}
    found = co.corridor_cells(routes, clusters, cells)
    rows = {(r.cluster, r.first.r): r for r in co.corridors(found, routes, clusters).collect()}
    one = rows[(1, min(r for c, r in rows if c == 1))]
    assert one["rank"] == 1 and one.routes == 2 and abs(one.share - 2 / 3) < 1e-12 and one.median_s == 150.0 and one.fastest_s == 100.0
    assert {k[0] for k in rows} == {1, 3} and all(r.cells >= 4 for r in rows.values())
    density = {(r.q, r.r): r.density for r in found.filter("cluster = 1").collect()}
    assert max(density.values()) == 1.0 and all(d >= 0.12 - 1e-9 for d in density.values()) and density[(20, 5)] > density[(20, 6)]
    facts = cells.select("q", "r", F.when(F.col("q") != 7, F.col("q") * 10.0).alias("arrival"), F.when(F.col("q") < 30, "unrestricted").alias("mobility"), (F.col("r") == 5).alias("water"))
    widths = co.width_slices(found, facts)
    s = co.summary(co.corridors(found, routes, clusters), widths, 50.0)
    of = s.filter("rank = 1").first()
    mine = [(r.q, r.r) for r in found.filter("cluster = 1").collect()]
    slices = {}
    for q, _ in mine:
        if q != 7:
            slices.setdefault(min(17, math.floor((q * 10.0) / 390.0 * 18)), []).append(q)
    assert of.bottleneck == min(map(len, slices.values())) and of.widest == max(map(len, slices.values()))
    assert abs(of.unrestricted - sum(q < 30 for q, _ in mine) / len(mine)) < 1e-12 and of.restricted == 0 and abs(of.severe + of.unrestricted - 1) < 1e-12
    same = {r.rank_before: r for r in co.effects(s, found, s, found).collect()}
    # ends of the second avenue lie in the first corridor too, which is the first match of equal overlap
    assert same[1].status == "unchanged" and same[1].rank_after == 1 and all(abs(r.overlap - 1) < 1e-12 for r in same.values()) and {r.rank_after for k, r in same.items() if k > 1} <= {1, *same}
    gone = co.effects(s, found, s.limit(0), found.limit(0))
    assert {r.status for r in gone.collect()} == {"collapsed"} and co.impact(gone).first().score == 1.0 and co.impact(gone.limit(0)).first().score == 0.0
    total = co.totals(s, routes, cells).first()
    assert total.cells == found.count() and total.routed_cells == len({c for line in lines.values() for c in line}) and total.likely == 1
    empty = routes.limit(0)
    none = co.corridor_cells(empty, co.cluster_routes(empty), cells)
    assert none.count() == 0 and co.corridors(none, empty, co.cluster_routes(empty)).count() == 0
