"""Paths, grown grids, coordinates, boxes and walked updates against plain loops."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from ridgework.operators import coordinates, entities, grid, incident_box, linear, paths
from ridgework.sources.shared import fresh_folder

SIDES = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def test_paths_add_up_to_their_costs(spark):
    rng = random.Random(2)
    cells = {(q, r) for q in range(24) for r in range(20) if rng.random() > 0.15 or q + r < 4}
    w = {((q, r), (q + a, r + b)): rng.choice((1.0, 2.0, 5.0)) for q, r in cells for a, b in SIDES if (q + a, r + b) in cells}
    weights = spark.createDataFrame([(*a, *b, x) for (a, b), x in w.items()], "q int, r int, b_q int, b_r int, w double")
    sources = spark.createDataFrame([(0, 0)], "q int, r int")
    best, heap = {(0, 0): 0.0}, [(0.0, (0, 0))]
    while heap:
        c, at = heapq.heappop(heap)
        for a, b in SIDES:
            to = (at[0] + a, at[1] + b)
            if (at, to) in w and c + w[at, to] < best.get(to, math.inf):
                best[to] = c + w[at, to]
                heapq.heappush(heap, (best[to], to))
    costs = grid.accumulated_cost(weights, sources, 7)
    assert {(r.q, r.r): r.cost for r in costs.collect()} == best
    targets = costs.filter("(q + 2 * r) % 11 = 3")
    found = {}
    for r in paths.paths(paths.predecessors(weights, costs), targets).collect():
        found.setdefault((r.t_q, r.t_r), {})[r.step] = (r.q, r.r)
    assert set(found) == {(r.q, r.r) for r in targets.collect()} and len(found) > 20
    for to, steps in found.items():
        way = [steps[i] for i in range(len(steps))]
        assert way[0] == (0, 0) and way[-1] == to and sum(w[a, b] for a, b in zip(way, way[1:])) == pytest.approx(best[to])
    shut = spark.createDataFrame([(q, r, b, s, math.inf) for (q, r), (b, s) in w if b == 12] + [(q, r, b, s, 3.0) for (q, r), (b, s) in w if s == 4] * 2, "q int, r int, b_q int, b_r int, factor double")
    p = {((x.q, x.r), (x.b_q, x.b_r)): x.w for x in paths.penalised(weights, shut).collect()}
    assert all(p[k] == (None if k[1][0] == 12 else w[k] * (9 if k[1][1] == 4 else 1)) for k in w)
    assert max(r.q for r in grid.accumulated_cost(paths.penalised(weights, shut), sources, 7).collect()) <= 11


def test_grown_grid_equals_the_whole_fit_and_reads_touched_tiles(spark):
    cells = spark.range(60 * 60).select((F.col("id") % 60).cast("int").alias("q"), F.floor(F.col("id") / 60).cast("int").alias("r"), (F.sin(F.col("id") * 0.37) * 9).alias("elev"))
    fresh, folder = "q BETWEEN 20 AND 22 AND r BETWEEN 30 AND 33", fresh_folder(spark, "t")
    grid.with_tile(cells, 10).write.partitionBy("tile").parquet(folder)
    changed = grid.refitted(spark.read.parquet(folder), cells.filter(fresh), 10)
    rows = lambda df: {tuple(r) for r in df.collect()}
    whole = grid.plane_fit(cells)
    assert rows(grid.merged_planes(grid.plane_fit(cells.filter(f"NOT ({fresh})")), changed)) == rows(whole)
    assert {(r.q, r.r) for r in changed.collect()} == {(q + a, r + b) for q in range(20, 23) for r in range(30, 34) for a, b in (*SIDES, (0, 0))}
    files = changed.select("q").inputFiles()
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters: [" in plan and "tile" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows(grid.refitted(spark.read.parquet(folder), cells.filter(fresh), 10, most_tiles=1)) == rows(changed)  # too many tiles to name
    assert grid.refitted(spark.read.parquet(folder), cells.limit(0), 10).count() == 0


def test_utm_round_trip_below_a_millimetre(spark):
    rng = random.Random(3)
    rows = [(z, rng.uniform(-44, -9), 6 * z - 183 + rng.uniform(-3.5, 3.5)) for z in range(49, 57) for _ in range(100)] + [(55, -35.0, 147.0), (31, 48.0, 3.0)]
    df = spark.createDataFrame(rows, "zone int, lat double, lng double")
    e, n = coordinates.to_utm(F.col("lat"), F.col("lng"), F.col("zone"))
    df = df.withColumn("e", e).withColumn("n", n)
    lat, lng = coordinates.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    for r in df.withColumn("lat2", lat).withColumn("lng2", lng).collect():
        assert abs(r.lat2 - r.lat) * 111_000 < 1e-3 and abs(r.lng2 - r.lng) * 111_000 < 1e-3
    at = {(r.zone, r.lat): (r.e, r.n) for r in df.collect()}
    assert at[55, -35.0] == pytest.approx((500_000, 6_126_835.0), abs=200) and at[31, 48.0] == pytest.approx((500_000, 5_316_300.0), abs=400)  # on the central meridian: 500 km, and the meridian's arc
    assert [r[0] for r in spark.createDataFrame([(148.9,), (150.0,), (-180.0,), (179.9,)], "x double").select(coordinates.zone_of(F.col("x"))).collect()] == [55, 56, 1, 60]


def test_stand_off_equals_the_loop(spark):
    def hav(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    def moved(lat, lng, bearing, d):
        d, t, p = d / 6_371_000, math.radians(bearing), math.radians(lat)
        to = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(t))
        return math.degrees(to), lng + math.degrees(math.atan2(math.sin(t) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(to)))

    rng, rows, want = random.Random(8), [], {}
    fires = [(1, 200.0, None, None, 800.0), (2, 5000.0, 50.0, 10.0, 100.0), (3, 1.0, 1.0, 1.0, 4000.0), (4, 100.0, None, 7.0, 500.0)]
    for fire, head, flank, rear, pace in fires:
        sectors = {"head": 4, "leftFlank": 1, "rightFlank": 3} if fire < 4 else {"rear": 1}
        i = 0
        for sector, n in sectors.items():
            for _ in range(n):
                rows.append((fire, i, -35 + rng.gauss(0, 0.004), 149 + rng.gauss(0, 0.004), rng.uniform(0, 360), sector))
                i += 1
    for fire, head, flank, rear, pace in fires:
        mine = [r for r in rows if r[0] == fire]
        for sector in {r[5] for r in mine}:
            v = [r for r in mine if r[5] == sector]
            other = next((r for s in incident_box.SECTORS if s != sector for r in mine if r[5] == s), None)
            ros = head if sector == "head" else (rear if rear is not None else head) if sector == "rear" else (flank if flank is not None else head)
            d, hours, ok = 100.0, None, False
            for _ in range(3):
                line = [moved(*r[2:5], d) for r in v]
                line += [(other[2], other[3])] if len(v) < 2 and other else []
                if len(line) < 2:
                    break
                length = sum(hav(a, b) for a, b in zip(line, line[1:]))
                hours = 0.0 if length < 1 else length / pace
                need = min(5000.0, max(30.0, ros * hours))
                ok, d = abs(need - d) <= 15, need
                if ok:
                    break
            want[fire, sector] = (d, hours, ok, len(v))
    v = spark.createDataFrame(rows, "fire long, id long, lat double, lng double, bearing double, sector string")
    off = incident_box.stand_off(v, spark.createDataFrame(fires, "fire long, head double, flank double, rear double, pace double"))
    got = {(r.fire, r.sector): r for r in off.collect()}
    assert set(got) == set(want) and {ok for *_, ok, _ in want.values()} == {True, False}
    for k, (d, hours, ok, n) in want.items():
        r = got[k]
        assert r.distance_m == pytest.approx(d, abs=1e-4) and r.hours == (None if hours is None else pytest.approx(hours, abs=1e-7)) and r.converged == ok and r.vertices == n
    ring = incident_box.box(v, off).filter("fire = 1").orderBy("place").collect()
    assert len(ring) == 9 and (ring[0].lat, ring[0].lng) == (ring[-1].lat, ring[-1].lng)


def test_updates_of_a_hot_entity_are_walked(spark):
    n = 20_000
    updates = spark.range(n).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.lit(5)).alias("expected"))
    known = spark.createDataFrame([(1, 3, False), (10, 1, True), (20, 7, None)], "id long, version long, standard boolean")
    got = {(r.id, r.seq): (r.status, r.version) for r in entities.updated(known, updates).collect()}
    version = 3
    for seq in range(n):
        if seq % 10:
            good = seq % 3 != 0 or version == 5
            version += good
            assert got[1, seq] == (200 if good else 409, version)
    assert got[10, 10] == (409, 1) and got[20, 20] == (200, 8) and got[40, 40] == (404, None) and len(got) == n


def test_a_line_without_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(linear, "MAX_VERTICES", 3)
    schema = "plan long, line long, part long, supp long, price double, len double, slope double, lat double, lng double"
    rows = [(1, i, 0, 0, 0.0, 0.0, 0.0, -35.0, 149.0 + i * 1e-3) for i in range(4)]
    assert linear.vertices(spark.createDataFrame(rows[:3], schema)).count() == 3
    with pytest.raises(Exception, match="more than 3 vertices"):
        linear.vertices(spark.createDataFrame(rows, schema)).collect()
