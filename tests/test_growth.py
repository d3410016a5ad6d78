"""Steps that grew faster than their input, or through the driver."""

from ridgework.operators import corridors, graph, grid, linear, paths, simplify, spatial
from ridgework.plans import catalog, terrain
from ridgework.sources import shared, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_meet_cells_by_merges(spark, sf):
    c = terrain.cells(spark, sf)
    edges = grid.marked_edges(c).withColumn("w", grid.route_cost())
    costs = c.select("q", "r", c["elev"].alias("cost"))
    routes = c.selectExpr("veg AS route", "q", "r", "elev AS seconds")
    for df in (grid.stencil(c), edges, paths.predecessors(edges, costs), corridors.density(routes, c.selectExpr("veg AS route", "1L AS cluster"), c)):
        assert "BroadcastHashJoin" not in plan(df)
    assert "BroadcastHashJoin" not in plan(grid.trafficability(c, terrain.movers(spark)))


def test_routes_and_corridors_meet_by_merges(spark, sf, monkeypatch):
    """Rows of routes were broadcast by the size of the suppliers that they come from; ranks still broadcast a row a range."""
    seen = []
    for module in (corridors, graph):
        monkeypatch.setattr(module, "written", lambda df, name: seen.append(plan(df)) or shared.written(df, name))
    seen.append(plan(catalog.QUERIES["corridor_effects"](spark, sf)))
    joins = [line for p in seen for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert len(seen) > 20 and all("_p2" in line for line in joins)


def test_samples_of_routes(spark):
    """Routes of 1 to 9 cells, one with a gap, one without a name."""
    routes = spark.range(10).selectExpr("id AS route", "explode(sequence(0, CAST(id AS INT))) AS i").filter("route <> 8 OR i <> 4").selectExpr("nullif(route, 9) AS route", "i", "i AS q", "0 AS r")
    found = {r.route: tuple(None if x is None else round(x / grid.STEP_M) for x in (r.x0, r.x1, r.x2)) for r in corridors.route_samples(routes).collect()}
    assert found == {0: (0, 0, 0), 1: (0, 1, 1), 2: (1, 1, 2), 3: (1, 2, 2), 4: (1, 2, 3), 5: (1, 3, 4), 6: (2, 3, 5), 7: (2, 4, 5), 8: (2, None, 6)}


def test_tiles_of_a_narrow_grid_are_long(spark):
    strip = spark.range(50 * 4000).selectExpr("CAST(id % 50 AS INT) + 3 AS q", "CAST(id / 50 AS INT) - 7 AS r")
    assert grid._tile_shape(strip, 256) == (3, -7, 50, 65536 // 50)
    assert grid._tile_shape(strip.selectExpr("r AS q", "q AS r"), 256) == (-7, 3, 65536 // 50, 50)
    assert grid._tile_shape(strip, 32) == (3, -7, 32, 32)
    assert grid._tile_shape(strip.limit(0), 32) == (0, 0, 32, 32)


def test_lines_are_computed_column_by_column_in_many_tasks(spark, sf):
    """Expressions that mention each other were inlined into ones of thousands of terms, a row at a time in one task."""
    pairs = terrain.cells(spark, sf).selectExpr("q", "r", "0 AS q2", "200 AS r2").coalesce(1)
    lines = grid.line_cells(pairs)
    assert lines.rdd.getNumPartitions() > 1
    assert len(plan(lines)) < 20_000


def test_long_lines_compress(spark, tmp_path):
    """Line after line took almost 8 bytes a cell as Parquet, so that the result of a large grid filled disks."""
    parts = spark.range(1_000_000, 1_000_128).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    catalog.QUERIES["hex_line"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/lines")
    rows = spark.read.parquet(f"{tmp_path}/lines").count()
    assert rows > 128 * 19_000 and sum(f.stat().st_size for f in (tmp_path / "lines").glob("*.parquet")) < 4 * rows


def test_lines_drawn_together_are_the_same(spark):
    """More lines than go together, repeated ones, of no length, without an end."""
    pairs = spark.range(300).selectExpr("id % 290 AS id", "CAST(id % 7 AS INT) AS q", "CAST(id % 290 AS INT) AS r", "CASE WHEN id <> 11 THEN CAST(id % 7 AS INT) - 3 * CAST(id % 3 AS INT) END AS q2", "CAST(id % 290 - id % 5 * 64 AS INT) AS r2")
    one, more = (sorted(grid.line_cells(p, together).collect()) for p, together in ((pairs, False), (pairs, True)))
    assert [r.asDict() for r in one] == [r.asDict() for r in more] and len(one) > 30_000
    assert grid.line_cells(pairs.limit(0), True).count() == 0


def test_places_are_measured_once(spark):
    """Many points and nodes at a few places: distances and tests of places, not of their pairs."""
    sites = spark.range(3000).selectExpr("id", "-35e0 + id % 3 * 0.001e0 AS lat", "149e0 AS lng")
    nodes = spark.range(2000).selectExpr("id AS ord", "-35e0 + id % 2 * 0.001e0 AS lat", "149e0 AS lng")
    pairs = spatial._near_places(sites, nodes, 150.0).collect()
    assert len(pairs) == 5 and len({(p.lat, p.n_lat) for p in pairs}) == 5
    found = spatial.within(sites, nodes, 150.0)
    assert found.count() == 5000 * 1000 and found.select("id", "ord").distinct().count() == 5000 * 1000
    best = {r.id: r.ord for r in spatial.nearest(sites, nodes, 150.0).collect()}
    assert best == {i: 1998 if i % 3 == 0 else 1999 for i in range(3000)}
    square = "array(named_struct('x1', 148.9e0, 'y1', -35.1e0, 'x2', 149.1e0, 'y2', -35.1e0), named_struct('x1', 149.1e0, 'y1', -35.1e0, 'x2', 149.1e0, 'y2', -34.9e0), named_struct('x1', 149.1e0, 'y1', -34.9e0, 'x2', 148.9e0, 'y2', -34.9e0), named_struct('x1', 148.9e0, 'y1', -34.9e0, 'x2', 148.9e0, 'y2', -35.1e0))"
    polygons = spark.range(7, 500).selectExpr("id AS ord", f"{square} AS edges")
    inside = spatial.in_polygons(sites, polygons, 0.1)
    assert inside.count() == 3000 and inside.select("ord").distinct().collect()[0][0] == 7


def test_pairs_within_reach_come_after_the_last_shuffle(spark, monkeypatch):
    """Pairs of points and places of nodes were shuffled, which grow as the square; rows without an id count as others do, places that are unknown meet nothing."""
    monkeypatch.setattr(spatial, "AT_ONCE", 7, raising=False)
    sites = spark.range(300).selectExpr("nullif(id, 5) AS id", "CASE WHEN id <> 6 THEN -35e0 + id % 3 * 0.001e0 END AS lat", "149e0 AS lng")
    nodes = spark.range(200).selectExpr("nullif(id, 8) AS ord", "-35e0 + id % 2 * 0.001e0 AS lat", "CASE WHEN id <> 9 THEN 149e0 END AS lng")
    found = spatial.within(sites, nodes, 150.0)
    last = plan(found).split("Exchange")[0]
    assert "SortMergeJoin" in last and "ATAN" in last.upper()  # where distances are taken
    near = lambda i, j: i != 6 and j != 9 and abs(i % 3 - j % 2) <= 1
    rows = sorted((-1 if r.id is None else r.id, -1 if r.ord is None else r.ord) for r in found.collect())
    assert rows == sorted((-1 if i == 5 else i, -1 if j == 8 else j) for i in range(300) for j in range(200) if near(i, j))
    assert spatial.within(sites, nodes.limit(0), 150.0).count() == 0


def test_tasks_are_as_many_as_rows_ask_for(spark, sf, monkeypatch):
    """What a task sorts was a fixed share of the table, so it grew with it."""
    monkeypatch.setattr(shared, "ROWS_A_TASK", 300)
    points, segments = tables.derived(spark, sf, "lineitem", tables.POINT), tables.derived(spark, sf, "lineitem", tables.SEGMENT)
    least = points.count() // 300
    for df in (linear.chainage(segments), linear.runs(segments, "veg"), linear.slope_pieces(linear.densify(linear.vertices(points)))):
        assert plan(df).count("Exchange hashpartitioning") == 1
        assert df.rdd.getNumPartitions() >= least
    assert plan(linear.runs(segments, "veg")).count("Sort [") == 1
    monkeypatch.setattr(shared, "MERGED", 4)
    assert [shared.dealt(points, "plan", light=x).rdd.getNumPartitions() for x in (False, True)] == [least, 4]
    monkeypatch.setattr(shared, "MOST_ROWS", 600)
    assert shared.dealt(points, "plan", light=True).rdd.getNumPartitions() == least // 2
    assert shared.dealt(points.limit(0), "plan").count() == 0


def test_short_lines_are_simplified_where_they_lie(spark, monkeypatch):
    """Every open range was shuffled and written anew each round; longer lines than a task may have still go that way, to the same rows."""
    tracks = spark.range(1200).selectExpr("id % 7 AS line", "id AS i", "-35e0 + (id * id % 83) * 0.00003e0 + id * 0.00001e0 AS lat", "149e0 + (id * 31 % 67) * 0.00004e0 AS lng")
    rounds = simplify.simplify(tracks, most=2).collect()
    mixed = simplify.simplify(tracks.unionAll(tracks.selectExpr("line + 10", "i", "lat", "lng").filter("line % 10 = 3 AND i < 300")), most=100).collect()
    monkeypatch.setattr(simplify, "in_rounds", None)
    once = simplify.simplify(tracks).collect()
    assert sorted(once) == sorted(rounds) and 100 < len(once) < 1200
    assert sorted(r for r in mixed if r.line < 10) == sorted(once) and any(r.line == 13 for r in mixed)


def test_cells_of_paths_are_neither_written_nor_shuffled(spark, monkeypatch):
    """Each round of doubling wrote the cells of all paths anew; now only the chains that paths are made of, each once, and which path holds which."""
    rows = []
    monkeypatch.setattr(paths, "written", lambda df, name: rows.append((x := shared.written(df, name)).count()) or x)
    line = spark.range(1, 6000).selectExpr("CAST(id % 2 AS INT) AS q", "CAST(id AS INT) - 700 AS r", "CAST((id + 1) % 2 AS INT) AS p_q", "CAST(id AS INT) - 701 AS p_r")
    targets = line.filter("r % 100 = 99").select("q", "r").unionAll(spark.sql("SELECT 0 AS q, -700 AS r"))
    found = paths.paths(line, targets)
    assert found.count() == sum(range(800, 6001, 100)) + 1 and found.distinct().count() == found.count()
    assert found.filter("step <> r + 700 OR q <> step % 2 OR r > t_r").isEmpty()
    assert sum(rows) < 6000


def test_paths_wind_through_tiles(spark):
    """Paths that leave a tile and come back, chains that are cut within one, targets without a way and without a tile."""
    snake = [(q if r % 2 else -q, r) for r in range(-9, 9) for q in range(-12, 13)]
    before = {b: a for a, b in zip(snake, snake[1:])} | {(20, r): (20 - r % 2, r - 1) for r in range(1, 30)} | {(19, r): (20, r - 1) for r in range(1, 30)}
    targets = [snake[0], snake[-1], snake[200], snake[201], (20, 29), (19, 28), (20, 3), (300, -300)]
    want = set()
    for t in targets:
        way = [t]
        while way[-1] in before:
            way.append(before[way[-1]])
        want |= {(*t, step, *at) for step, at in enumerate(reversed(way))}
    b = spark.createDataFrame([(*k, *v) for k, v in before.items()], "q int, r int, p_q int, p_r int")
    for tile, most in ((4, 3), (16, 5), (512, 512)):
        found = [tuple(r) for r in paths.paths(b, spark.createDataFrame(targets, "q int, r int"), tile, most).collect()]
        assert set(found) == want and len(found) == len(want)
