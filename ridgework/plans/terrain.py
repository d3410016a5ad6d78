"""Hex grids over the star schema's parts as cells: algebra, stencils, mobility, least costs, lines of sight."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import mobility as m
from ..functions.production import interpolate_sql
from ..operators import grid
from ..sources import tables as t
from ..sources.shared import fresh_folder, written
from .registry import query

CELL = t.derived_sql("part", t.CELL)
STEP = f"{grid.STEP_M!r}"
_NEAR = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(geo.NEIGHBOURS)) + ") AS o(dir, dq, dr))"


def cells(spark, sf):
    return t.derived(spark, sf, "part", t.CELL)


def movers(spark):
    return spark.createDataFrame(list(m.MOVERS), m.MOVER_COLUMNS)


def _edges_sql(of: str, more: str = "") -> str:
    return f"""(SELECT *, degrees(atan(abs(grade))) AS slope FROM (SELECT a.*, o.dir, (b.elev - a.elev) / {STEP} AS grade{more}, {', '.join(f'b.{c} AS b_{c}' for c in t.CELL)}
  FROM {of} AS a CROSS JOIN {_NEAR} AS o JOIN {of} AS b ON b.q = a.q + o.dq AND b.r = a.r + o.dr))"""


_EDGES = _edges_sql(CELL)
_VA, _VB = grid.VEG_COST_SQL.format(v="veg"), grid.VEG_COST_SQL.format(v="b_veg")
_MARKED = f"(SELECT c.*, coalesce(e.boundary, false) AS boundary FROM {CELL} AS c LEFT JOIN (SELECT q, r, bool_or(abs({_VA} - {_VB}) >= 1) AS boundary FROM {_EDGES} GROUP BY q, r) AS e USING (q, r))"
_MEDGES = _edges_sql(_MARKED, ", b.boundary AS b_boundary")
_UNIT = f"{grid.SLOPE_COST_SQL.format(s='slope')} * ({_VA} + {_VB}) / 2 * (CASE WHEN trail AND b_trail THEN 0.35e0 ELSE 1e0 END) * (CASE WHEN boundary AND b_boundary THEN 0.65e0 ELSE 1e0 END)"


@query(f"SELECT q, r, round({grid.SIZE_M} * (sqrt(3.0) * q + sqrt(3.0) / 2 * r), 4) AS x, round({grid.SIZE_M}e0 * 1.5e0 * r, 4) AS y, CAST((abs(q - 10) + abs(r - 5) + abs(q - 10 + r - 5)) / 2 AS INTEGER) AS ring FROM {CELL}")
def hex_project(spark, sf):
    """Local metres of each cell and its ring around cell (10, 5)."""
    x, y = geo.hex_center(F.col("q"), F.col("r"), grid.SIZE_M)
    return cells(spark, sf).select("q", "r", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), geo.hex_distance(F.col("q"), F.col("r"), F.lit(10), F.lit(5)).alias("ring"))


_LOCAL = "(SELECT c_custkey AS id, -35.0 + (c_custkey % 211) * 0.0007e0 AS lat, 149.0 + (c_custkey % 307) * 0.0005e0 + 0.000013e0 AS lng FROM customer)"
_XY = "(SELECT id, (lng - 149.0) * 111320.0 * cos(radians(-35.0)) AS x, (lat + 35.0) * 111320.0 AS y FROM " + _LOCAL + ")"


@query(f"""
SELECT id, round(x, 4) AS x, round(y, 4) AS y, CAST(CASE WHEN dx > dy AND dx > dz THEN -ry - rz ELSE rx END AS INTEGER) AS q, CAST(CASE WHEN dx > dy AND dx > dz THEN rz WHEN dy > dz THEN rz ELSE -rx - ry END AS INTEGER) AS r
FROM (SELECT *, abs(rx - fq) AS dx, abs(ry + fq + fr) AS dy, abs(rz - fr) AS dz FROM (SELECT *, floor(fq + 0.5) AS rx, floor(-fq - fr + 0.5) AS ry, floor(fr + 0.5) AS rz FROM (
  SELECT *, (sqrt(3.0) / 3 * x - y / 3) / 25.0 AS fq, (2.0 / 3 * y) / 25.0 AS fr FROM {_XY})))""")
def hex_unproject(spark, sf):
    """The cell of each point: to local metres, to fractional axial coordinates, rounded in cube coordinates."""
    p = t.derived(spark, sf, "customer", {"id": "c_custkey", "lat": "-35.0e0 + (c_custkey % 211) * 0.0007e0", "lng": "149.0e0 + (c_custkey % 307) * 0.0005e0 + 0.000013e0"})
    x, y = geo.to_local(F.col("lat"), F.col("lng"), -35.0, 149.0)
    p = p.select("id", x.alias("x"), y.alias("y"))
    q, r = grid.cube_round((F.lit(3**0.5 / 3) * F.col("x") - F.col("y") / 3) / grid.SIZE_M, F.lit(2 / 3) * F.col("y") / grid.SIZE_M)
    return p.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), q.alias("q"), r.alias("r"))


_RING = "(SELECT * FROM (VALUES (0, -1, 1, 1, 0), (1, 0, 1, 1, -1), (2, 1, 0, 0, -1), (3, 1, -1, -1, 0), (4, 0, -1, -1, 1), (5, -1, 0, 0, 1)) AS s(side, cq, cr, dq, dr))"


@query(f"""
SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(q + cq * rad + dq * (i % greatest(rad, 1)) AS INTEGER) AS ring_q, CAST(r + cr * rad + dr * (i % greatest(rad, 1)) AS INTEGER) AS ring_r FROM (
  SELECT *, unnest(range(0, greatest(1, 6 * rad))) AS i FROM (SELECT p_partkey, q, r, p_size % 4 AS rad FROM (SELECT p_partkey, p_size, {t.CELL['q']} AS q, {t.CELL['r']} AS r FROM part))) JOIN {_RING} ON side = i // greatest(rad, 1)""")
def hex_ring(spark, sf):
    """The ring of 0 to 3 around each cell, in order."""
    p = t.derived(spark, sf, "part", {"p_partkey": "p_partkey", "q": t.CELL["q"], "r": t.CELL["r"], "rad": "p_size % 4"})
    p = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), 6 * F.col("rad")) - 1)))
    dq, dr = grid.ring_of(F.col("rad"), F.col("i"))
    return p.select("p_partkey", "i", (F.col("q") + dq).alias("ring_q"), (F.col("r") + dr).alias("ring_r"))


@query(f"""
SELECT p_partkey, CAST(k AS INTEGER) AS place, CAST(q + coalesce(cq * rad + dq * (j % greatest(rad, 1)), 0) AS INTEGER) AS cell_q, CAST(r + coalesce(cr * rad + dr * (j % greatest(rad, 1)), 0) AS INTEGER) AS cell_r FROM (
  SELECT *, k - 3 * rad * (rad - 1) - 1 AS j FROM (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k <= 6 THEN 1 WHEN k <= 18 THEN 2 ELSE 3 END AS rad FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT p_partkey, {t.CELL['q']} AS q, {t.CELL['r']} AS r, 1 + p_size % 23 AS n FROM part))))
LEFT JOIN {_RING} ON rad > 0 AND side = j // greatest(rad, 1)""")
def hex_spiral(spark, sf):
    """The first 1 to 23 cells around each cell, ring by ring."""
    p = t.derived(spark, sf, "part", {"p_partkey": "p_partkey", "q": t.CELL["q"], "r": t.CELL["r"], "n": "1 + p_size % 23"})
    p = p.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rad = F.ceil((F.sqrt(12 * F.col("place") + 9) - 3) / 6).cast("int")
    p = p.withColumn("rad", rad).withColumn("j", F.when(F.col("rad") == 0, 0).otherwise(F.col("place") - 3 * F.col("rad") * (F.col("rad") - 1) - 1).cast("int"))
    dq, dr = grid.ring_of(F.col("rad"), F.col("j"))
    return p.select("p_partkey", "place", (F.col("q") + dq).alias("cell_q"), (F.col("r") + dr).alias("cell_r"))


_PAIRS = "(SELECT p_partkey, {q} AS q, {r} AS r, CAST(p_size % 17 AS INTEGER) AS q2, CAST(p_partkey % 23 AS INTEGER) AS r2 FROM part)".format(**t.CELL)


@query(f"""
SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(CASE WHEN i = 0 THEN q WHEN i = n THEN q2 WHEN dx > dy AND dx > dz THEN -ry - rz ELSE rx END AS INTEGER) AS lq, CAST(CASE WHEN i = 0 THEN r WHEN i = n THEN r2 WHEN dx > dy AND dx > dz THEN rz WHEN dy > dz THEN rz ELSE -rx - ry END AS INTEGER) AS lr
FROM (SELECT *, abs(rx - fq) AS dx, abs(ry + fq + fr) AS dy, abs(rz - fr) AS dz FROM (SELECT *, floor(fq + 0.5) AS rx, floor(-fq - fr + 0.5) AS ry, floor(fr + 0.5) AS rz FROM (
  SELECT *, q + 1e-6 + (q2 - q) * (i / greatest(n, 1)) AS fq, r + 2e-6 + (r2 - r) * (i / greatest(n, 1)) AS fr FROM (
    SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, greatest(abs(q - q2), abs(r - r2), abs(q + r - q2 - r2)) AS n FROM {_PAIRS})))))""")
def hex_line(spark, sf):
    """Lines of cells between two cells."""
    p = t.derived(spark, sf, "part", {"p_partkey": "p_partkey", "q": t.CELL["q"], "r": t.CELL["r"], "q2": "CAST(p_size % 17 AS INTEGER)", "r2": "CAST(p_partkey % 23 AS INTEGER)"})
    return grid.line_cells(p, together=True).select("p_partkey", "i", "lq", "lr")


@query(f"SELECT q, r, CAST(k AS INTEGER) AS k, round(25.0 * (sqrt(3.0) * q + sqrt(3.0) / 2 * r) + 25.0 * cos(radians(60 * k - 30)), 4) AS x, round(25.0 * 1.5 * r + 25.0 * sin(radians(60 * k - 30)), 4) AS y FROM (SELECT q, r, unnest(range(6)) AS k FROM {CELL})")
def hex_corners(spark, sf):
    """The six corners of each cell."""
    x, y = geo.hex_center(F.col("q"), F.col("r"), grid.SIZE_M)
    c = cells(spark, sf).select("q", "r", x.alias("x"), y.alias("y"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    turn = F.radians((60 * F.col("k") - 30).cast("double"))
    return c.select("q", "r", "k", F.round(F.col("x") + grid.SIZE_M * F.cos(turn), 4).alias("x"), F.round(F.col("y") + grid.SIZE_M * F.sin(turn), 4).alias("y"))


@query("SELECT o_orderkey, round(sqrt(greatest(1, o_totalprice * 2 * (100 + o_custkey % 400)) / (3 * sqrt(3.0) / 2 * greatest(1, o_orderkey % 650))), 6) AS size_m FROM orders")
def hex_size(spark, sf):
    """The size of cells of which so many cover a corridor of a length and half width."""
    area = F.greatest(F.lit(1.0), F.col("o_totalprice") * 2 * (100 + F.col("o_custkey") % 400))
    return t.table(spark, sf, "orders").select("o_orderkey", F.round(F.sqrt(area / (3 * 3**0.5 / 2 * F.greatest(F.lit(1), F.col("o_orderkey") % 650))), 6).alias("size_m"))


_BOX = "(SELECT s_suppkey AS id, (s_suppkey % 5) * 100.0e0 AS x0, (s_suppkey % 7) * 80.0e0 AS y0, (s_suppkey % 5) * 100.0e0 + 150.0e0 + (s_suppkey % 3) * 100.0e0 AS x1, (s_suppkey % 7) * 80.0e0 + 200.0e0 AS y1 FROM supplier)"


@query(f"""
SELECT id, CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r FROM (SELECT *, unnest(range(-40, 80)) AS q FROM (SELECT *, unnest(range(-10, 60)) AS r FROM {_BOX}))
WHERE 25.0 * (sqrt(3.0) * q + sqrt(3.0) / 2 * r) BETWEEN x0 AND x1 AND 25.0 * 1.5 * r BETWEEN y0 AND y1""")
def grid_box(spark, sf):
    """The cells whose centres are in a box: rows of cells from its height, cells of a row from its width."""
    b = t.derived(spark, sf, "supplier", {"id": "s_suppkey", "x0": "(s_suppkey % 5) * 100.0e0", "y0": "(s_suppkey % 7) * 80.0e0", "x1": "(s_suppkey % 5) * 100.0e0 + 150.0e0 + (s_suppkey % 3) * 100.0e0", "y1": "(s_suppkey % 7) * 80.0e0 + 200.0e0"})
    rows = b.withColumn("r", F.explode(F.sequence(F.floor(F.col("y0") / 37.5).cast("int"), F.ceil(F.col("y1") / 37.5).cast("int"))))
    first = lambda x: (F.col(x) / (grid.SIZE_M * 3**0.5)) - F.col("r") / 2
    all_ = rows.withColumn("q", F.explode(F.sequence(F.floor(first("x0")).cast("int"), F.ceil(first("x1")).cast("int"))))
    x, y = geo.hex_center(F.col("q"), F.col("r"), grid.SIZE_M)
    return all_.filter(x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1"))).select("id", "q", "r")


_STENCIL = f"""
SELECT c.q, c.r, veg, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS mean_slope, round(m, 6) AS max_slope, round(coalesce(cost, 0.6), 6) AS cost FROM {CELL} AS c
LEFT JOIN (SELECT q, r, count(*) AS n, avg(slope) AS a, max(slope) AS m, avg({_UNIT}) AS cost FROM {_MEDGES} GROUP BY q, r) AS e ON c.q = e.q AND c.r = e.r"""


@query(_STENCIL)
def hex_stencil_cost(spark, sf):
    return grid.stencil(cells(spark, sf))


_SEV = f"least(1.0, greatest({grid.VEG_SEVERITY_SQL}, sev) + 0.3 * least({grid.VEG_SEVERITY_SQL}, sev))"


@query(f"""
SELECT q, r, round(CASE WHEN max(cost) OVER () - min(cost) OVER () > 1e-9 THEN (cost - min(cost) OVER ()) / (max(cost) OVER () - min(cost) OVER ()) ELSE 0.5 END, 6) AS normal, round({_SEV}, 6) AS severity
FROM (SELECT *, {interpolate_sql("abs(mean_slope)", grid.SEVERITY)} AS sev FROM ({_STENCIL}))""")
def hex_normalise(spark, sf):
    """Costs between the least and the largest, and the severity of each cell on its own."""
    n = grid.normalised(grid.stencil(cells(spark, sf))).withColumn("sev", F.expr(interpolate_sql("abs(mean_slope)", grid.SEVERITY)))
    return n.select("q", "r", F.round("normal", 6).alias("normal"), F.round(F.expr(_SEV.replace("1.0", "1e0").replace("0.3 *", "0.3e0 *")), 6).alias("severity"))


def _smooth_sql(of: str) -> str:
    return f"(SELECT c.q, c.r, 0.5 * c.x + 0.5 * coalesce(avg(b.x), c.x) AS x FROM {of} AS c CROSS JOIN {_NEAR} AS o LEFT JOIN {of} AS b ON b.q = c.q + o.dq AND b.r = c.r + o.dr GROUP BY c.q, c.r, c.x)"


@query(f"""
WITH s0 AS (SELECT q, r, elev AS x FROM {CELL}), s1 AS (SELECT * FROM {_smooth_sql('s0')}), s2 AS (SELECT * FROM {_smooth_sql('s1')}) SELECT q, r, round(x, 5) AS elev FROM {_smooth_sql('s2')}""")
def hex_smooth3(spark, sf):
    return grid.smooth(cells(spark, sf), "elev").select("q", "r", F.round("elev", 5).alias("elev"))


@query(f"SELECT q, r, boundary FROM {_MARKED}")
def hex_boundary(spark, sf):
    return grid.boundaries(cells(spark, sf))


_X, _Y = f"{STEP} * (o.dq + o.dr / 2.0e0)", f"{grid.SIZE_M} * 1.5e0 * o.dr"
_SUMS = f"""(SELECT c.q, c.r, c.elev AS z, 1 + count(b.q) AS n, c.elev + coalesce(sum(b.elev), 0) AS sz, avg(b.elev) AS nz, avg(abs(b.elev - c.elev)) AS relief, max(abs(b.elev - c.elev) / sqrt(pow({_X}, 2) + pow({_Y}, 2))) AS steep,
  {', '.join(f"coalesce(sum(CASE WHEN b.q IS NOT NULL THEN {e} END), 0) AS {k}" for k, e in {'sx': _X, 'sy': _Y, 'sxx': f'pow({_X}, 2)', 'syy': f'pow({_Y}, 2)', 'sxy': f'({_X}) * ({_Y})', 'sxz': f'({_X}) * b.elev', 'syz': f'({_Y}) * b.elev'}.items())}
  FROM {CELL} AS c CROSS JOIN {_NEAR} AS o LEFT JOIN {CELL} AS b ON b.q = c.q + o.dq AND b.r = c.r + o.dr GROUP BY c.q, c.r, c.elev)"""
_PLANES = f"(SELECT *, n >= 3 AND abs(det) >= 1e-6 AS fits FROM (SELECT *, {', '.join(f'{e} AS {k}' for k, e in grid.CRAMER.items())} FROM {_SUMS}))"


_PLANE_FIT = f"""
SELECT p.q, p.r, round(degrees(atan(CASE WHEN any_value(fits) THEN sqrt(pow(any_value(db / det), 2) + pow(any_value(dc / det), 2)) ELSE coalesce(any_value(steep), 0) END)), 5) AS cross_slope,
       round(CASE WHEN any_value(fits) THEN coalesce(stddev_pop(b.elev - (da / det + db / det * {_X} + dc / det * {_Y})), 0) ELSE 0 END, 5) AS roughness, any_value({grid.PLACE_SQL.format(own="z", mean="nz", relief="coalesce(relief, 0)")}) AS place
FROM {_PLANES} AS p CROSS JOIN {_NEAR} AS o LEFT JOIN {CELL} AS b ON b.q = p.q + o.dq AND b.r = p.r + o.dr GROUP BY p.q, p.r""".replace("db / det", "db / nullif(det, 0)").replace("dc / det", "dc / nullif(det, 0)").replace("da / det", "da / nullif(det, 0)")


@query(_PLANE_FIT)
def plane_fit(spark, sf):
    """Cross slope, roughness and place (ridge, midslope, valley) of each cell."""
    return grid.plane_fit(cells(spark, sf))


@query(_PLANE_FIT)
def cross_slope_incremental(spark, sf):
    """Cross slopes of a grid that has grown: those of the first cells are stored by tile, new cells and their neighbours are fitted and merged in."""
    c = grid.with_tile(cells(spark, sf).select("q", "r", "elev"), 16)
    old, folder = "q < 30 AND r % 8 <> 7", fresh_folder(spark, "planes")
    c.write.partitionBy("tile").parquet(f"{folder}/cells")
    stored = written(grid.plane_fit(c.filter(old)), "planes")
    changed = grid.refitted(spark.read.parquet(f"{folder}/cells"), c.filter(f"NOT ({old})"), 16)
    return grid.merged_planes(stored, changed)


@query(f"SELECT q, r, dir, round({STEP} / 1000 / greatest(0.1, {m.foot_sql('trail AND b_trail', 'grade')}) * 3600, 6) AS seconds, round(degrees(atan(grade)), 6) AS signed_slope FROM {_EDGES}")
def edge_cost_foot(spark, sf):
    """Seconds on foot and the signed slope of each edge."""
    e = grid.edges(cells(spark, sf))
    return e.select("q", "r", "dir", F.expr(f"round({STEP} / 1000 / greatest(0.1e0, {m.foot_sql('trail AND b_trail', 'grade')}) * 3600, 6)").alias("seconds"), F.round(F.degrees(F.atan("grade")), 6).alias("signed_slope"))


def _movers_sql() -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in m.MOVERS)}) AS v({', '.join(c.split()[0] for c in m.MOVER_COLUMNS.split(', '))}))"


def _chain(of: str, steps: dict[str, str]) -> str:
    for name, sql in steps.items():
        of = f"(SELECT *, {sql} AS {name} FROM {of})"
    return of


@query(f"""
SELECT q, r, dir, mover, CASE WHEN blocked IS NULL THEN round({STEP} / 1000 / kmh * 3600, 5) END AS seconds, blocked, mobility
FROM {_chain(f"(SELECT *, trail AND b_trail AS on_, false AS dark FROM {_EDGES} AS e CROSS JOIN {_movers_sql()} AS m)", grid.EDGE_SQL)}""")
def edge_cost_movers(spark, sf):
    """Seconds, gate and class of each edge for walkers, a marching column, wheels and tracks."""
    return grid.edge_mobility(grid.edges(cells(spark, sf)), movers(spark))


@query(f"""
SELECT q, r, dir, mover, CASE WHEN blocked IS NULL THEN round({STEP} / 1000 / kmh * 3600, 5) END AS seconds, blocked, mobility
FROM {_chain(f"(SELECT *, trail AND b_trail AS on_, true AS dark FROM {_EDGES} AS e CROSS JOIN {_movers_sql()} AS m WHERE mover <> 'walker')", grid.EDGE_SQL)}""")
def edge_cost_night(spark, sf):
    """The same by night, without walkers."""
    return grid.edge_mobility(grid.edges(cells(spark, sf)), movers(spark).filter("mover <> 'walker'"), night=True)


#: Movers whose edges reach the gates and models that the others don't: one of a plain speed by grade, one that hardly climbs, a unit on the march, tracks that push stems over.
GATED = (
    ("scout", "foot", "tobler", 50.0, 45.0, 2.6, 0.6, None, 5.0, 0.8, 0.9, 0.7),
    ("cart", "wheeled", "vehicle", 1.5, 30.0, 0.5, 2.2, None, 30.0, 0.5, None, 0.6),
    ("platoon", "foot", "march", 3.0, 12.0, 0.4, 1.0, None, 4.0, 0.6, 0.85, 0.6),
    ("plough", "tracked", "vehicle", 30.0, 26.0, 1.3, 4.5, 160.0, 55.0, 0.5, None, 0.5),
)
_ROAD = {"primary": 65, "residential": 25, "service": 15}
_GATED_SQL = f"""
WITH mv AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else f"'{v}'" if isinstance(v, str) else f'CAST({v} AS DOUBLE)' for v in r) + ')' for r in GATED)}) AS v(mover, class, model, max_climb, max_side, ford, width, stem, road, cross_, load, night)),
c AS (SELECT CAST(p_partkey % 50 AS INTEGER) AS q, CAST(p_partkey // 50 AS INTEGER) AS r, p_retailprice / 10.0 AS z, ['grassland', 'lightshrub', 'mediumscrub', 'heavyforest'][p_size % 4 + 1] AS veg, p_size % 5 = 0 AS trail, (p_partkey % 13) * 2.0 AS side,
  CASE WHEN p_partkey % 23 = 0 THEN 2.5 WHEN p_partkey % 19 IN (0, 2) THEN 1.2 WHEN p_partkey % 19 = 1 THEN 0.4 WHEN p_partkey % 3 <> 0 AND p_partkey % 20 >= 10 THEN 1.0 WHEN p_partkey % 3 <> 0 AND p_partkey % 20 >= 3 THEN 0.4 END AS water,
  CASE WHEN p_size % 5 = 0 AND p_partkey % 4 <> 0 THEN CASE p_partkey % 7 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'service' WHEN 3 THEN 'path' ELSE 'track' END END AS way,
  CASE p_partkey % 6 WHEN 0 THEN 40 WHEN 1 THEN 10 END AS surface, CASE WHEN p_partkey % 5 = 0 THEN 25 END AS grade_cap, CASE p_partkey % 8 WHEN 0 THEN 20 WHEN 1 THEN 0 END AS smooth FROM part),
w AS (SELECT *, coalesce(least(CASE way {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _ROAD.items())} END, surface, grade_cap, smooth), CASE WHEN way IS NOT NULL THEN 30 END) AS cap FROM c),
e AS (SELECT a.q, a.r, d.dir, a.trail AND b.trail AS net, (b.z - a.z) / (25 * sqrt(3.0)) AS grade, a.side, b.veg, b.trail AS far_trail, CASE WHEN NOT (a.trail AND b.trail) THEN b.water END AS depth, CASE WHEN b.way IS NOT NULL THEN b.cap ELSE a.cap END AS cap
  FROM w AS a, (VALUES (0, 1, 0), (1, 1, -1), (2, 0, -1), (3, -1, 0), (4, -1, 1), (5, 0, 1)) AS d(dir, dq, dr) JOIN w AS b ON b.q = a.q + d.dq AND b.r = a.r + d.dr),
m AS (SELECT e.*, mv.*, degrees(atan(abs(grade))) AS slope, CASE veg WHEN 'grassland' THEN 50 WHEN 'lightshrub' THEN 8 WHEN 'mediumscrub' THEN 4 ELSE 2 END AS gap, CASE veg WHEN 'grassland' THEN 20 WHEN 'lightshrub' THEN 60 WHEN 'mediumscrub' THEN 150 ELSE 610 END AS stems FROM e, mv),
g AS (SELECT *, CASE WHEN NOT net AND slope > max_climb THEN 'climb' WHEN NOT net AND side > max_side THEN 'side-slope' WHEN depth > ford THEN 'ford' WHEN NOT net AND (class = 'wheeled' AND gap < width OR class = 'tracked' AND gap < width AND stems > stem) THEN 'vegetation' END AS blocked,
  CASE model WHEN 'tobler' THEN 6 * exp(-3.5 * abs(grade + 0.05)) ELSE CASE WHEN NOT net THEN road * cross_ WHEN model = 'vehicle' THEN least(road, coalesce(cap, road)) ELSE road END * greatest(0.05, 1 - pow(least(1, slope / max_climb), 2)) END AS base FROM m)
SELECT q, r, dir, mover, blocked, CASE WHEN blocked IS NULL THEN round(25 * sqrt(3.0) / 1000 / greatest(0.1, base * coalesce(load, 1) * CASE WHEN depth IS NULL THEN 1 ELSE 0.4 END) * 3600, 5) END AS seconds,
  CASE WHEN blocked IS NOT NULL THEN 'severely-restricted' WHEN slope > 0.85 * max_climb OR side > 0.85 * max_side OR class = 'wheeled' AND width > 0.85 * gap OR veg IN ('mediumscrub', 'heavyforest') AND NOT far_trail OR depth IS NOT NULL THEN 'restricted' ELSE 'unrestricted' END AS mobility FROM g"""


@query(_GATED_SQL)
def edge_cost_gates(spark, sf):
    """The same for movers that reach every gate and speed model; its SQL shares nothing with the expressions that it tests."""
    return grid.edge_mobility(grid.edges(cells(spark, sf)), spark.createDataFrame(list(GATED), m.MOVER_COLUMNS))


_STEEP = f"(SELECT c.*, coalesce(s, 0) AS steepest FROM {CELL} AS c LEFT JOIN (SELECT q, r, max(slope) AS s FROM {_EDGES} GROUP BY q, r) AS e ON c.q = e.q AND c.r = e.r)"


SQL_TRAFFICABILITY = f"SELECT q, r, mover, mobility FROM {_chain(f'(SELECT * FROM {_STEEP} AS c CROSS JOIN {_movers_sql()} AS m)', grid.CELL_SQL)}"


@query(SQL_TRAFFICABILITY)
def trafficability(spark, sf):
    """Mobility class of each cell for each mover."""
    return grid.trafficability(cells(spark, sf), movers(spark))


@query(f"SELECT q, r, {m.ford_sql()} AS ford_m, water_body OR waterway IS NOT NULL OR coalesce(frequency >= 0.15, false) AS signal FROM {CELL}")
def fording(spark, sf):
    """Depth to ford, null where the cell has no water, and whether anything speaks of water."""
    return cells(spark, sf).select("q", "r", F.expr(m.ford_sql()).alias("ford_m"), (F.col("water_body") | F.col("waterway").isNotNull() | F.coalesce(F.col("frequency") >= 0.15, F.lit(False))).alias("signal"))


@query(f"SELECT q, r, {m.ceiling_sql('highway', 'surface', 'tracktype', 'smoothness')} AS kmh FROM {CELL}")
def road_ceiling(spark, sf):
    """What a way's tags allow."""
    maps = [F.create_map(*(F.lit(float(x)) if i % 2 else F.lit(x) for kv in d.items() for i, x in enumerate(kv))) for d in (m.HIGHWAY, m.SURFACE, m.TRACKTYPE, m.SMOOTHNESS)]
    caps = [F.try_element_at(d, F.col(c)) for d, c in zip(maps, ("highway", "surface", "tracktype", "smoothness"))]
    return cells(spark, sf).select("q", "r", F.coalesce(F.least(*caps), F.when(F.col("highway") != "", float(m.UNTAGGED_TRACK))).alias("kmh"))


def _least_sql(weight: str, edges: str, start: str) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT q, r, b_q, b_r, {weight} AS w FROM {edges}),
b(q, r, cost) USING KEY (q, r) AS (
  SELECT q, r, CAST(0.0 AS DOUBLE) FROM {CELL} WHERE {start}
  UNION SELECT e.b_q, e.b_r, min(b.cost + e.w) FROM b JOIN e ON b.q = e.q AND b.r = e.r LEFT JOIN recurring.b AS o ON o.q = e.b_q AND o.r = e.b_r
  GROUP BY e.b_q, e.b_r, o.cost HAVING min(b.cost + e.w) < coalesce(o.cost, 1e300))"""


@query(f"{_least_sql(f'{STEP} * {_UNIT}', _MEDGES, 'q = 10 AND r = 0')} SELECT q, r, round(cost, 4) AS cost FROM b")
def accumulated_cost(spark, sf):
    """Least route cost from cell (10, 0) to all cells that it reaches."""
    c = cells(spark, sf)
    return grid.accumulated_cost(grid.marked_edges(c).withColumn("w", grid.route_cost()), c.filter("q = 10 AND r = 0"))


_FOOT = f"{STEP} / 1000 / greatest(0.1, {m.foot_sql('trail AND b_trail', 'grade')}) * 3600"


@query(f"{_least_sql(_FOOT, f'(SELECT b_q AS q, b_r AS r, q AS b_q, r AS b_r, trail, b_trail, grade FROM {_EDGES})', 'q = 40 AND r = 20')} SELECT q, r, round(cost, 4) AS cost FROM b")
def cost_to_go(spark, sf):
    """Least seconds on foot from each cell to cell (40, 20)."""
    c = cells(spark, sf)
    w = grid.edges(c).withColumn("w", F.expr(_FOOT.replace("0.1,", "0.1e0,")))
    return grid.accumulated_cost(grid.reversed_edges(w), c.filter("q = 40 AND r = 20"))


@query(f"""{_least_sql(_FOOT, _EDGES, 'q % 50 = 10 AND r % 20 = 0')}
SELECT q, r, round(cost, 4) AS cost, CAST(CASE WHEN round(cost, 4) <= 0 THEN NULL WHEN round(cost, 4) <= 900 THEN 15 WHEN round(cost, 4) <= 1800 THEN 30 WHEN round(cost, 4) <= 3600 THEN 60 WHEN round(cost, 4) <= 7200 THEN 120 WHEN round(cost, 4) <= 10800 THEN 180 END AS INTEGER) AS band FROM b""")
def isochrones(spark, sf):
    """Bands of walking time from several cells at once."""
    c = cells(spark, sf)
    w = grid.edges(c).withColumn("w", F.expr(_FOOT.replace("0.1,", "0.1e0,")))
    return grid.isochrones(grid.accumulated_cost(w, c.filter("q % 50 = 10 AND r % 20 = 0")))


RINGS, _OBS = 8, "q % 17 = 3 AND r % 13 = 6"
_XYZ = "25.0 * (sqrt(3.0) * {q} + sqrt(3.0) / 2 * {r})"
_SIGHT = f"""(
  SELECT o_q, o_r, q2 AS q, r2 AS r, coalesce(round(tt - ss, 12) >= 0, true) AS screened, coalesce(round(tt - bb, 12) >= 0, true) AS bare FROM (
    SELECT o_q, o_r, q2, r2, max(CASE WHEN i = n THEN atan2(z + 1.7 - drop - oz - 1.7, d) END) AS tt, max(CASE WHEN i < n THEN atan2(z - drop - oz - 1.7, d) END) AS bb, max(CASE WHEN i < n THEN atan2(z + cover - drop - oz - 1.7, d) END) AS ss FROM (
      SELECT l.*, c.elev AS z, {m.screening_sql('c.veg')} AS cover, d * d / (2 * 6371000.0 / (1 - 0.13)) AS drop FROM (
        SELECT *, sqrt(pow({_XYZ.format(q="lq", r="lr")} - ({_XYZ.format(q="o_q", r="o_r")}), 2) + pow(37.5 * (lr - o_r), 2)) AS d FROM (
          SELECT *, CASE WHEN i = n THEN q2 WHEN dx > dy AND dx > dz THEN -ry - rz ELSE rx END AS lq, CASE WHEN i = n THEN r2 WHEN dx > dy AND dx > dz THEN rz WHEN dy > dz THEN rz ELSE -rx - ry END AS lr
          FROM (SELECT *, abs(rx - fq) AS dx, abs(ry + fq + fr) AS dy, abs(rz - fr) AS dz FROM (SELECT *, floor(fq + 0.5) AS rx, floor(-fq - fr + 0.5) AS ry, floor(fr + 0.5) AS rz FROM (
            SELECT *, o_q + 1e-6 + (q2 - o_q) * (i / n) AS fq, o_r + 2e-6 + (r2 - o_r) * (i / n) AS fr FROM (
              SELECT *, unnest(range(1, n + 1)) AS i FROM (
                SELECT a.q AS o_q, a.r AS o_r, a.elev AS oz, b.q AS q2, b.r AS r2, greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q + a.r - b.q - b.r)) AS n
                FROM {CELL} AS a JOIN {CELL} AS b ON greatest(abs(a.q - b.q), abs(a.r - b.r), abs(a.q + a.r - b.q - b.r)) BETWEEN 1 AND {RINGS} WHERE a.q % 17 = 3 AND a.r % 13 = 6)))))) AS l0) AS l
      JOIN {CELL} AS c ON c.q = l.lq AND c.r = l.lr) GROUP BY o_q, o_r, q2, r2))"""


@query(f"SELECT o_q, o_r, q, r, screened, bare FROM {_SIGHT}")
def viewshed(spark, sf):
    """What observers on some cells see within 8 rings."""
    c = cells(spark, sf)
    return grid.viewshed(c, c.filter(_OBS).select("q", "r"), RINGS)


_SEEN = f"(SELECT DISTINCT q, r, true AS seen FROM {_SIGHT} WHERE screened UNION SELECT q, r, true FROM {CELL} WHERE {_OBS})"


@query(f"SELECT c.q, c.r, seen IS NULL AS dead_ground, {m.screening_sql('veg')} >= 2 AS covered, seen IS NULL OR {m.screening_sql('veg')} >= 2 AS concealed FROM {CELL} AS c LEFT JOIN {_SEEN} AS s ON s.q = c.q AND s.r = c.r")
def concealment(spark, sf):
    """Cells that no observer sees or that vegetation covers; observers see their own cells."""
    c = cells(spark, sf)
    own = c.filter(_OBS).select("q", "r")
    seen = grid.viewshed(c, own, RINGS).select("q", "r", "screened").unionByName(own.withColumn("screened", F.lit(True)))
    return grid.concealment(c, seen)


@query(f"SELECT c.highway AS corridor, count(*) AS cells, round(avg(CASE WHEN seen THEN 1.0 ELSE 0.0 END), 6) AS covered FROM {CELL} AS c LEFT JOIN {_SEEN} AS s ON s.q = c.q AND s.r = c.r WHERE c.highway IS NOT NULL GROUP BY c.highway")
def observation_coverage(spark, sf):
    """The share of each kind of way that observers see."""
    c = concealment(spark, sf).join(cells(spark, sf).select("q", "r", "highway").hint("merge"), ["q", "r"]).filter("highway IS NOT NULL")
    return c.groupBy(F.col("highway").alias("corridor")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg(F.when(~F.col("dead_ground"), 1.0).otherwise(0.0)), 6).alias("covered"))
