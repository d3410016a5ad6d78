"""Corridors over the star schema: suppliers as routes across the hex grid of parts, before and after measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import mobility as m
from ..operators import corridors as co
from ..operators import grid
from ..sources import tables as t
from . import terrain
from .registry import query

STEPS, UNIT_M = 48, 340.0
_AVENUE = "CAST(floor(s_suppkey / 4.0e0) % 3 AS INTEGER)"
_BEND = "(CASE WHEN s_suppkey % 25 = 3 THEN -14 ELSE s_suppkey % 5 - 2 END)"
_BASE = f"(2 + 16 * ({_AVENUE} + 3 * CAST(floor(s_suppkey / 100.0e0) AS INTEGER)) + s_suppkey % 4)"
#: A route a supplier, in arcs over avenues sixteen rows apart.
ROUTE = {"route": "s_suppkey", "base": _BASE, "bend": _BEND, "seconds": f"3600.0e0 + (s_suppkey * 37) % 1000 + 10.0e0 * abs({_BEND})"}
#: The same with measures: the middle avenue's movement goes to the next, the first avenue's is slower.
MEASURED = ROUTE | {"base": f"({_BASE} + CASE WHEN {_AVENUE} = 1 THEN 16 ELSE 0 END)", "seconds": f"{ROUTE['seconds']} + CASE WHEN {_AVENUE} = 0 THEN 200.0e0 ELSE 0.0e0 END"}
_STEP_R = f"CAST(base + floor(bend * i * ({STEPS} - i) / 576.0e0) AS INTEGER)"
#: When each cell is reached; not every cell is.
ARRIVAL = "(CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 50) * 30.0e0 + (p_size % 7) * 4.0e0 END)"


def routes(spark, sf, of=ROUTE):
    s = t.derived(spark, sf, "supplier", of).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    return s.select("route", "i", F.col("i").alias("q"), F.expr(_STEP_R).alias("r"), "seconds")


def _facts(spark, sf):
    """q, r, arrival, mobility (the best of a cell's ways out, for trucks), water."""
    c = terrain.cells(spark, sf)
    best = grid.edge_mobility(grid.edges(c), terrain.movers(spark).filter("mover = 'truck'")).groupBy("q", "r").agg(F.max(F.expr("CASE mobility WHEN 'unrestricted' THEN 2 WHEN 'restricted' THEN 1 ELSE 0 END")).alias("b"))
    water = (F.col("water_body") | F.col("waterway").isNotNull() | F.coalesce(F.col("frequency") >= 0.15, F.lit(False))).alias("water")
    cells = t.derived(spark, sf, "part", t.CELL | {"arrival": ARRIVAL}).select("q", "r", "arrival", water)
    return cells.join(best.hint("merge"), ["q", "r"], "left").select("q", "r", "arrival", "water", F.expr("CASE b WHEN 2 THEN 'unrestricted' WHEN 1 THEN 'restricted' END").alias("mobility"))


def _field(spark, sf, of=ROUTE):
    """(routes, clusters, cells of corridors, ranked corridors)."""
    r = routes(spark, sf, of)
    clusters = co.cluster_routes(r)
    found = co.corridor_cells(r, clusters, terrain.cells(spark, sf))
    return r, clusters, found, co.corridors(found, r, clusters)


def _summary(spark, sf, of=ROUTE):
    r, _, found, ranked = _field(spark, sf, of)
    return r, found, co.summary(ranked, co.width_slices(found, _facts(spark, sf)), UNIT_M)


_W = f"{7 * 25.0 * 3**0.5!r}e0"


def _clusters_sql(of: dict[str, str], p: str) -> str:
    """Named tables: routes, all pairs of routes that are near in three places, and least labels over them."""
    return f"""{p}routes AS MATERIALIZED (SELECT route, i, CAST(i AS INTEGER) AS q, {_STEP_R} AS r, seconds FROM {t.derived_sql("supplier", of)}, range({STEPS + 1}) AS n(i)),
{p}sample AS MATERIALIZED (SELECT route, k, 25.0 * (sqrt(3.0) * q + sqrt(3.0) / 2 * r) AS x, 37.5 * r AS y FROM {p}routes JOIN (VALUES (0, 0.25), (1, 0.5), (2, 0.75)) AS f(k, f) ON i = floor(f * {STEPS} + 0.5)),
{p}link AS MATERIALIZED (SELECT a.route AS a, b.route AS b FROM {p}sample AS a JOIN {p}sample AS b ON a.k = b.k AND a.route <> b.route AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {_W} GROUP BY ALL HAVING count(*) = 3),
{p}label(route, cluster) USING KEY (route) AS (SELECT DISTINCT route, route FROM {p}routes UNION SELECT l.b, min(x.cluster) FROM {p}label AS x JOIN {p}link AS l ON l.a = x.route JOIN recurring.{p}label AS o ON o.route = l.b GROUP BY l.b, o.cluster HAVING min(x.cluster) < o.cluster)"""


def _field_sql(of: dict[str, str], p: str = "") -> str:
    """Named tables after ``_clusters_sql``: density on every cell for every cluster, three smoothings, components, corridors."""
    smooth = lambda to, x: f"{p}{to} AS MATERIALIZED (SELECT c.cluster, c.q, c.r, 0.5 * c.v + 0.5 * coalesce(avg(b.v), c.v) AS v FROM {p}{x} AS c CROSS JOIN (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) AS o(dq, dr) LEFT JOIN {p}{x} AS b ON b.cluster = c.cluster AND b.q = c.q + o.dq AND b.r = c.r + o.dr GROUP BY c.cluster, c.q, c.r, c.v)"
    return f"""{_clusters_sql(of, p)},
{p}raw AS MATERIALIZED (SELECT cluster, q, r, sum(CASE WHEN seconds > 0 THEN greatest(0.05, (SELECT min(seconds) FROM {p}routes) / seconds) ELSE 1 END) AS v, count(*) AS routes FROM (SELECT DISTINCT route, q, r, seconds FROM {p}routes) JOIN {p}label USING (route) GROUP BY ALL),
{p}s0 AS MATERIALIZED (SELECT c.cluster, g.q, g.r, coalesce(v, 0.0) AS v FROM {terrain.CELL} AS g CROSS JOIN (SELECT DISTINCT cluster FROM {p}label) AS c LEFT JOIN {p}raw AS w ON w.cluster = c.cluster AND w.q = g.q AND w.r = g.r),
{smooth('s1', 's0')}, {smooth('s2', 's1')}, {smooth('s3', 's2')},
{p}member AS MATERIALIZED (SELECT *, v / (SELECT max(v) FROM {p}s3) AS density FROM {p}s3 WHERE round(v - 0.12 * (SELECT max(v) FROM {p}s3), 9) >= 0),
{p}side AS MATERIALIZED (SELECT a.cluster, a.q, a.r, b.q AS q2, b.r AS r2 FROM {p}member AS a CROSS JOIN (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) AS o(dq, dr) JOIN {p}member AS b ON b.cluster = a.cluster AND b.q = a.q + o.dq AND b.r = a.r + o.dr),
{p}comp(cluster, q, r, f) USING KEY (cluster, q, r) AS (SELECT cluster, q, r, r * 1000 + q FROM {p}member UNION SELECT e.cluster, e.q2, e.r2, min(x.f) FROM {p}comp AS x JOIN {p}side AS e ON e.cluster = x.cluster AND e.q = x.q AND e.r = x.r JOIN recurring.{p}comp AS o ON o.cluster = e.cluster AND o.q = e.q2 AND o.r = e.r2 GROUP BY e.cluster, e.q2, e.r2, o.f HAVING min(x.f) < o.f),
{p}inside AS MATERIALIZED (SELECT c.cluster, f, c.q, c.r, m.density, coalesce(w.routes, 0) AS routes FROM (SELECT *, count(*) OVER (PARTITION BY cluster, f) AS n FROM {p}comp) AS c JOIN {p}member AS m ON m.cluster = c.cluster AND m.q = c.q AND m.r = c.r LEFT JOIN {p}raw AS w ON w.cluster = c.cluster AND w.q = c.q AND w.r = c.r WHERE n >= 4),
{p}use AS MATERIALIZED (SELECT cluster, f, count(*) AS routes, median(seconds) AS median_s, min(seconds) AS fastest_s FROM (SELECT DISTINCT i.cluster, f, x.route, x.seconds FROM {p}inside AS i JOIN {p}routes AS x ON x.q = i.q AND x.r = i.r JOIN {p}label AS l ON l.route = x.route AND l.cluster = i.cluster) GROUP BY ALL),
{p}field AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY routes DESC, cells DESC, cluster, f) AS rank FROM (SELECT cluster, f, count(*) AS cells FROM {p}inside GROUP BY ALL) JOIN {p}use USING (cluster, f))"""


_EDGE = f"SELECT q, r, max(CASE mobility WHEN 'unrestricted' THEN 2 WHEN 'restricted' THEN 1 ELSE 0 END) AS b FROM {terrain._chain(f'(SELECT *, trail AND b_trail AS on_, false AS dark FROM {terrain._EDGES} AS e CROSS JOIN {terrain._movers_sql()} AS m)', grid.EDGE_SQL)} WHERE mover = {chr(39)}truck{chr(39)} GROUP BY q, r"


def _summary_sql(of: dict[str, str], p: str = "") -> str:
    return f"""{_field_sql(of, p)},
{p}fact AS MATERIALIZED (SELECT i.cluster, i.f, a.arrival, coalesce(b, 0) AS b, a.water FROM {p}inside AS i LEFT JOIN (SELECT q, r, arrival, water_body OR waterway IS NOT NULL OR coalesce(frequency >= 0.15, false) AS water FROM {t.derived_sql("part", t.CELL | {"arrival": ARRIVAL})}) AS a USING (q, r) LEFT JOIN ({_EDGE}) AS e USING (q, r)),
{p}slice AS MATERIALIZED (SELECT cluster, f, min(c) AS lo_c, max(c) AS hi_c FROM (SELECT cluster, f, least(17, floor((arrival - lo) / (hi - lo) * 18)) AS k, count(*) AS c FROM (SELECT *, min(arrival) OVER w AS lo, max(arrival) OVER w AS hi FROM {p}fact WINDOW w AS (PARTITION BY cluster, f)) WHERE arrival IS NOT NULL AND hi > lo GROUP BY ALL) GROUP BY cluster, f),
{p}shares AS MATERIALIZED (SELECT cluster, f, avg(CASE WHEN b = 2 THEN 1.0 ELSE 0.0 END) AS unrestricted, avg(CASE WHEN b = 1 THEN 1.0 ELSE 0.0 END) AS restricted, avg(CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END) AS severe, avg(CASE WHEN water THEN 1.0 ELSE 0.0 END) AS water FROM {p}fact GROUP BY ALL),
{p}told AS MATERIALIZED (SELECT *, bottleneck * {25.0 * 3**0.5!r} AS width_m, floor(bottleneck * {25.0 * 3**0.5!r} / {UNIT_M}) AS abreast, bottleneck / widest AS pinch, least(1.0, greatest(0.0, 0.4 * (restricted + severe) + 0.3 * water + 0.3 * (1 - bottleneck / widest))) AS risk
  FROM (SELECT g.*, coalesce(lo_c, cells) AS bottleneck, coalesce(hi_c, cells) AS widest, unrestricted, restricted, severe, water FROM {p}field AS g JOIN {p}shares USING (cluster, f) LEFT JOIN {p}slice USING (cluster, f)))"""


@query(f"WITH RECURSIVE {_clusters_sql(ROUTE, '')} SELECT route, cluster FROM label")
def route_clusters(spark, sf):
    """Routes that keep to one avenue, by where they are after a quarter, half and three quarters of their way."""
    return co.cluster_routes(routes(spark, sf))


@query(f"WITH RECURSIVE {_field_sql(ROUTE)} SELECT cluster, CAST(f % 1000 AS INTEGER) AS first_q, CAST(f // 1000 AS INTEGER) AS first_r, q, r, round(density, 6) AS density, routes FROM inside")
def corridor_cells(spark, sf):
    """Cells of corridors with their share of the densest cell's movement and the routes that pass them."""
    *_, found, _ = _field(spark, sf)
    return found.select("cluster", F.col("first.q").alias("first_q"), F.col("first.r").alias("first_r"), "q", "r", F.round("density", 6).alias("density"), "routes")


@query(f"WITH RECURSIVE {_field_sql(ROUTE)} SELECT cluster, CAST(f % 1000 AS INTEGER) AS first_q, CAST(f // 1000 AS INTEGER) AS first_r, rank, cells, routes, round(routes / (SELECT count(DISTINCT route) FROM routes), 6) AS share, median_s, fastest_s FROM field")
def corridor_field(spark, sf):
    """Corridors ranked by the routes that they carry."""
    *_, ranked = _field(spark, sf)
    return ranked.select("cluster", F.col("first.q").alias("first_q"), F.col("first.r").alias("first_r"), "rank", "cells", "routes", F.round("share", 6).alias("share"), "median_s", "fastest_s")


@query(f"""WITH RECURSIVE {_summary_sql(ROUTE)}
SELECT rank, bottleneck, widest, round(width_m, 6) AS width_m, CAST(abreast AS BIGINT) AS abreast, CASE WHEN abreast >= 3 THEN 'multi-lane' WHEN abreast = 2 THEN 'two-abreast' ELSE 'single-file' END AS frontage, round(pinch, 6) AS pinch,
       round(unrestricted, 6) AS unrestricted, round(restricted, 6) AS restricted, round(severe, 6) AS severe, round(water, 6) AS water, CASE WHEN unrestricted >= 0.6 THEN 'unrestricted' WHEN unrestricted >= 0.25 THEN 'restricted' ELSE 'severely-restricted' END AS ease, round(round(risk, 9), 6) AS risk FROM told""")
def corridor_summary(spark, sf):
    """Each corridor's narrowest cross-section by slices of arrival time, its ground and its risk."""
    *_, s = _summary(spark, sf)
    return s.select("rank", "bottleneck", "widest", F.round("width_m", 6).alias("width_m"), "abreast", "frontage", *(F.round(c, 6).alias(c) for c in ("pinch", "unrestricted", "restricted", "severe", "water")), "ease", F.round(F.round("risk", 9), 6).alias("risk"))


@query(f"""WITH RECURSIVE {_summary_sql(ROUTE)},
one AS (SELECT count(*) AS corridors, coalesce(sum(cells), 0) AS cells, count(*) > 0 AS any_, arg_min(pinch, rank) AS pinch, min(rank) AS likely, arg_min(rank, struct_pack(x := -round(risk, 9), k := rank)) AS risky FROM told)
SELECT corridors, CAST(cells AS BIGINT) AS cells, (SELECT count(*) FROM (SELECT DISTINCT q, r FROM routes)) AS routed_cells, round(cells / (SELECT count(*) FROM {terrain.CELL}), 6) AS coverage, round(pinch, 6) AS pinch, cells / (SELECT count(*) FROM {terrain.CELL}) >= 0.6 AND pinch > 0.35 AS unconstrained, likely, risky FROM one""")
def corridor_totals(spark, sf):
    """The field as a whole: cover, pinch of the busiest corridor, whether movement is unconstrained, the likeliest and the riskiest corridor."""
    r, _, s = _summary(spark, sf)
    return co.totals(s, r, terrain.cells(spark, sf)).withColumns({"coverage": F.round("coverage", 6), "pinch": F.round("pinch", 6)})


_EFFECTS = f"""WITH RECURSIVE {_summary_sql(ROUTE, "b_")}, {_summary_sql(MEASURED, "a_")},
b_key AS (SELECT rank, q, r FROM b_inside JOIN b_field USING (cluster, f)), a_key AS (SELECT rank, q, r FROM a_inside JOIN a_field USING (cluster, f)),
pair AS (SELECT b.rank, a.rank AS rank2, count(*) AS n FROM b_key AS b JOIN a_key AS a USING (q, r) GROUP BY ALL),
best AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY rank ORDER BY n DESC, rank2) = 1),
effect AS (SELECT *, CASE WHEN rank_after IS NULL THEN 'collapsed' WHEN routes_after > routes_before THEN 'displaced-into' WHEN delay_s > 60 OR width_after < 0.75 * width_before OR routes_after < routes_before THEN 'degraded' ELSE 'unchanged' END AS status FROM (
  SELECT b.rank AS rank_before, a.rank AS rank_after, coalesce(m.n / b.cells, 0) AS overlap, b.routes AS routes_before, coalesce(a.routes, 0) AS routes_after, a.median_s - b.median_s AS delay_s, b.width_m AS width_before, coalesce(a.width_m, 0) AS width_after
  FROM b_told AS b LEFT JOIN best AS m ON m.rank = b.rank LEFT JOIN a_told AS a ON a.rank = m.rank2 AND m.n / b.cells >= 0.25))"""


def _effects(spark, sf):
    _, before_cells, before = _summary(spark, sf)
    _, after_cells, after = _summary(spark, sf, MEASURED)
    return co.effects(before, before_cells, after, after_cells)


@query(f"{_EFFECTS} SELECT rank_before, rank_after, status, round(overlap, 6) AS overlap, routes_before, routes_after, round(delay_s, 6) AS delay_s, round(width_before, 6) AS width_before, round(width_after, 6) AS width_after FROM effect")
def corridor_effects(spark, sf):
    """What measures do to each corridor: it collapses, degrades, takes movement in, or stays."""
    return _effects(spark, sf).withColumns({c: F.round(c, 6) for c in ("overlap", "delay_s", "width_before", "width_after")})


@query(f"{_EFFECTS} SELECT count(*) AS corridors, count(*) FILTER (status = 'collapsed') AS collapsed, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'displaced-into') AS displaced, round((count(*) FILTER (status = 'collapsed') + 0.5 * count(*) FILTER (status = 'degraded') + 0.25 * count(*) FILTER (status = 'displaced-into')) / greatest(1, count(*)), 6) AS score FROM effect")
def corridor_impact(spark, sf):
    """The measures' impact score."""
    return co.impact(_effects(spark, sf)).withColumn("score", F.round("score", 6))
