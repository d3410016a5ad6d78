"""Least paths on foot over the grid of parts: paths, penalties, assembled results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid, paths
from . import terrain
from .registry import query

_FOOT, _TARGET = terrain._FOOT, "q % 10 = 7 AND r % 9 = 4"
_SPEED = _FOOT.replace("0.1,", "0.1e0,")


def _weights(spark, sf):
    c = terrain.cells(spark, sf)
    return c, grid.edges(c).withColumn("w", F.expr(_SPEED))


_BEFORE = f"""
{terrain._least_sql(_FOOT, terrain._EDGES, 'q = 10 AND r = 0')},
f AS MATERIALIZED (SELECT q, r, round(cost, 4) AS cost FROM b),
p AS MATERIALIZED (SELECT e.b_q AS q, e.b_r AS r, min((e.q, e.r)) AS p FROM e JOIN f AS a ON a.q = e.q AND a.r = e.r JOIN f AS z ON z.q = e.b_q AND z.r = e.b_r WHERE abs(a.cost + e.w - z.cost) < 1e-3 GROUP BY e.b_q, e.b_r),
way AS (SELECT q AS t_q, r AS t_r, q, r, 0 AS back FROM f WHERE {_TARGET} UNION ALL SELECT t_q, t_r, p.p[1], p.p[2], back + 1 FROM way JOIN p ON p.q = way.q AND p.r = way.r)"""


@query(f"{_BEFORE} SELECT t_q, t_r, max(back) OVER (PARTITION BY t_q, t_r) - back AS step, q, r FROM way")
def least_paths(spark, sf):
    """The cells of least paths on foot from cell (10, 0) to a grid of targets."""
    c, w = _weights(spark, sf)
    costs = grid.accumulated_cost(w, c.filter("q = 10 AND r = 0"))
    return paths.paths(paths.predecessors(w, costs), costs.filter(_TARGET))


_PENALTY = "CASE WHEN (q + r) % 5 = 0 THEN 6.0e0 WHEN q % 8 = 3 AND r % 7 <> 2 THEN CAST('inf' AS DOUBLE) END"


@query(f"""{terrain._least_sql(f"nullif(({_FOOT}) * coalesce({_PENALTY}, 1), CAST('inf' AS DOUBLE))", terrain._EDGES, 'q = 10 AND r = 0')} SELECT q, r, round(cost, 4) AS cost FROM b""")
def penalised_costs(spark, sf):
    """Costs where some edges take six times as long and others are closed."""
    c, w = _weights(spark, sf)
    closed = w.select("q", "r", "b_q", "b_r", F.expr(_PENALTY).alias("factor")).dropna(subset=["factor"])
    return grid.accumulated_cost(paths.penalised(w, closed), c.filter("q = 10 AND r = 0"))


_NEAR_COSTS = f"{terrain._least_sql(_FOOT, terrain._EDGES, 'q = 10 AND r = 0')}, f AS MATERIALIZED (SELECT q, r, round(cost, 4) AS cost FROM b WHERE round(cost, 4) <= 900)"
_CLASS = f"(SELECT q, r, mobility FROM ({terrain.SQL_TRAFFICABILITY}) WHERE mover = 'walker')"


@query(f"""{_NEAR_COSTS}
SELECT c.q, c.r, f.cost AS seconds, k.mobility, round(25.0 * (sqrt(3.0) * c.q + sqrt(3.0) / 2 * c.r), 4) AS x, round(37.5 * c.r, 4) AS y FROM {terrain.CELL} AS c LEFT JOIN f ON f.q = c.q AND f.r = c.r LEFT JOIN {_CLASS} AS k ON k.q = c.q AND k.r = c.r""")
def mobility_results(spark, sf):
    """Every cell with its time within a quarter of an hour, if any, its class and its place."""
    c, w = _weights(spark, sf)
    x, y = geo.hex_center(F.col("q"), F.col("r"), grid.SIZE_M)
    reach = grid.accumulated_cost(w, c.filter("q = 10 AND r = 0")).filter("cost <= 900")
    classes = grid.trafficability(c, terrain.movers(spark).filter("mover = 'walker'")).select("q", "r", "mobility")
    return paths.assembled(c.select("q", "r", F.round(x, 4).alias("x"), F.round(y, 4).alias("y")), reach, classes)


@query(f"""{_NEAR_COSTS}, g AS (SELECT c.q, c.r, f.cost, 25.0 * (sqrt(3.0) * c.q + sqrt(3.0) / 2 * c.r) AS x, 37.5 * c.r AS y FROM {terrain.CELL} AS c LEFT JOIN f ON f.q = c.q AND f.r = c.r), d AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM g)
SELECT coalesce(bool_or(y >= y1 - (y1 - y0) * 0.1), false) AS north, coalesce(bool_or(y <= y0 + (y1 - y0) * 0.1), false) AS south, coalesce(bool_or(x >= x1 - (x1 - x0) * 0.1), false) AS east, coalesce(bool_or(x <= x0 + (x1 - x0) * 0.1), false) AS west FROM g, d WHERE cost IS NOT NULL""")
def frontier_rims(spark, sf):
    """Which rims of the grid a quarter of an hour's walk has touched: there the grid would have to grow."""
    return paths.touched_rims(mobility_results(spark, sf))
