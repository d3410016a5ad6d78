"""Water bodies from fragments of rings, and cells under painted areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlap, rings
from ..sources import tables as t
from . import terrain
from .registry import query

# A body a customer: a diamond cut into 2 to 7 fragments, in any order and direction; every fifth lacks one.  A third have an island, a third an island that is another body's.
_N, _X0, _Y0 = "(2 + c_custkey % 6)", "(149.0e0 + (c_custkey % 97) * 0.05e0)", "(-35.0e0 + (c_custkey % 89) * 0.05e0)"
_DX, _DY = "(abs(2.0e0 - {t}) - 1.0e0)", "(CASE WHEN {t} <= 1 THEN {t} WHEN {t} <= 3 THEN 2.0e0 - {t} ELSE {t} - 4.0e0 END)"
#: x and y of the corners j / 2 of the diamond's boundary, j from 0 on.
_CORNER = {"lat": f"round({_Y0} + 0.02e0 * {_DY}, 7)", "lng": f"round({_X0} + 0.02e0 * {_DX}, 7)"}
_TURN = "((2 * j + {k}) % (2 * n) * 2.0e0 / n)"


def _corner(k: int, of: str) -> str:
    return _CORNER[of].format(t=_TURN.format(k=k))


_BODY = f"SELECT c_custkey AS relation, c_custkey, {_N} AS n FROM customer"
_REVERSED, _MISSING = "(c_custkey + j) % 2 = 1", "(c_custkey % 5 = 0 AND j = 1)"


def outer_fragments(spark, sf):
    b = t.derived(spark, sf, "customer", {"relation": "c_custkey", "c_custkey": "c_custkey", "n": _N}).withColumn("j", F.explode(F.expr("sequence(0L, n - 1)")))
    points = F.array(*(F.struct(*(F.expr(_corner(k, c)).alias(c) for c in ("lat", "lng"))) for k in range(3)))
    return b.filter(f"NOT {_MISSING}").select("relation", F.expr("CAST((j * 1 + c_custkey) % n AS INTEGER)").alias("ord"), F.when(F.expr(_REVERSED), F.reverse(points)).otherwise(points).alias("coords"))


_ISLAND = ((0.004, 0.0), (0.0, 0.004), (-0.004, 0.0), (0.0, -0.004), (0.004, 0.0))


def inner_fragments(spark, sf):
    at = lambda i, far: F.struct(F.round(F.expr(_Y0) + _ISLAND[i][1] + far, 7).alias("lat"), F.round(F.expr(_X0) + _ISLAND[i][0] + far, 7).alias("lng"))
    c = t.table(spark, sf, "customer")
    whole = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("relation"), F.lit(0).alias("ord"), F.array(*(at(i, F.lit(0.0)) for i in range(5))).alias("coords"))
    halves = c.filter("c_custkey % 3 = 1").select(F.col("c_custkey").alias("relation"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.array(*(at(i, F.lit(0.019)) for i in (0, 1, 2))).alias("coords")), F.struct(F.lit(1).alias("ord"), F.array(*(at(i, F.lit(0.019)) for i in (0, 3, 2))).alias("coords")))).alias("f"))
    return whole.unionByName(halves.select("relation", "f.ord", "f.coords"))


_POINTS = f"[{', '.join(f'struct_pack(lat := {_corner(k, chr(108) + chr(97) + chr(116))}, lng := {_corner(k, chr(108) + chr(110) + chr(103))})' for k in range(3))}]"


@query(f"""
WITH RECURSIVE frag AS MATERIALIZED (SELECT relation, CAST((j + c_custkey) % n AS INTEGER) AS ord, CASE WHEN {_REVERSED} THEN list_reverse({_POINTS}) ELSE {_POINTS} END AS p FROM (SELECT *, unnest(range(0, n)) AS j FROM ({_BODY})) WHERE NOT {_MISSING}),
tails AS (
  SELECT relation, ord AS first, [ord] AS used, p FROM (SELECT *, min(ord) OVER (PARTITION BY relation) AS least FROM frag) WHERE ord = least
  UNION ALL SELECT w.relation, first, list_append(used, f.ord), list_concat(w.p, CASE WHEN f.p[1] = w.p[-1] THEN f.p[2:] ELSE list_reverse(f.p)[2:] END) FROM tails AS w JOIN frag AS f ON f.relation = w.relation AND NOT list_contains(used, f.ord) AND (f.p[1] = w.p[-1] OR f.p[-1] = w.p[-1]) WHERE w.p[1] <> w.p[-1]),
heads AS (
  SELECT relation, first, used, p FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY len(used) DESC) AS k FROM tails) WHERE k = 1
  UNION ALL SELECT w.relation, first, list_append(used, f.ord), list_concat(CASE WHEN f.p[-1] = w.p[1] THEN f.p[:-2] ELSE list_reverse(f.p)[:-2] END, w.p) FROM heads AS w JOIN frag AS f ON f.relation = w.relation AND NOT list_contains(used, f.ord) AND (f.p[1] = w.p[1] OR f.p[-1] = w.p[1]) WHERE w.p[1] <> w.p[-1]),
ways AS (SELECT relation, first, p, p[1] = p[-1] AS closed FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY len(used) DESC) AS k FROM heads) WHERE k = 1)
SELECT relation, first, closed, CAST(len(p) AS INTEGER) AS points, round(list_sum(list_transform(p, lambda x, i: i * (x.lat + 36))), 7) AS order_sum,
       CASE WHEN closed THEN round(list_sum(list_transform(range(2, len(p) + 1), lambda i: (p[i - 1].lng - p[1].lng) * (p[i].lat - p[1].lat) - (p[i].lng - p[1].lng) * (p[i - 1].lat - p[1].lat))) / 2 * 1e6, 4) END AS area,
       CAST(CASE WHEN closed AND relation % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS holes FROM ways""")
def water_rings(spark, sf):
    """Bodies of water put together from fragments, with their islands; where a fragment is missing an open shore stays."""
    found = rings.with_holes(rings.stitch(outer_fragments(spark, sf)), rings.stitch(inner_fragments(spark, sf)), 0.05)
    order = F.aggregate(F.transform("coords", lambda p, i: (i + 1) * (p["lat"] + 36)), F.lit(0.0), lambda a, x: a + x)
    return found.select("relation", "first", "closed", F.size("coords").alias("points"), F.round(order, 7).alias("order_sum"), F.when(F.col("closed"), F.round(rings.ring_area(F.col("coords")) * 1e6, 4)).alias("area"), F.coalesce(F.size("holes"), F.lit(0)).alias("holes"))


PAINT_M = 100 / 3**0.5
_PAINTED = "(SELECT q, r FROM (SELECT q, r, painted, row_number() OVER (PARTITION BY q, r ORDER BY seq DESC) AS k FROM (SELECT event_id AS seq, event_type <> 'error' AS painted, CAST(user_id % 40 AS INTEGER) AS q, CAST(event_id % 25 AS INTEGER) AS r FROM events)) WHERE k = 1 AND painted)"
_HEX = "(SELECT q, r, x, y, s, k, x + s * cos(radians(60 * k - 30)) AS ax, y + s * sin(radians(60 * k - 30)) AS ay, x + s * cos(radians(60 * k + 30)) AS bx, y + s * sin(radians(60 * k + 30)) AS by FROM {of}, range(6) AS v(k))"
_FINE = _HEX.format(of=f"(SELECT q, r, 25.0 * (sqrt(3.0) * q + sqrt(3.0) / 2 * r) AS x, 37.5 * r AS y, 25.0 AS s FROM {terrain.CELL})")
_COARSE = _HEX.format(of=f"(SELECT q, r, {PAINT_M!r}e0 * (sqrt(3.0) * q + sqrt(3.0) / 2 * r) AS x, {PAINT_M!r}e0 * 1.5 * r AS y, {PAINT_M!r}e0 AS s FROM {_PAINTED})")


def _inside_sql(one: str, two: str) -> str:
    """For sides of the first within the second: half the cross product of what lies inside, by cutting the side's parameter at each line of the other hexagon."""
    return f"""(SELECT fq, fr, sum(CASE WHEN t1 > t0 AND in_ THEN ((ax + t0 * dx) * (ay + t1 * dy) - (ax + t1 * dx) * (ay + t0 * dy)) / 2 ELSE 0 END) AS part FROM (
  SELECT fq, fr, cq, cr, k, any_value(ax) AS ax, any_value(ay) AS ay, any_value(dx) AS dx, any_value(dy) AS dy, greatest(0, max(CASE WHEN den > 1e-9 THEN -num / den END)) AS t0, least(1, min(CASE WHEN den < -1e-9 THEN -num / den END)) AS t1, bool_and(abs(den) > 1e-9 OR num {{strict}} 0) AS in_ FROM (
    SELECT {{keys}}, e.k, e.ax - g.x AS ax, e.ay - g.y AS ay, e.bx - e.ax AS dx, e.by - e.ay AS dy, (h.bx - h.ax) * (e.by - e.ay) - (h.by - h.ay) * (e.bx - e.ax) AS den, (h.bx - h.ax) * (e.ay - h.ay) - (h.by - h.ay) * (e.ax - h.ax) AS num
    FROM {one} AS e JOIN {two} AS h ON abs(e.x - h.x) < 90 AND abs(e.y - h.y) < 90 CROSS JOIN (SELECT 0 AS x, 0 AS y) AS g) GROUP BY fq, fr, cq, cr, k) GROUP BY fq, fr)"""


@query(f"""
WITH fine AS MATERIALIZED {_FINE}, coarse AS MATERIALIZED {_COARSE},
a AS {_inside_sql("fine", "coarse").format(strict=">=", keys="e.q AS fq, e.r AS fr, h.q AS cq, h.r AS cr")}, b AS {_inside_sql("coarse", "fine").format(strict=">", keys="h.q AS fq, h.r AS fr, e.q AS cq, e.r AS cr")}
SELECT q, r, round(greatest(0, coalesce(a.part, 0) + coalesce(b.part, 0)) / (3 * sqrt(3.0) / 2 * 625), 5) AS overlap, round(greatest(0, coalesce(a.part, 0) + coalesce(b.part, 0)) / (3 * sqrt(3.0) / 2 * 625), 5) >= 0.15 AS member
FROM {terrain.CELL} AS c LEFT JOIN a ON a.fq = c.q AND a.fr = c.r LEFT JOIN b ON b.fq = c.q AND b.fr = c.r""")
def painted_members(spark, sf):
    """The share of each cell that painted hexagons of 100 m cover, and whether that makes it a member."""
    e = t.derived(spark, sf, "events", {"seq": "event_id", "painted": "event_type <> 'error'", "q": "CAST(user_id % 40 AS INTEGER)", "r": "CAST(event_id % 25 AS INTEGER)"})
    painted = e.groupBy("q", "r").agg(F.max(F.struct("seq", "painted")).alias("last")).filter("last.painted").select("q", "r")
    found = overlap.covered(terrain.cells(spark, sf).select("q", "r"), painted, 25.0, PAINT_M).withColumn("overlap", F.round("overlap", 5))
    return found.select("q", "r", "overlap", (F.col("overlap") >= overlap.MEMBER_SHARE).alias("member"))
