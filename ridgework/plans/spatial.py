"""Points, polygons, rasters, roads and perimeters over the star schema's keys as positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import mobility as m
from ..functions import vegetation as v
from ..operators import coordinates, incident_box, spatial
from ..sources import tables as t
from .lines import _VERT, _hav, vertices
from .registry import query

SITE = {"id": "c_custkey", "lat": "-35.0e0 + (c_custkey % 211) * 0.0007e0", "lng": "149.0e0 + (c_custkey % 307) * 0.0005e0"}
NODE = {"ord": "s_suppkey", "lat": "-35.0e0 + (s_suppkey % 37) * 0.0041e0", "lng": "149.0e0 + (s_suppkey % 29) * 0.0053e0"}
_SITES, _NODES = t.derived_sql("customer", SITE), t.derived_sql("supplier", NODE)


def sites(spark, sf):
    return t.derived(spark, sf, "customer", SITE)


def nodes(spark, sf):
    return t.derived(spark, sf, "supplier", NODE)


FAR = {"id": "c_custkey", "lat": "-45.0e0 + (c_custkey % 83) * 0.45e0", "lng": "111.0e0 + (c_custkey % 71) * 0.63e0"}


@query(f"SELECT id, CASE {' '.join(f"WHEN lat BETWEEN {a} AND {b} AND lng BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in spatial.STATES)} ELSE 'NSW' END AS state, lat BETWEEN -44.5 AND -9.0 AND lng BETWEEN 112.0 AND 154.5 AS inside FROM {t.derived_sql('customer', FAR)}")
def state_first_match(spark, sf):
    """The state of each position and whether it is in the country's box."""
    a, b, c, d = spatial.COUNTRY
    return t.derived(spark, sf, "customer", FAR).select("id", spatial.state_of(F.col("lat"), F.col("lng")).alias("state"), (F.col("lat").between(a, b) & F.col("lng").between(c, d)).alias("inside"))


#: Pentagons around nodes, every third with a hole.
_RADIUS = "(0.004e0 + (ord % 5) * 0.001e0)"
_RING = "(SELECT ord, lng + rad * cos(radians(72e0 * k)) AS x1, lat + rad * sin(radians(72e0 * k)) AS y1, lng + rad * cos(radians(72e0 * (k + 1))) AS x2, lat + rad * sin(radians(72e0 * (k + 1))) AS y2 FROM {of})"
_EDGES = "(SELECT * FROM " + _RING.format(of=f"(SELECT *, {_RADIUS} AS rad, unnest(range(5)) AS k FROM {_NODES})") + " UNION ALL SELECT * FROM " + _RING.format(of=f"(SELECT *, {_RADIUS} / 3 AS rad, unnest(range(5)) AS k FROM {_NODES} WHERE ord % 3 = 0)") + ")"


def polygons(spark, sf):
    ring = lambda rad: f"transform(sequence(0, 4), k -> named_struct('x1', lng + {rad} * cos(radians(72e0 * k)), 'y1', lat + {rad} * sin(radians(72e0 * k)), 'x2', lng + {rad} * cos(radians(72e0 * (k + 1))), 'y2', lat + {rad} * sin(radians(72e0 * (k + 1)))))"
    return nodes(spark, sf).select("ord", F.expr(f"CASE WHEN ord % 3 = 0 THEN concat({ring(_RADIUS)}, {ring(_RADIUS + ' / 3')}) ELSE {ring(_RADIUS)} END").alias("edges"))


_INSIDE = f"(SELECT id, min(ord) AS ord FROM (SELECT id, ord FROM {_SITES} CROSS JOIN {_EDGES} WHERE (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, ord HAVING count(*) % 2 = 1) GROUP BY id)"


@query(f"SELECT id, ord FROM {_INSIDE}")
def point_in_polygon(spark, sf):
    """The first polygon that holds each site."""
    return spatial.in_polygons(sites(spark, sf), polygons(spark, sf), 0.01)


#: A raster over part of the sites' box: pixels without data (-1), without a class (0), and codes.
_BOX, _W, _H = (-34.98, -34.87, 149.02, 149.14), 40, 50
_CODE = "(px * 7 + py * 13) % 35 - 1"
_PIXEL = "CASE WHEN lat BETWEEN -34.98 AND -34.87 AND lng BETWEEN 149.02 AND 149.14 THEN CAST(least(39, greatest(0, floor((lng - 149.02e0) / (149.14e0 - 149.02e0) * 40))) AS INTEGER) END AS px, CASE WHEN lat BETWEEN -34.98 AND -34.87 AND lng BETWEEN 149.02 AND 149.14 THEN CAST(least(49, greatest(0, floor((-34.87e0 - lat) / (-34.87e0 + 34.98e0) * 50))) AS INTEGER) END AS py"
_CODES = f"(SELECT *, {_CODE} AS code FROM (SELECT *, {_PIXEL} FROM {_SITES}))"


def raster(spark):
    r = spark.range(_W * _H).select((F.col("id") % _W).cast("int").alias("px"), F.floor(F.col("id") / _W).cast("int").alias("py"))
    return r.withColumn("code", F.expr(_CODE).cast("int"))


@query(f"SELECT id, CASE WHEN code <> 0 THEN CAST(code AS INTEGER) END AS code FROM {_CODES}")
def raster_lookup(spark, sf):
    """The raster's code at each site: -1 without data, null outside it or without a class."""
    return spatial.raster_codes(sites(spark, sf), raster(spark), _BOX, _W, _H).select("id", F.when(F.col("code") != 0, F.col("code")).alias("code"))


_G = "(SELECT * FROM (VALUES " + ", ".join(f"({c}, '{n}', '{k}', {x}e0)" for c, n, k, x in v.GROUPS) + ") AS v(code, name, gveg, conf))"


@query(f"""
SELECT c.id, CASE WHEN i.ord IS NOT NULL THEN 'polygon' WHEN c.code = -1 THEN 'nodata' WHEN gveg IS NOT NULL THEN 'raster' END AS source, CASE WHEN i.ord IS NOT NULL THEN CASE i.ord % 3 WHEN 0 THEN 'heavyforest' WHEN 1 THEN 'mediumscrub' ELSE 'grassland' END WHEN c.code > 0 THEN gveg END AS veg,
       CASE WHEN i.ord IS NOT NULL THEN 0.9e0 WHEN c.code > 0 THEN round(conf * 0.85e0, 6) END AS confidence FROM {_CODES} AS c LEFT JOIN {_INSIDE} AS i ON i.id = c.id LEFT JOIN {_G} AS g ON g.code = c.code""")
def veg_area(spark, sf):
    """Vegetation of each site by the first polygon, else the coarse raster (0.85 of its confidence), else nothing."""
    s = sites(spark, sf)
    g = spark.createDataFrame([(c, k, x) for c, _, k, x in v.GROUPS], "code int, gveg string, conf double")
    r = spatial.raster_codes(s, raster(spark), _BOX, _W, _H).join(spatial.in_polygons(s, polygons(spark, sf), 0.01), "id", "left").join(F.broadcast(g), "code", "left")
    own = F.expr("CASE ord % 3 WHEN 0 THEN 'heavyforest' WHEN 1 THEN 'mediumscrub' ELSE 'grassland' END")
    return r.select(
        "id", F.expr("CASE WHEN ord IS NOT NULL THEN 'polygon' WHEN code = -1 THEN 'nodata' WHEN gveg IS NOT NULL THEN 'raster' END").alias("source"),
        F.when(F.col("ord").isNotNull(), own).when(F.col("code") > 0, F.col("gveg")).alias("veg"), F.when(F.col("ord").isNotNull(), 0.9).when(F.col("code") > 0, F.round(F.col("conf") * 0.85, 6)).alias("confidence"),
    )


_WITHIN = f"(SELECT id, ord, d FROM (SELECT s.id, n.ord, {_hav('s.lat', 's.lng', 'n.lat', 'n.lng')} AS d FROM {_SITES} AS s CROSS JOIN {_NODES} AS n) WHERE d <= 1500)"


@query(f"SELECT id, ord, round(d, 3) AS dist_m FROM {_WITHIN}")
def radius_nodes(spark, sf):
    """Nodes within 1500 m of each site."""
    return spatial.within(sites(spark, sf), nodes(spark, sf), 1500.0).select("id", "ord", F.round("dist_m", 3).alias("dist_m"))


@query(f"SELECT id, ord, round(d, 3) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ord DESC) AS rn FROM {_WITHIN}) WHERE rn = 1")
def nearest_node(spark, sf):
    """The nearest node within 1500 m."""
    return spatial.nearest(sites(spark, sf), nodes(spark, sf), 1500.0).select("id", "ord", F.round("dist_m", 3).alias("dist_m"))


_STEPS = f"(SELECT a.lng AS x1, a.lat AS y1, b.lng AS x2, b.lat AS y2 FROM {_NODES} AS a JOIN {_NODES} AS b ON b.ord = a.ord + 1 WHERE a.ord % 10 <> 9)"
_K = "(111320.0 * cos(radians(lat)))"


@query(f"""
SELECT id, round(min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2))), 3) AS dist_m FROM (
  SELECT *, greatest(0, least(1, coalesce(-(ax * (bx - ax) + ay * (by_ - ay)) / nullif(pow(bx - ax, 2) + pow(by_ - ay, 2), 0), 0))) AS t FROM (
    SELECT id, (x1 - lng) * {_K} AS ax, (y1 - lat) * 111320.0 AS ay, (x2 - lng) * {_K} AS bx, (y2 - lat) * 111320.0 AS by_ FROM {_SITES} CROSS JOIN {_STEPS}))
GROUP BY id HAVING min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2))) <= 400""")
def nearest_trail(spark, sf):
    """Metres to the nearest trail within 400 m."""
    n = nodes(spark, sf)
    b = n.select((F.col("ord") - 1).alias("ord"), F.col("lng").alias("x2"), F.col("lat").alias("y2"))
    steps = n.filter("ord % 10 <> 9").select("ord", F.col("lng").alias("x1"), F.col("lat").alias("y1")).join(b, "ord").drop("ord")
    return spatial.nearest_line(sites(spark, sf), steps, 400.0).select("id", F.round("dist_m", 3).alias("dist_m"))


#: Keys of road nodes have six decimals.
_KEY = "concat(format('{{:.6f}}', {lat}), ',', format('{{:.6f}}', {lng}))"
_WET = f"(SELECT *, {_KEY.format(lat='y0', lng='x0')} AS a, {_KEY.format(lat='lat', lng='lng')} AS b, plan % 4 = 0 AND (CAST(round((lat + 35) * 10000) AS BIGINT) + seq) % 3 <> 0 AS wet FROM {_VERT} WHERE seq > 0)"
_RUNS = f"(SELECT *, sum(CASE WHEN wet THEN 0 ELSE 1 END) OVER (PARTITION BY plan ORDER BY seq) AS run FROM {_WET} WHERE a <> b)"
_ROADS = f"(SELECT *, wet AND sum(CASE WHEN wet THEN d ELSE 0 END) OVER (PARTITION BY plan, run) > 250 AS standing_water FROM {_RUNS})"


@query(f"SELECT plan AS way, CAST(seq AS INTEGER) AS seq, a AS from_node, b AS to_node, round(d, 3) AS dist_m, standing_water FROM {_ROADS} UNION ALL SELECT plan, CAST(seq AS INTEGER), b, a, round(d, 3), standing_water FROM {_ROADS}")
def road_edges(spark, sf):
    """Edges of ways in both directions; a stretch in standing water longer than a bridge of 250 m is marked."""
    return roads(spark, sf).select("way", "seq", "from_node", "to_node", F.round("dist_m", 3).alias("dist_m"), "standing_water")


def roads(spark, sf):
    w = Window.partitionBy("plan").orderBy("seq")
    key = lambda a, b: F.format_string("%.6f,%.6f", F.col(a), F.col(b))
    r = vertices(spark, sf).filter("seq > 0").select("plan", "seq", key("_lat", "_lng").alias("a"), key("lat", "lng").alias("b"), "dist_m", F.expr("plan % 4 = 0 AND (CAST(round((lat + 35) * 10000) AS BIGINT) + seq) % 3 <> 0").alias("wet")).filter("a <> b")
    r = r.withColumn("_run", F.sum((~F.col("wet")).cast("int")).over(w))
    r = r.withColumn("standing_water", F.col("wet") & (F.sum(F.when(F.col("wet"), F.col("dist_m")).otherwise(0.0)).over(Window.partitionBy("plan", "_run")) > 250))
    both = r.withColumn("_ends", F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("b").alias("t")), F.struct(F.col("b").alias("f"), F.col("a").alias("t")))))
    return both.select(F.col("plan").alias("way"), "seq", F.col("_ends.f").alias("from_node"), F.col("_ends.t").alias("to_node"), "dist_m", "standing_water")


#: Tags of a way.
TAGS = {
    "highway": "(CASE way % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'track' WHEN 3 THEN 'path' WHEN 4 THEN 'service' END)", "surface": "(CASE way % 7 WHEN 0 THEN 'gravel' WHEN 1 THEN 'mud' WHEN 2 THEN 'asphalt' END)",
    "tracktype": "(CASE WHEN way % 5 = 0 THEN 'grade2' END)", "smoothness": "(CASE way % 9 WHEN 0 THEN 'bad' WHEN 1 THEN 'impassable' END)",
}
_TIME = {
    "ceiling": f"(CASE WHEN model = 'vehicle' THEN {m.ceiling_sql('highway', 'surface', 'tracktype', 'smoothness')} END)", "kmh": "least(road_kmh, coalesce(ceiling, road_kmh))",
    "blocked": "((standing_water AND NOT coalesce(ford >= 2.5e0, false)) OR kmh <= 0)",
    "basis": f"(CASE WHEN model <> 'vehicle' OR ceiling IS NULL OR (standing_water AND NOT coalesce(ford >= 2.5e0, false)) THEN 'vehicle-capability-only' WHEN coalesce({m.case('highway', m.HIGHWAY)}, {m.case('surface', m.SURFACE)}, {m.case('tracktype', m.TRACKTYPE)}, {m.case('smoothness', m.SMOOTHNESS)}) IS NOT NULL THEN 'published' ELSE 'estimated' END)",
}


def _road_sql() -> str:
    from .terrain import _chain, _movers_sql

    way = f"(SELECT plan AS way, CAST(seq AS INTEGER) AS seq, d, standing_water FROM {_ROADS})"
    of = f"(SELECT w.*, m.*, {', '.join(f'{e} AS {k}' for k, e in TAGS.items())} FROM {way} AS w CROSS JOIN {_movers_sql()} AS m)"
    return f"SELECT way, seq, mover, CASE WHEN NOT blocked THEN round(d / (kmh * 1000 / 3600), 4) END AS seconds, blocked, basis FROM {_chain(of, _TIME)}"


@query(_road_sql())
def road_times(spark, sf):
    """Seconds of each mover along each step of a way: vehicles by the way's class, standing water blocks."""
    r = roads(spark, sf).dropDuplicates(["way", "seq"]).select("way", "seq", "dist_m", "standing_water", *(F.expr(e).alias(k) for k, e in TAGS.items()))
    r = r.crossJoin(F.broadcast(spark.createDataFrame(list(m.MOVERS), m.MOVER_COLUMNS)))
    for name, sql in _TIME.items():
        r = r.withColumn(name, F.expr(sql))
    return r.select("way", "seq", "mover", F.expr("CASE WHEN NOT blocked THEN round(dist_m / (kmh * 1000 / 3600), 4) END").alias("seconds"), "blocked", "basis")


PERIMETER = {"fire": "s_nationkey", "id": "s_suppkey", "lat": "-35.0e0 + s_nationkey * 0.1e0 + (s_suppkey % 37) * 0.0041e0", "lng": "149.0e0 + (s_suppkey % 29) * 0.0053e0"}
_PER = t.derived_sql("supplier", PERIMETER)
_BRG = "degrees(atan2(sin(radians(lng - c_lng)) * cos(radians(lat)), cos(radians(c_lat)) * sin(radians(lat)) - sin(radians(c_lat)) * cos(radians(lat)) * cos(radians(lng - c_lng))))"
_SECT = f"""(SELECT *, CASE WHEN abs(angle) <= 30 THEN 'head' WHEN abs(angle) >= 150 THEN 'rear' WHEN angle > 0 THEN 'rightFlank' ELSE 'leftFlank' END AS sector FROM (
  SELECT *, CASE WHEN d < -180 THEN d + 360 ELSE d END AS angle FROM (SELECT *, fmod(bearing - fmod(((fire * 37) % 360) + 180.0e0, 360e0) + 180, 360e0) - 180 AS d FROM (
    SELECT p.*, fmod({_BRG} + 360, 360e0) AS bearing FROM {_PER} AS p JOIN (SELECT fire, avg(lat) AS c_lat, avg(lng) AS c_lng FROM {_PER} GROUP BY fire) USING (fire)))))"""
METRES = {"head": 900.0, "rightFlank": 400.0, "leftFlank": 350.0, "rear": 100.0}


def _sectors(spark, sf):
    wind = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("fire"), ((F.col("n_nationkey") * 37) % 360).cast("double").alias("from_deg"))
    return spatial.sectors(t.derived(spark, sf, "supplier", PERIMETER), wind)


@query(f"SELECT fire, id, round(bearing, 5) AS bearing, round(angle, 5) AS angle, sector FROM {_SECT}")
def incident_sectors(spark, sf):
    """Sector of each vertex of fires' perimeters under their winds."""
    return _sectors(spark, sf).select("fire", "id", F.round("bearing", 5).alias("bearing"), F.round("angle", 5).alias("angle"), "sector")


_OFF = f"(CASE sector {' '.join(f"WHEN '{k}' THEN {x}e0" for k, x in METRES.items())} END / 6371000.0)"
_TO = f"asin(sin(radians(lat)) * cos({_OFF}) + cos(radians(lat)) * sin({_OFF}) * cos(radians(bearing)))"


@query(f"SELECT fire, id, sector, round(degrees({_TO}), 6) AS lat, round(lng + degrees(atan2(sin(radians(bearing)) * sin({_OFF}) * cos(radians(lat)), cos({_OFF}) - sin(radians(lat)) * sin({_TO}))), 6) AS lng FROM {_SECT}")
def incident_offset(spark, sf):
    """Vertices moved outwards by sector."""
    return spatial.offset(_sectors(spark, sf), METRES).select("fire", "id", "sector", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(f"SELECT ord, round({_hav('lat', 'lng', '-34.93e0', '149.07e0')}, 3) AS dist_m FROM {_NODES}")
def haversine_pairs(spark, sf):
    """Metres of each node from one position."""
    return nodes(spark, sf).select("ord", F.round(geo.haversine_m(F.col("lat"), F.col("lng"), F.lit(-34.93), F.lit(149.07)), 3).alias("dist_m"))


_FIRES = {"fire": "n_nationkey", "head": "20.0e0 + (n_nationkey * 131) % 900", "flank": "CASE WHEN n_nationkey % 3 <> 0 THEN 10.0e0 + (n_nationkey * 71) % 300 END", "rear": "CASE WHEN n_nationkey % 2 = 0 THEN 5.0e0 + n_nationkey % 40 END", "pace": "400.0e0 + (n_nationkey % 7) * 300.0e0"}


def _fixed_point_sql() -> str:
    """Three rounds, each: vertices moved out, the line's length from vertex to vertex, hours, the next distance."""
    to = "asin(sin(radians(lat)) * cos(d / 6371000.0) + cos(radians(lat)) * sin(d / 6371000.0) * cos(radians(bearing)))"
    parts = [
        f"v AS MATERIALIZED (SELECT fire, id, lat, lng, bearing, sector, array_position(['head', 'leftFlank', 'rightFlank', 'rear'], sector) AS p, count(*) OVER (PARTITION BY fire, sector) AS n FROM {_SECT})",
        f"f AS MATERIALIZED (SELECT * FROM {t.derived_sql('nation', _FIRES)})",
        "near AS (SELECT s.fire, s.sector, arg_min(o.lat, (o.p, o.id)) AS lat, arg_min(o.lng, (o.p, o.id)) AS lng FROM (SELECT DISTINCT fire, sector FROM v WHERE n = 1) AS s JOIN v AS o ON o.fire = s.fire AND o.sector <> s.sector GROUP BY ALL)",
        "s0 AS MATERIALIZED (SELECT DISTINCT fire, sector, n, CASE sector WHEN 'head' THEN head WHEN 'rear' THEN coalesce(rear, head) ELSE coalesce(flank, head) END AS ros, pace, 100.0 AS d, CAST(NULL AS DOUBLE) AS h, false AS ok, false AS done FROM v JOIN f USING (fire))",
    ]
    for i in range(3):
        parts.append(
            f"""m{i} AS MATERIALIZED (SELECT fire, sector, sum({_hav("lat", "lng", "plat", "plng")}) AS m, count(*) AS k FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM (
  SELECT fire, sector, id, degrees({to}) AS lat, lng + degrees(atan2(sin(radians(bearing)) * sin(d / 6371000.0) * cos(radians(lat)), cos(d / 6371000.0) - sin(radians(lat)) * sin({to}))) AS lng FROM v JOIN s{i} USING (fire, sector)
  UNION ALL SELECT fire, sector, 1000000000, lat, lng FROM near) WINDOW w AS (PARTITION BY fire, sector ORDER BY id)) GROUP BY fire, sector),
t{i} AS MATERIALIZED (SELECT s.*, CASE WHEN k < 2 THEN NULL WHEN m < 1 THEN 0 ELSE m / pace END AS hh FROM s{i} AS s JOIN m{i} USING (fire, sector)),
s{i + 1} AS MATERIALIZED (SELECT fire, sector, n, ros, pace, CASE WHEN done OR hh IS NULL THEN d ELSE least(5000, greatest(30, ros * hh)) END AS d, CASE WHEN done THEN h ELSE hh END AS h,
  CASE WHEN done THEN ok WHEN hh IS NULL THEN false ELSE abs(least(5000, greatest(30, ros * hh)) - d) <= 15 END AS ok, CASE WHEN done OR hh IS NULL THEN true ELSE abs(least(5000, greatest(30, ros * hh)) - d) <= 15 END AS done FROM t{i})"""
        )
    return ", ".join(parts)


@query(f"WITH {_fixed_point_sql()} SELECT fire, sector, round(ros, 4) AS ros, round(d, 4) AS distance_m, round(h, 6) AS hours, ok AS converged, CAST(n AS INTEGER) AS vertices FROM s3")
def incident_standoff(spark, sf):
    """How far each sector of a fire's box stands off, by iteration, and whether that has settled."""
    d = incident_box.stand_off(_sectors(spark, sf), t.derived(spark, sf, "nation", _FIRES))
    return d.select("fire", "sector", F.round("ros", 4).alias("ros"), F.round("distance_m", 4).alias("distance_m"), F.round("hours", 6).alias("hours"), "converged", "vertices")


_BOX_TO = "asin(sin(radians(lat)) * cos(d / 6371000.0) + cos(radians(lat)) * sin(d / 6371000.0) * cos(radians(bearing)))"


@query(f"""WITH {_fixed_point_sql()},
b AS (SELECT fire, row_number() OVER (PARTITION BY fire ORDER BY id) - 1 AS place, degrees({_BOX_TO}) AS lat, lng + degrees(atan2(sin(radians(bearing)) * sin(d / 6371000.0) * cos(radians(lat)), cos(d / 6371000.0) - sin(radians(lat)) * sin({_BOX_TO}))) AS lng FROM v JOIN s3 USING (fire, sector))
SELECT fire, CAST(place AS INTEGER) AS place, round(lat, 6) AS lat, round(lng, 6) AS lng FROM b UNION ALL SELECT fire, CAST(n AS INTEGER), round(lat, 6), round(lng, 6) FROM b JOIN (SELECT fire, count(*) AS n FROM b GROUP BY fire) USING (fire) WHERE place = 0""")
def incident_ring(spark, sf):
    """The closed ring of each fire's box."""
    v = _sectors(spark, sf)
    d = incident_box.stand_off(v, t.derived(spark, sf, "nation", _FIRES))
    return incident_box.box(v, d).select("fire", "place", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_PLACES = {"id": "c_custkey", "lat": "-43.5e0 + (c_custkey * 7919 % 33000) * 0.001e0", "lng": "114.0e0 + (c_custkey * 104729 % 40000) * 0.001e0"}


def _utm_sql() -> str:
    k = f"{2 * coordinates._N**0.5 / (1 + coordinates._N)!r}e0"
    series = lambda of, c, g, h: " + ".join(f"{a!r} * {g}({2 * j} * {of[0]}) * {h}({2 * j} * {of[1]})" if "e" in repr(a) else f"{a!r}e0 * {g}({2 * j} * {of[0]}) * {h}({2 * j} * {of[1]})" for j, a in enumerate(c, 1))
    r = f"{coordinates.SCALE * coordinates._RADIUS!r}e0"
    return f"""SELECT id, zone, 500000 + {r} * (y + {series(('x', 'y'), coordinates.ALPHA, 'cos', 'sinh')}) AS easting, 10000000 + {r} * (x + {series(('x', 'y'), coordinates.ALPHA, 'sin', 'cosh')}) AS northing, lat, lng
  FROM (SELECT *, atan2(t, cos(lam)) AS x, atanh(sin(lam) / sqrt(1 + t * t)) AS y FROM (SELECT *, sinh(atanh(sin(radians(lat))) - {k} * atanh({k} * sin(radians(lat)))) AS t, radians(lng - (zone * 6.0 - 183.0)) AS lam FROM (
    SELECT *, CAST(floor((lng + 180) / 6) + 1 AS INTEGER) AS zone FROM {t.derived_sql('customer', _PLACES)})))"""


@query(f"SELECT id, zone, round(easting, 4) AS easting, round(northing, 4) AS northing, round(lat, 8) AS lat, round(lng, 8) AS lng FROM ({_utm_sql()})")
def utm_roundtrip(spark, sf):
    """Zone coordinates of places, and the places that come back from them."""
    p = t.derived(spark, sf, "customer", _PLACES).withColumn("zone", coordinates.zone_of(F.col("lng")))
    e, n = coordinates.to_utm(F.col("lat"), F.col("lng"), F.col("zone"))
    p = p.select("id", "zone", e.alias("easting"), n.alias("northing"))
    lat, lng = coordinates.from_utm(F.col("easting"), F.col("northing"), F.col("zone"), F.lit(True))
    return p.select("id", "zone", F.round("easting", 4).alias("easting"), F.round("northing", 4).alias("northing"), F.round(lat, 8).alias("lat"), F.round(lng, 8).alias("lng"))


_REF = "CASE c_custkey % 5 WHEN 0 THEN concat(CAST(100 + c_custkey % 900 AS {s}), ' ', CAST(200 + c_custkey % 700 AS {s})) WHEN 1 THEN concat('GR ', CAST(1000 + c_custkey % 9000 AS {s}), '-', CAST(2000 + c_custkey % 7000 AS {s})) WHEN 2 THEN CAST(100000 + c_custkey AS {s}) WHEN 3 THEN CAST(c_custkey AS {s}) ELSE 'none' END"


@query(f"SELECT id, CASE WHEN len(d) IN (6, 8) THEN d[: len(d) // 2] END AS easting, CASE WHEN len(d) IN (6, 8) THEN d[len(d) // 2 + 1 :] END AS northing FROM (SELECT c_custkey AS id, regexp_replace({_REF.format(s='VARCHAR')}, '[^0-9]', '', 'g') AS d FROM customer)")
def grid_reference_digits(spark, sf):
    """Easting and northing digits of grid references as people write them."""
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), coordinates.grid_digits(F.expr(_REF.format(s="STRING"))).alias("g"))
    return c.select("id", "g.easting", "g.northing")
