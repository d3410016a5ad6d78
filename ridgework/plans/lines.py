"""Linear referencing, slopes along lines, runs, overlays and overrides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import production as p
from ..operators import linear, overrides, simplify
from ..sources import tables as t
from ..sources.shared import dealt
from .equipment import SEG, segments
from .registry import query

POINT = t.derived_sql("lineitem", t.POINT)
_ORD = ", ".join(linear.ORDER)
_CHAIN = f"(SELECT *, row_number() OVER (PARTITION BY plan ORDER BY {_ORD}) AS seg_no, sum(len) OVER (PARTITION BY plan ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING) AS end_m FROM {SEG})"
_C = p.slope_class_sql("slope")
_CLASSED = f"(SELECT *, {_C} AS slope_class FROM {SEG})"


def vertices(spark, sf):
    return linear.vertices(t.derived(spark, sf, "lineitem", t.POINT))


def classed(spark, sf):
    return segments(spark, sf).withColumn("slope_class", F.expr(_C))


def _hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def _mock(lat: str, lng: str) -> str:
    return f"greatest(0.0, 100 + sin(0.07 * ({lat})) * 120 + cos(0.05 * ({lng})) * 80)"


_V0 = f"(SELECT plan, lat, lng, row_number() OVER w - 1 AS seq, lag(lat) OVER w AS y0, lag(lng) OVER w AS x0 FROM {POINT} WINDOW w AS (PARTITION BY plan ORDER BY {_ORD}))"
_V1 = f"(SELECT *, coalesce({_hav('y0', 'x0', 'lat', 'lng')}, 0) AS d FROM {_V0})"
_VERT = f"(SELECT *, sum(d) OVER w AS cum, sum(d) OVER (PARTITION BY plan) AS total, count(*) OVER (PARTITION BY plan) - 1 AS n FROM {_V1} WINDOW w AS (PARTITION BY plan ORDER BY seq ROWS UNBOUNDED PRECEDING))"


@query(f"SELECT plan, seg_no, round(end_m - len, 3) AS start_m, round(end_m, 3) AS end_m FROM {_CHAIN}")
def chainage(spark, sf):
    return linear.chainage(segments(spark, sf)).select("plan", F.col("seg_no").cast("long").alias("seg_no"), F.round("start_m", 3).alias("start_m"), F.round("end_m", 3).alias("end_m"))


def _runs_sql(by: str, of: str = SEG) -> str:
    return f"""
SELECT plan, run_no, {by}, round(min(end_m - len), 3) AS start_m, round(max(end_m), 3) AS end_m, count(*) AS segments, round(max(slope), 6) AS max_slope
FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY plan ORDER BY seg_no) AS BIGINT) AS run_no FROM (
  SELECT *, CASE WHEN lag({by}) OVER (PARTITION BY plan ORDER BY seg_no) IS NOT DISTINCT FROM {by} THEN 0 ELSE 1 END AS new FROM {_CHAIN.replace(SEG, of)})) GROUP BY plan, run_no, {by}"""


@query(_runs_sql("veg"))
def rle_vegetation(spark, sf):
    return linear.runs(segments(spark, sf), "veg")


@query(_runs_sql("slope_class", _CLASSED))
def rle_slope(spark, sf):
    return linear.runs(classed(spark, sf), "slope_class")


@query(f"""
SELECT plan, slope_class, rank, start_m, end_m, max_slope FROM (
  SELECT *, row_number() OVER (PARTITION BY plan, slope_class ORDER BY end_m - start_m DESC, start_m) AS rank FROM ({_runs_sql("slope_class", _CLASSED)}) WHERE slope_class IN ('steep', 'very_steep')) WHERE rank <= 3""")
def steep_runs_top3(spark, sf):
    """The three longest steep runs of each plan and the three longest very steep ones: the report is the feature."""
    steep = rle_slope(spark, sf).filter("slope_class IN ('steep', 'very_steep')")
    rank = F.row_number().over(Window.partitionBy("plan", "slope_class").orderBy((F.col("end_m") - F.col("start_m")).desc(), "start_m"))
    return steep.withColumn("rank", rank.cast("long")).filter("rank <= 3").select("plan", "slope_class", "rank", "start_m", "end_m", "max_slope")


@query(f"""
SELECT plan, rank, start_m, end_m FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY end_m - start_m DESC, start_m) AS rank FROM ({_runs_sql("veg")}) WHERE veg = 'heavyforest' AND end_m - start_m >= 150) WHERE rank <= 3""")
def heavy_runs_top3(spark, sf):
    """The three longest runs of heavy forest of 150 m or more."""
    rank = F.row_number().over(Window.partitionBy("plan").orderBy((F.col("end_m") - F.col("start_m")).desc(), "start_m"))
    return rle_vegetation(spark, sf).filter("veg = 'heavyforest' AND end_m - start_m >= 150").withColumn("rank", rank.cast("long")).filter("rank <= 3").select("plan", "rank", "start_m", "end_m")


@query(f"""
SELECT slope_class, veg, round(sum(least(a.end_m, b.end_m) - greatest(a.start_m, b.start_m)), 2) AS overlap_m, count(*) AS pieces
FROM ({_runs_sql("slope_class", _CLASSED)}) AS a JOIN ({_runs_sql("veg")}) AS b USING (plan)
WHERE least(a.end_m, b.end_m) > greatest(a.start_m, b.start_m) GROUP BY slope_class, veg""")
def overlap_matrix(spark, sf):
    """Length by slope class and vegetation."""
    return linear.overlap_matrix(classed(spark, sf), "slope_class", "veg")


@query(f"""
SELECT plan, veg, round(m, 3) AS length_m, round(m / total, 6) AS share FROM (
  SELECT *, sum(m) OVER (PARTITION BY plan) AS total, row_number() OVER (PARTITION BY plan ORDER BY m DESC, first) AS rn
  FROM (SELECT plan, veg, sum(len) AS m, min(seg_no) AS first FROM {_CHAIN} GROUP BY plan, veg)) WHERE rn = 1""")
def predominant_veg(spark, sf):
    """The vegetation with most length on each plan; of equal ones, the first met."""
    w = Window.partitionBy("plan")
    s = linear.chainage(segments(spark, sf)).groupBy("plan", "veg").agg(F.sum("len").alias("m"), F.min("seg_no").alias("first"))
    s = s.withColumn("total", F.sum("m").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("m").desc(), "first")))
    return s.filter("rn = 1").select("plan", "veg", F.round("m", 3).alias("length_m"), F.round(F.col("m") / F.col("total"), 6).alias("share"))


_VEG4 = ("grassland", "lightshrub", "mediumscrub", "heavyforest")


@query(f"SELECT plan, {', '.join(f"round(sum(CASE WHEN veg = '{v}' THEN len ELSE 0 END), 3) AS {v}_m" for v in _VEG4)}, round(avg(conf), 6) AS confidence, bool_or(conf < 0.6) AS estimated FROM {SEG} GROUP BY plan")
def veg_distribution(spark, sf):
    """Metres by vegetation of each plan, the plain (not weighted) mean confidence, and whether any segment is an estimate."""
    by = [F.round(F.sum(F.when(F.col("veg") == v, F.col("len")).otherwise(0.0)), 3).alias(f"{v}_m") for v in _VEG4]
    return segments(spark, sf).groupBy("plan").agg(*by, F.round(F.avg("conf"), 6).alias("confidence"), F.bool_or(F.col("conf") < 0.6).alias("estimated"))


@query(f"""
SELECT plan, CAST(count(*) AS BIGINT) AS steps, round(sum(d), 3) AS length_m, round(max(CASE WHEN d = 0 THEN 0.0 ELSE degrees(atan(abs({_mock("lat", "lng")} - {_mock("y0", "x0")}) / d)) END), 6) AS max_slope, true AS estimated
FROM {_VERT} WHERE seq > 0 GROUP BY plan""")
def haversine_len(spark, sf):
    """Length and largest slope of lines on the stand-in terrain; the flag says that it is an estimate."""
    s = linear.track_slopes(t.derived(spark, sf, "lineitem", t.POINT))
    return s.groupBy("plan").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("dist_m"), 3).alias("length_m"), F.round(F.max("slope"), 6).alias("max_slope"), F.bool_or("estimated").alias("estimated"))


@query(f"SELECT plan, count(*) AS vertices, count(*) <= 6 AS accepted FROM {POINT} GROUP BY plan")
def vertex_guard(spark, sf):
    """Whether a line has few enough vertices; 6 here, so that some haven't."""
    return linear.guard(t.derived(spark, sf, "lineitem", t.POINT), 6)


def _at_sql(m: str, k: str = "0") -> str:
    """plan, lat, lng at chainage m, an expression of plan and total."""
    return f"""
SELECT plan, {k} AS k, CASE WHEN seq = 0 THEN lat ELSE y0 + (lat - y0) * f END AS lat, CASE WHEN seq = 0 THEN lng ELSE x0 + (lng - x0) * f END AS lng FROM (
  SELECT *, CASE WHEN d > 0 THEN (m - (cum - d)) / d ELSE 0 END AS f, row_number() OVER (PARTITION BY plan ORDER BY seq) AS rn
  FROM (SELECT *, greatest(0.0, least({m}, total)) AS m FROM {_VERT}) WHERE (seq > 0 AND (cum >= m OR seq = n)) OR n = 0) WHERE rn = 1"""


@query(f"SELECT plan, round(lat, 6) AS lat, round(lng, 6) AS lng FROM ({_at_sql('(plan % 13) * 150.0 - 100.0')})")
def point_at_chainage(spark, sf):
    """The position at some chainage of each line, before its start and beyond its end too."""
    return linear.points_at(vertices(spark, sf), F.array(F.expr("(plan % 13) * 150.0e0 - 100.0e0"))).select("plan", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_A, _B = "greatest(0.0, least((plan % 5) * 200.0, (plan % 7) * 250.0, total))", "least(total, greatest((plan % 5) * 200.0, (plan % 7) * 250.0, 0.0))"


@query(f"""
SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY ord) AS INTEGER) AS place, round(lat, 6) AS lat, round(lng, 6) AS lng FROM (
  SELECT plan, seq + 1 AS ord, lat, lng FROM {_VERT} WHERE total > 0 AND cum > {_A} AND cum < {_B}
  UNION ALL SELECT plan, 0, lat, lng FROM ({_at_sql(_A)})
  UNION ALL SELECT plan, 1000000000, lat, lng FROM ({_at_sql(_B)}) WHERE plan IN (SELECT plan FROM {_VERT} WHERE {_B} > {_A}))""")
def slice_chainage(spark, sf):
    """The part of each line between two chainages, in whichever order they are given."""
    s = linear.slices(vertices(spark, sf), F.expr("(plan % 5) * 200.0e0"), F.expr("(plan % 7) * 250.0e0"))
    return s.select("plan", F.row_number().over(Window.partitionBy("plan").orderBy("seq")).alias("place"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_FIRST = "(100.0 - fmod(cum - d, 100.0))"
_DENSE = f"""(
  SELECT plan, seq, 0 AS j, lat, lng FROM {_VERT} WHERE seq = 0 OR d > 0.001
  UNION ALL SELECT plan, seq - 1 AS seq, j, y0 + (lat - y0) * a / d, x0 + (lng - x0) * a / d FROM (
    SELECT *, {_FIRST} + (j - 1) * 100.0 AS a FROM (SELECT *, unnest(range(1, 2 + CAST(greatest(0, ceil((d - {_FIRST}) / 100.0)) AS BIGINT))) AS j FROM {_VERT} WHERE seq > 0 AND d > {_FIRST}))
  WHERE a > 0.001 AND d - a > 0.001)"""


@query(f"SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY seq, j) AS INTEGER) AS place, round(lat, 6) AS lat, round(lng, 6) AS lng FROM {_DENSE}")
def densify_100m(spark, sf):
    """Lines with a point every 100 m of the running distance; all vertices stay."""
    w = Window.partitionBy("plan").orderBy("seq", "j")
    return linear.densify(vertices(spark, sf)).select("plan", F.row_number().over(w).alias("place"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def _dest(lat: str, lng: str, bearing: str) -> tuple[str, str]:
    to = f"asin(sin(radians({lat})) * cos(15.0 / 6371000) + cos(radians({lat})) * sin(15.0 / 6371000) * cos(radians({bearing})))"
    return f"degrees({to})", f"({lng} + degrees(atan2(sin(radians({bearing})) * sin(15.0 / 6371000) * cos(radians({lat})), cos(15.0 / 6371000) - sin(radians({lat})) * sin({to}))))"


def _probe(lat: str, lng: str) -> str:
    left, right = _dest(lat, lng, "(brg - 90)"), _dest(lat, lng, "(brg + 90)")
    return f"degrees(atan(abs({_mock(*right)} - {_mock(*left)}) / 30.0))"


_PIECES = f"""(
  SELECT plan, piece, m, coalesce(s / nullif(t, 0), 0) AS slope, {p.slope_class_sql("round(top, 9)")} AS category, cross_slope FROM (
    SELECT plan, piece, any_value(m) AS m, any_value(cross_slope) AS cross_slope, sum(sd) AS t, sum(sd * ss) AS s, max(ss) AS top FROM (
      SELECT *, CASE WHEN sd = 0 THEN 0 ELSE degrees(atan(abs({_mock("yb", "xb")} - {_mock("ya", "xa")}) / sd)) END AS ss FROM (
        SELECT *, {_hav("ya", "xa", "yb", "xb")} AS sd FROM (
          SELECT *, y0 + (y1 - y0) * (k - 1) / n AS ya, x0 + (x1 - x0) * (k - 1) / n AS xa, y0 + (y1 - y0) * k / n AS yb, x0 + (x1 - x0) * k / n AS xb FROM (
            SELECT *, unnest(range(1, n + 1)) AS k FROM (
              SELECT *, CAST(greatest(1, ceil(m / 10.0)) AS BIGINT) AS n, greatest({_probe("y0", "x0")}, {_probe("((y0 + y1) / 2)", "((x0 + x1) / 2)")}, {_probe("y1", "x1")}) AS cross_slope FROM (
                SELECT *, {_hav("y0", "x0", "y1", "x1")} AS m, degrees(atan2(sin(radians(x1 - x0)) * cos(radians(y1)), cos(radians(y0)) * sin(radians(y1)) - sin(radians(y0)) * cos(radians(y1)) * cos(radians(x1 - x0)))) AS brg
                FROM (SELECT plan, row_number() OVER w - 1 AS piece, lag(lat) OVER w AS y0, lag(lng) OVER w AS x0, lat AS y1, lng AS x1 FROM {_DENSE} WINDOW w AS (PARTITION BY plan ORDER BY seq, j)) WHERE y0 IS NOT NULL) WHERE m > 0.001)))))
    GROUP BY plan, piece))"""


@query(f"""
SELECT plan, run_no, category, round(sum(m), 2) AS length_m, round(sum(m * slope) / sum(m), 5) AS slope, round(max(cross_slope), 5) AS cross_slope FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY plan ORDER BY piece) AS BIGINT) AS run_no FROM (
    SELECT *, CASE WHEN lag(category) OVER (PARTITION BY plan ORDER BY piece) IS NOT DISTINCT FROM category THEN 0 ELSE 1 END AS new FROM {_PIECES})) GROUP BY plan, run_no, category""")
def slope_segments(spark, sf):
    """Runs of one slope class along each line on the stand-in terrain."""
    return linear.slope_segments(linear.slope_pieces(linear.densify(vertices(spark, sf))))


@query(f"""
SELECT plan, round(sum(m), 2) AS total_m, round(sum(m * slope) / sum(m), 5) AS mean_slope, round(max(slope), 5) AS max_slope, round(max(cross_slope), 5) AS max_cross_slope,
       {', '.join(f"round(sum(CASE WHEN category = '{c}' THEN m ELSE 0 END), 2) AS {c}_m" for c in ("flat", "medium", "steep", "very_steep"))} FROM {_PIECES} GROUP BY plan""")
def slope_distribution(spark, sf):
    """Mean and largest slope of each line, and its metres by class."""
    return linear.slope_summary(linear.slope_pieces(linear.densify(vertices(spark, sf))))


#: A second partition of the same lines, by its own lengths scaled to the line's.
_SCALED = f"""(SELECT plan, veg, conf, (cum - w) * total / all_w AS start_m, cum * total / all_w AS end_m FROM (
  SELECT *, sum(w) OVER (PARTITION BY plan ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY plan) AS all_w, sum(len) OVER (PARTITION BY plan) AS total FROM (SELECT *, 50.0 + part % 911 AS w FROM {SEG})))"""


def _second(spark, sf):
    w, plan = Window.partitionBy("plan").orderBy(*linear.ORDER), Window.partitionBy("plan")
    s = segments(spark, sf).withColumn("w", F.expr("50.0e0 + part % 911"))
    s = s.select("plan", "veg", "conf", "w", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("w").over(plan).alias("all_w"), F.sum("len").over(plan).alias("total"))
    return s.select("plan", "veg", "conf", F.expr("(cum - w) * total / all_w").alias("start_m"), F.expr("cum * total / all_w").alias("end_m"))


_CUTS = f"(SELECT plan, end_m AS m FROM {_CHAIN} UNION SELECT plan, 0 FROM {SEG} UNION SELECT plan, end_m FROM {_SCALED})"
_OVERLAY = f"""(
  SELECT c.plan, c.a AS start_m, c.b AS end_m, s.slope_class, s.slope, v.veg, v.conf FROM (SELECT plan, m AS a, lead(m) OVER (PARTITION BY plan ORDER BY m) AS b FROM {_CUTS}) AS c
  JOIN (SELECT *, end_m - len AS s0 FROM {_CHAIN.replace(SEG, _CLASSED)}) AS s ON s.plan = c.plan AND (a + b) / 2 > s.s0 AND (a + b) / 2 <= s.end_m
  JOIN {_SCALED} AS v ON v.plan = c.plan AND (a + b) / 2 > v.start_m AND (a + b) / 2 <= v.end_m WHERE b - a >= 1)"""


@query(f"""
SELECT plan, run_no, slope_class, veg, round(min(start_m), 2) AS start_m, round(max(end_m), 2) AS end_m, round(sum(slope * (end_m - start_m)) / sum(end_m - start_m), 5) AS slope, round(sum(conf * (end_m - start_m)) / sum(end_m - start_m), 5) AS conf FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY plan ORDER BY start_m) AS BIGINT) AS run_no FROM (
    SELECT *, CASE WHEN lag(slope_class) OVER w IS NOT DISTINCT FROM slope_class AND lag(veg) OVER w IS NOT DISTINCT FROM veg THEN 0 ELSE 1 END AS new FROM {_OVERLAY} WINDOW w AS (PARTITION BY plan ORDER BY start_m)))
GROUP BY plan, run_no, slope_class, veg""")
def overlay_join(spark, sf):
    """Slope and vegetation segments of each line laid over each other, equal neighbours joined."""
    slope = linear.chainage(classed(spark, sf)).select("plan", "start_m", "end_m", "slope_class", "slope")
    return linear.merged(linear.overlay(slope, _second(spark, sf)), ["slope_class", "veg"], ["slope", "conf"])


@query(f"SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY seq, j) AS INTEGER) AS place, round(y0 + (lat - y0) * f, 6) AS lat, round(x0 + (lng - x0) * f, 6) AS lng FROM (SELECT plan, seq, 0 AS j, lat, lng, lat AS y0, lng AS x0, 1.0 AS f FROM {_VERT} WHERE seq = 0 UNION ALL SELECT plan, seq, j, lat, lng, y0, x0, j / n FROM (SELECT * EXCLUDE (n), unnest(range(1, 1 + CAST(greatest(1, ceil(d / 200.0)) AS BIGINT))) AS j, greatest(1, ceil(d / 200.0)) AS n FROM {_VERT} WHERE seq > 0))")
def resample_path(spark, sf):
    """Lines with steps of at most 200 m."""
    w = Window.partitionBy("plan").orderBy("seq", "j")
    return linear.resample(vertices(spark, sf), 200.0).select("plan", F.row_number().over(w).alias("place"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_STEP = "SELECT plan, seq, n, CASE WHEN seq = 0 OR seq = n OR seq % 3 = 2 THEN lat ELSE lat * 0.5 + (lag(lat) OVER w + lead(lat) OVER w) / 2 * 0.5 END AS lat, CASE WHEN seq = 0 OR seq = n OR seq % 3 = 2 THEN lng ELSE lng * 0.5 + (lag(lng) OVER w + lead(lng) OVER w) / 2 * 0.5 END AS lng FROM ({}) WINDOW w AS (PARTITION BY plan ORDER BY seq)"


@query(f"SELECT plan, CAST(seq AS INTEGER) AS seq, round(lat, 6) AS lat, round(lng, 6) AS lng FROM ({_STEP.format(_STEP.format(f'SELECT plan, seq, n, lat, lng FROM {_VERT}'))})")
def path_smooth(spark, sf):
    """Two rounds of smoothing; every third vertex is locked."""
    return linear.smoothed(vertices(spark, sf), F.col("seq") % 3 == 2, 2).select("plan", "seq", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(f"""
SELECT plan, CAST(seq AS INTEGER) AS seq, j, round(CASE WHEN n < 2 THEN lat WHEN j = 0 THEN lat * 0.75 + nlat * 0.25 ELSE lat * 0.25 + nlat * 0.75 END, 6) AS lat, round(CASE WHEN n < 2 THEN lng WHEN j = 0 THEN lng * 0.75 + nlng * 0.25 ELSE lng * 0.25 + nlng * 0.75 END, 6) AS lng
FROM (SELECT *, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS nlat, coalesce(lead(lng) OVER w, first_value(lng) OVER w) AS nlng FROM {_VERT} WINDOW w AS (PARTITION BY plan ORDER BY seq)) CROSS JOIN (SELECT unnest([0, 1]) AS j) WHERE n >= 2 OR j = 0""")
def ring_chaikin(spark, sf):
    """Rings (a line closed on itself) with their corners cut."""
    return linear.chaikin(vertices(spark, sf)).select("plan", "seq", "j", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(f"""
WITH r AS (SELECT supp, part, price, len, row_number() OVER (PARTITION BY supp ORDER BY plan, {_ORD}) - 1 AS r, count(*) OVER (PARTITION BY supp) AS n FROM {SEG})
SELECT supp, r AS place, part, price, len FROM r WHERE n <= 500 UNION ALL SELECT supp, i AS place, part, price, len FROM r JOIN (SELECT unnest(range(500)) AS i) ON r = CAST(floor(i * (n / 500.0e0)) AS BIGINT) WHERE n > 500
UNION ALL SELECT supp, 500, part, price, len FROM r WHERE n > 500 AND r = n - 1""")
def profile_downsample(spark, sf):
    """At most 500 points and the last of each long profile."""
    rows = linear.downsampled(segments(spark, sf), "supp", ["plan", *linear.ORDER], 500)
    return rows.select("supp", F.col("place").cast("long").alias("place"), "part", "price", "len")


@query(f"""
SELECT plan, round(CASE WHEN stands THEN lat ELSE y0 + (lat - y0) * f END, 6) AS lat, round(CASE WHEN stands THEN lng ELSE x0 + (lng - x0) * f END, 6) AS lng, CAST(CASE WHEN seq = n AND e >= cum THEN seq WHEN seq = 0 THEN 0 ELSE seq - 1 END AS INTEGER) AS path_index FROM (
  SELECT *, seq = 0 OR e >= cum AS stands, CASE WHEN d > 0 THEN (e - (cum - d)) / d ELSE 0 END AS f, row_number() OVER (PARTITION BY plan ORDER BY seq) AS rn FROM (
    SELECT *, (plan % 17) * 120.0 AS e FROM {_VERT}) WHERE (seq = 0 AND e <= cum) OR (seq > 0 AND cum >= e) OR seq = n) WHERE rn = 1""")
def position_at_elapsed(spark, sf):
    """Where a mover of a metre a second is after some time."""
    path = vertices(spark, sf).select("plan", "seq", "lat", "lng", F.col("cum").alias("seconds"))
    return linear.position_at(path, F.expr("(plan % 17) * 120.0e0")).select("plan", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "path_index")


_OVR = "(SELECT o_orderkey AS plan, o_orderkey % 7 <> 0 AS enabled, CASE WHEN o_orderkey % 5 = 0 THEN 'mediumscrub' END AS route, (o_custkey % 10) * 50.0 AS a0, (o_custkey % 10) * 50.0 + 300 AS a1, (o_orderkey % 8) * 60.0 AS b0, (o_orderkey % 8) * 60.0 + 500 AS b1, o_orderkey % 3 = 0 AS listed FROM orders)"


@query(f"""
SELECT s.plan, seg_no, CASE WHEN enabled AND listed AND mid BETWEEN a0 AND a1 THEN 'grassland' WHEN enabled AND listed AND mid BETWEEN b0 AND b1 THEN 'heavyforest' WHEN enabled AND route IS NOT NULL THEN route ELSE veg END AS veg,
       CASE WHEN enabled AND (route IS NOT NULL OR listed AND (mid BETWEEN a0 AND a1 OR mid BETWEEN b0 AND b1)) THEN 1.0 ELSE round(conf, 6) END AS confidence
FROM (SELECT *, end_m - len / 2 AS mid FROM {_CHAIN}) AS s LEFT JOIN {_OVR} AS o ON o.plan = s.plan""")
def segment_overrides(spark, sf):
    """The vegetation of each segment's middle with the plan's overrides: the first span that holds it, else the route's, else its own."""
    s = linear.chainage(segments(spark, sf))
    return overrides.effective(s.select("plan", "seg_no", "veg", "conf", (F.col("end_m") - F.col("len") / 2).alias("mid")), overrides.derived(spark, sf)).select("plan", F.col("seg_no").cast("long").alias("seg_no"), "veg", F.round("confidence", 6).alias("confidence"))


_SPANS = "(SELECT o_orderkey AS plan, unnest([0, 1, 2]) AS ord, unnest([(o_custkey % 10) * 50.0e0, (o_orderkey % 8) * 60.0e0, 900.0e0]) AS s, unnest([(o_custkey % 10) * 50.0e0 + 300, (o_orderkey % 8) * 60.0e0 + 500, 1000.0e0]) AS e, unnest(['grassland', 'heavyforest', 'lightshrub']) AS veg FROM orders)"
_NEW = "(SELECT o_orderkey AS plan, (o_orderkey % 11) * 80.0e0 AS ns, (o_orderkey % 11) * 80.0e0 + 100 AS ne FROM orders)"


@query(f"""
WITH x AS (SELECT *, NOT (ne < s OR ns > e) AS hit FROM {_SPANS} JOIN {_NEW} USING (plan)), a AS (
  SELECT plan, ord, s, e, s AS s2, e AS e2, veg, hit FROM x WHERE NOT hit UNION ALL SELECT plan, 9, min(ns), min(ne), min(CASE WHEN hit THEN least(s, ns) ELSE ns END), max(CASE WHEN hit THEN greatest(e, ne) ELSE ne END), 'mediumscrub', false FROM x GROUP BY plan)
SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY ord) - 1 AS INTEGER) AS place, s AS replace_start, e AS replace_end, s2 AS merge_start, e2 AS merge_end, veg FROM a""")
def merge_overrides(spark, sf):
    """A new span put in place of those that it touches: as it is, or grown over them."""
    spans, new = overrides.derived_spans(spark, sf)
    return overrides.put(spans, new)


#: A track a supplier, to and fro with some noise.
_TRACK = {"line": "l_suppkey", "i": "l_orderkey * 8 + l_linenumber", "lat": "-35.0e0 + l_orderkey * 0.00002e0", "lng": "149.0e0 + (l_partkey % 23) * 0.00002e0 + abs(l_orderkey % 4000 - 2000) * 0.00001e0"}


@query(f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT line, i, min(lat) AS lat, min(lng) AS lng FROM {t.derived_sql("lineitem", _TRACK)} GROUP BY ALL),
pieces AS (
  SELECT line, min(i) AS lo, max(i) AS hi FROM v GROUP BY line
  UNION ALL
  SELECT line, CASE WHEN left_ THEN lo ELSE w END, CASE WHEN left_ THEN w ELSE hi END FROM (
    SELECT line, lo, hi, arg_max(i, (d, -i)) AS w FROM (
      SELECT line, lo, hi, i, round(sqrt(pow(px - s * ex, 2) + pow(py - s * ey, 2)), 6) AS d FROM (
        SELECT *, CASE WHEN ex * ex + ey * ey = 0 THEN 0 ELSE greatest(0.0, least(1.0, (px * ex + py * ey) / (ex * ex + ey * ey))) END AS s FROM (
          SELECT p.line, p.lo, p.hi, v.i, (v.lng - a.lng) * 111320.0e0 * cos(radians(a.lat)) AS px, (v.lat - a.lat) * 111320.0e0 AS py, (b.lng - a.lng) * 111320.0e0 * cos(radians(a.lat)) AS ex, (b.lat - a.lat) * 111320.0e0 AS ey
          FROM pieces AS p JOIN v ON v.line = p.line AND v.i > p.lo AND v.i < p.hi JOIN v AS a ON a.line = p.line AND a.i = p.lo JOIN v AS b ON b.line = p.line AND b.i = p.hi)))
    GROUP BY line, lo, hi HAVING max(d) > 12.0), (VALUES (true), (false)) AS s(left_))
SELECT v.line, v.i, round(v.lat, 6) AS lat, round(v.lng, 6) AS lng FROM v WHERE EXISTS (SELECT 1 FROM pieces AS p WHERE p.line = v.line AND (p.lo = v.i OR p.hi = v.i))""")
def path_simplify(spark, sf):
    """Vertices of each supplier's track that stay when it is simplified to 12 m."""
    v = dealt(t.derived(spark, sf, "lineitem", _TRACK), "line", light=True).groupBy("line", "i").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    return simplify.simplify(v).select("line", "i", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
