"""Linear referencing along lines and interval operators.

A plan is one drawn line of at most ``MAX_VERTICES`` vertices (``guard`` tells which plans are beyond it), so what orders a
plan's rows takes a window by plan: one shuffle, one sort, no join of a plan's rows with each other.  The shuffle deals rows to as many
tasks as their number asks for, so a task's memory is that of its share, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, destination, haversine_m, mock_elevation_m, slope_deg
from ..functions.production import slope_class_sql
from ..sources.shared import dealt

#: A total order of a plan's segments; the line number alone has ties.
ORDER = ("line", "part", "supp", "price", "len", "slope")
MAX_VERTICES = 50_000
#: Metres between densified points, between samples of a profile, and to the probes beside it.
INTERVAL_M, SAMPLE_M, PROBE_M = 100.0, 10.0, 15.0
#: Points closer than this are one.
SAME_M = 0.001
PROFILE_POINTS = 600


def chainage(segments: DataFrame) -> DataFrame:
    """Start and end of each segment along its plan."""
    w = Window.partitionBy("plan").orderBy(*ORDER)
    s = dealt(segments, "plan", light=True).withColumn("seg_no", F.row_number().over(w)).withColumn("end_m", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.withColumn("start_m", F.col("end_m") - F.col("len"))


def runs(segments: DataFrame, *by: str) -> DataFrame:
    """Maximal runs of consecutive segments with the same values of ``by``: gaps and islands, in the order of the chainage, so that one sort serves both."""
    w = Window.partitionBy("plan").orderBy(*ORDER)
    changed = [~F.lag(c).over(w).eqNullSafe(F.col(c)) for c in by]
    new = changed[0]
    for c in changed[1:]:
        new = new | c
    s = chainage(segments).withColumn("_new", new.cast("int"))
    s = s.withColumn("run_no", F.sum("_new").over(w))
    return s.groupBy("plan", "run_no", *by).agg(F.round(F.min("start_m"), 3).alias("start_m"), F.round(F.max("end_m"), 3).alias("end_m"), F.count(F.lit(1)).alias("segments"), F.round(F.max("slope"), 6).alias("max_slope"))


def overlap_matrix(segments: DataFrame, by_a: str, by_b: str) -> DataFrame:
    """Length by the values of two partitions of the same lines, and the pieces that the overlaps of their runs make.

    A piece is a maximal run in which both values stay, so one pass over the line finds them; no run is joined with another.
    """
    return runs(segments, by_a, by_b).groupBy(by_a, by_b).agg(F.round(F.sum(F.col("end_m") - F.col("start_m")), 2).alias("overlap_m"), F.count(F.lit(1)).alias("pieces"))


def guard(points: DataFrame, most: int = MAX_VERTICES) -> DataFrame:
    """Vertices of each plan and whether it has no more than ``most``."""
    return points.groupBy("plan").agg(F.count(F.lit(1)).alias("vertices")).withColumn("accepted", F.col("vertices") <= most)


def vertices(points: DataFrame) -> DataFrame:
    """seq from 0, lat, lng, chainage ``cum`` and the vertex before (_lat, _lng, _cum, null for the first) of each plan's points.

    A plan of more than MAX_VERTICES is an error, as its windows would have no bound.
    """
    w = Window.partitionBy("plan").orderBy(*ORDER)
    n = F.row_number().over(w)
    p = dealt(points, "plan").select("plan", F.when(n <= MAX_VERTICES, n - 1).otherwise(F.raise_error(F.lit(f"a plan has more than {MAX_VERTICES} vertices"))).alias("seq"), "lat", "lng", F.lag("lat").over(w).alias("_lat"), F.lag("lng").over(w).alias("_lng"))
    p = p.withColumn("dist_m", F.coalesce(haversine_m(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng")), F.lit(0.0)))
    along = Window.partitionBy("plan").orderBy("seq")
    p = p.withColumn("cum", F.sum("dist_m").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return p.withColumn("_cum", F.lag("cum").over(along)).withColumn("total", F.max("cum").over(Window.partitionBy("plan"))).withColumn("last", F.lead("seq").over(along).isNull())


def track_slopes(points: DataFrame) -> DataFrame:
    """Per step of a plan: metres and slope on the stand-in terrain, flagged as estimated."""
    v = vertices(points).filter("seq > 0")
    rise = mock_elevation_m(F.col("lat"), F.col("lng")) - mock_elevation_m(F.col("_lat"), F.col("_lng"))
    return v.select("plan", "seq", "dist_m", slope_deg(rise, F.col("dist_m")).alias("slope"), F.lit(True).alias("estimated"))


def points_at(v: DataFrame, chainages: Column) -> DataFrame:
    """plan, k, lat, lng of each plan's positions at an array of chainages (from ``plan`` alone), clamped to the line.

    The step is the first whose end is not before the chainage; a plan of one vertex is there at all chainages.
    """
    at = v.select("*", F.posexplode(chainages).alias("k", "_x"))
    at = at.withColumn("m", F.greatest(F.lit(0.0), F.least("_x", "total")))
    fits = (F.col("seq") > 0) & ((F.col("cum") >= F.col("m")) | F.col("last")) | (F.col("last") & (F.col("seq") == 0))
    step = F.when(fits, F.struct("seq", "lat", "lng", "_lat", "_lng", "_cum", "cum", "m"))
    hit = at.groupBy("plan", "k").agg(F.min(step).alias("s")).select("plan", "k", "s.*")  # the least seq
    t = F.when(F.col("cum") > F.col("_cum"), (F.col("m") - F.col("_cum")) / (F.col("cum") - F.col("_cum"))).otherwise(0.0)
    between = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
    return hit.select("plan", "k", between("_lat", "lat").alias("lat"), between("_lng", "lng").alias("lng"))


def slices(v: DataFrame, start: Column, end: Column) -> DataFrame:
    """plan, seq, lat, lng of the part of each plan from ``start`` to ``end`` (columns of ``plan``): interpolated ends, vertices strictly between.

    An empty part is one point; a plan of one vertex is that vertex.
    """
    v = v.withColumn("_a", F.greatest(F.lit(0.0), F.least(start, end, "total"))).withColumn("_b", F.least("total", F.greatest(start, end, F.lit(0.0))))
    inner = v.filter("total > 0 AND cum > _a AND cum < _b").select("plan", (F.col("seq") + 1).alias("seq"), "lat", "lng")
    ends = points_at(v, F.when(F.col("_b") > F.col("_a"), F.array("_a", "_b")).otherwise(F.array("_a")))
    return inner.unionByName(ends.select("plan", F.when(F.col("k") == 0, 0).otherwise(1_000_000_000).alias("seq"), "lat", "lng"))


def densify(v: DataFrame, interval: float = INTERVAL_M) -> DataFrame:
    """plan, seq, j, lat, lng: the vertices (j = 0) and, every ``interval`` metres of a running distance, a point on the step to the next (j from 1).

    Points within a millimetre of the vertex before or after, and repeated vertices, are left out.
    """
    first = F.lit(interval) - F.pmod("_cum", F.lit(interval))
    n = F.greatest(F.lit(0), F.ceil((F.col("dist_m") - first) / interval).cast("int"))  # points at first + j * interval < dist_m; none before the first vertex
    steps = v.withColumn("_first", first).withColumn("_j", F.explode(F.sequence(F.lit(0), n)))
    d = F.when(F.col("_j") == 0, F.col("dist_m")).otherwise(F.col("_first") + (F.col("_j") - 1) * interval)
    pts = steps.withColumn("_d", d).filter((F.col("seq") == 0) | (F.col("_d") > SAME_M) & ((F.col("_j") == 0) | (F.col("dist_m") - F.col("_d") > SAME_M)))
    ratio = F.when(F.col("_j") == 0, 1.0).otherwise(F.col("_d") / F.col("dist_m"))
    at = lambda c: F.when(F.col("seq") == 0, F.col(c)).otherwise(F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * ratio)
    return pts.select("plan", F.when(F.col("_j") == 0, F.col("seq")).otherwise(F.col("seq") - 1).alias("seq"), F.col("_j").alias("j"), at("lat").alias("lat"), at("lng").alias("lng"))


def slope_pieces(dense: DataFrame) -> DataFrame:
    """Per piece between densified points: metres, mean slope by samples every 10 m, class of the steepest sample, cross slope.

    Rows lie by plan already, so the samples of a piece are made and summed where it is.  The cross slope is the largest of three probes
    (start, middle, end) between points 15 m to either side.
    """
    w = Window.partitionBy("plan").orderBy("seq", "j")
    p = dense.select("plan", (F.row_number().over(w) - 1).alias("piece"), F.lag("lat").over(w).alias("y0"), F.lag("lng").over(w).alias("x0"), F.col("lat").alias("y1"), F.col("lng").alias("x1"))
    p = p.filter("y0 IS NOT NULL").withColumn("m", haversine_m(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"))).filter(F.col("m") > SAME_M)
    p = p.withColumn("_brg", bearing_deg(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1")))

    def probe(lat: Column, lng: Column) -> Column:
        left, right = destination(lat, lng, F.col("_brg") - 90, F.lit(PROBE_M)), destination(lat, lng, F.col("_brg") + 90, F.lit(PROBE_M))
        return slope_deg(mock_elevation_m(*right) - mock_elevation_m(*left), F.lit(2 * PROBE_M))

    probes = {"_p0": probe(F.col("y0"), F.col("x0")), "_p1": probe((F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2), "_p2": probe(F.col("y1"), F.col("x1"))}
    p = p.withColumns(probes).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("m") / SAMPLE_M).cast("int")))
    s = p.select("plan", "piece", "m", F.greatest(*probes).alias("cross_slope"), "y0", "x0", "y1", "x1", "_n", F.explode(F.sequence(F.lit(1), "_n")).alias("_k"))
    on = lambda k: ((F.col("y0") + (F.col("y1") - F.col("y0")) * k / F.col("_n")), (F.col("x0") + (F.col("x1") - F.col("x0")) * k / F.col("_n")))
    (ya, xa), (yb, xb) = on(F.col("_k") - 1), on(F.col("_k"))
    s = s.select("plan", "piece", "m", "cross_slope", ya.alias("ya"), xa.alias("xa"), yb.alias("yb"), xb.alias("xb"))
    s = s.select("plan", "piece", "m", "cross_slope", haversine_m(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb")).alias("_d"), (mock_elevation_m(F.col("yb"), F.col("xb")) - mock_elevation_m(F.col("ya"), F.col("xa"))).alias("_rise"))
    s = s.withColumn("_s", slope_deg(F.col("_rise"), F.col("_d")))
    p = s.groupBy("plan", "piece").agg(F.first("m").alias("m"), F.first("cross_slope").alias("cross_slope"), F.sum("_d").alias("_t"), F.sum(F.col("_d") * F.col("_s")).alias("_ds"), F.round(F.max("_s"), 9).alias("_top"))
    return p.select("plan", "piece", "m", F.expr("coalesce(_ds / nullif(_t, 0e0), 0e0)").alias("slope"), F.expr(slope_class_sql("_top")).alias("category"), "cross_slope")


def slope_segments(pieces: DataFrame) -> DataFrame:
    """Runs of pieces of one class: metres, length-weighted slope, largest cross slope."""
    w = Window.partitionBy("plan").orderBy("piece")
    p = pieces.withColumn("_new", (~F.lag("category").over(w).eqNullSafe(F.col("category"))).cast("int")).withColumn("run_no", F.sum("_new").over(w))
    return p.groupBy("plan", "run_no", "category").agg(F.round(F.sum("m"), 2).alias("length_m"), F.round(F.sum(F.col("m") * F.col("slope")) / F.sum("m"), 5).alias("slope"), F.round(F.max("cross_slope"), 5).alias("cross_slope"))


def slope_summary(pieces: DataFrame) -> DataFrame:
    """Per plan: metres, mean slope, largest of the pieces' mean slopes and cross slopes, metres by class."""
    by = [F.round(F.sum(F.when(F.col("category") == c, F.col("m")).otherwise(0.0)), 2).alias(f"{c}_m") for c in ("flat", "medium", "steep", "very_steep")]
    return pieces.groupBy("plan").agg(F.round(F.sum("m"), 2).alias("total_m"), F.round(F.sum(F.col("m") * F.col("slope")) / F.sum("m"), 5).alias("mean_slope"), F.round(F.max("slope"), 5).alias("max_slope"), F.round(F.max("cross_slope"), 5).alias("max_cross_slope"), *by)


def overlay(a: DataFrame, b: DataFrame, least_m: float = 1.0) -> DataFrame:
    """Pieces of two partitions of the same lines: plan, start_m, end_m, the columns of ``a`` and of ``b``.

    Both have plan, start_m and end_m, gapless from 0.  Their starts are sorted together and each carries the last values of the other
    side on, so no interval is compared with all others of its plan.  Pieces shorter than ``least_m`` are left out.
    """
    own_a, own_b = ([c for c in df.columns if c not in ("plan", "start_m", "end_m")] for df in (a, b))
    one = lambda df, own, side: df.select("plan", F.col("start_m").alias("m"), F.col("end_m").alias("_to"), F.lit(side).alias("_side"), (F.struct(*own) if side == 0 else F.lit(None).cast(a.select(F.struct(*own_a)).schema[0].dataType)).alias("_a"), (F.struct(*own) if side == 1 else F.lit(None).cast(b.select(F.struct(*own_b)).schema[0].dataType)).alias("_b"))
    ends = one(a, own_a, 0).unionByName(one(b, own_b, 1))
    w = Window.partitionBy("plan").orderBy("m", "_side")
    s = ends.select("plan", "m", F.coalesce(F.lead("m").over(w), F.max("_to").over(Window.partitionBy("plan"))).alias("end_m"), *(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("_a", "_b")))
    return s.filter(F.col("end_m") - F.col("m") >= least_m).select("plan", F.col("m").alias("start_m"), "end_m", *(F.col(f"_a.{c}") for c in own_a), *(F.col(f"_b.{c}") for c in own_b))


def merged(pieces: DataFrame, keys: list[str], weighted: list[str]) -> DataFrame:
    """Consecutive pieces of equal ``keys`` as one; ``weighted`` columns are averaged by length."""
    w = Window.partitionBy("plan").orderBy("start_m")
    same = F.lit(True)
    for k in keys:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    p = pieces.withColumn("_new", F.when(F.lag("start_m").over(w).isNull() | ~same, 1).otherwise(0)).withColumn("run_no", F.sum("_new").over(w))
    length = F.col("end_m") - F.col("start_m")
    return p.groupBy("plan", "run_no", *keys).agg(F.round(F.min("start_m"), 2).alias("start_m"), F.round(F.max("end_m"), 2).alias("end_m"), *(F.round(F.sum(F.col(c) * length) / F.sum(length), 5).alias(c) for c in weighted))


def resample(v: DataFrame, spacing: float) -> DataFrame:
    """plan, seq, j, lat, lng: all vertices and, on steps longer than ``spacing``, equal steps of at most that."""
    n = F.greatest(F.lit(1), F.ceil(F.col("dist_m") / spacing).cast("int"))
    steps = v.filter("seq > 0").select("plan", "seq", F.explode(F.sequence(F.lit(1), n)).alias("j"), n.alias("_n"), "lat", "lng", "_lat", "_lng")
    t = F.col("j") / F.col("_n")
    return v.filter("seq = 0").select("plan", "seq", F.lit(0).alias("j"), "lat", "lng").unionByName(steps.select("plan", "seq", "j", *((F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * t).alias(c) for c in ("lat", "lng"))))


def smoothed(v: DataFrame, locked: Column, rounds: int, weight: float = 0.5) -> DataFrame:
    """Vertices drawn towards the middle of their neighbours ``rounds`` times; ends and locked ones stay.  One sort serves all rounds."""
    w = Window.partitionBy("plan").orderBy("seq")
    s = v.select("plan", "seq", "lat", "lng", (locked | (F.col("seq") == 0) | F.col("last")).alias("_locked"))
    for _ in range(rounds):
        pull = lambda c: F.when(F.col("_locked"), F.col(c)).otherwise(F.col(c) * (1 - weight) + (F.lag(c).over(w) + F.lead(c).over(w)) / 2 * weight)
        s = s.select("plan", "seq", pull("lat").alias("lat"), pull("lng").alias("lng"), "_locked")
    return s.drop("_locked")


def chaikin(v: DataFrame) -> DataFrame:
    """Corners of rings cut once: per edge (the last closes the ring) points at a quarter and three; rings of fewer than 3 vertices stay."""
    w = Window.partitionBy("plan").orderBy("seq")
    ring = Window.partitionBy("plan")
    s = v.select("plan", "seq", "lat", "lng", F.count(F.lit(1)).over(ring).alias("_n"), *(F.coalesce(F.lead(c).over(w), F.first(c).over(w)).alias(f"_{c}") for c in ("lat", "lng")))
    cut = s.withColumn("j", F.explode(F.when(F.col("_n") < 3, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    t = F.when(F.col("_n") < 3, 0.0).when(F.col("j") == 0, 0.25).otherwise(0.75)
    return cut.select("plan", "seq", "j", *((F.col(c) * (1 - t) + F.col(f"_{c}") * t).alias(c) for c in ("lat", "lng")))


def downsampled(rows: DataFrame, key: str, order: list[str], most: int = PROFILE_POINTS) -> DataFrame:
    """Of keys with more than ``most`` rows, rows floor(i * n / most) for i below ``most`` and the last; all of the others.  Adds place, from 0.

    A long profile's last row is given once more where the rule has picked it already.
    """
    w = Window.partitionBy(key).orderBy(*order)
    r = rows.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    step = F.col("_n") / most
    near = F.ceil(F.col("_r") / step).cast("int")  # the first i with i * step >= row, or by rounding the one after
    of_long = F.filter(F.array(near - 1, near), lambda i: (i >= 0) & (i < most) & (F.floor(i * step) == F.col("_r")))
    places = F.when(F.col("_n") <= most, F.array(F.col("_r"))).when(F.col("_r") == F.col("_n") - 1, F.concat(of_long, F.array(F.lit(most)))).otherwise(of_long)
    return r.withColumn("place", F.explode(places)).drop("_r", "_n")


def position_at(path: DataFrame, elapsed: Column) -> DataFrame:
    """plan, lat, lng, index of movers that reach their vertices (seq, lat, lng, seconds) in time; before the start and after the end they stand there."""
    w = Window.partitionBy("plan").orderBy("seq")
    p = path.select("plan", "seq", "lat", "lng", "seconds", *(F.lag(c).over(w).alias(f"_{c}") for c in ("lat", "lng", "seconds")), F.lead("seq").over(w).isNull().alias("_last"), elapsed.alias("_t"))
    fits = ((F.col("seq") == 0) & (F.col("_t") <= F.col("seconds"))) | ((F.col("seq") > 0) & (F.col("seconds") >= F.col("_t"))) | F.col("_last")
    hit = p.groupBy("plan").agg(F.min(F.when(fits, F.struct("seq", "lat", "lng", "seconds", "_lat", "_lng", "_seconds", "_t", "_last"))).alias("s")).select("plan", "s.*")
    stands = (F.col("seq") == 0) | (F.col("_t") >= F.col("seconds"))
    t = F.when(F.col("seconds") > F.col("_seconds"), (F.col("_t") - F.col("_seconds")) / (F.col("seconds") - F.col("_seconds"))).otherwise(0.0)
    at = lambda c: F.when(stands, F.col(c)).otherwise(F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * t)
    return hit.select("plan", at("lat").alias("lat"), at("lng").alias("lng"), F.when(F.col("_last") & (F.col("_t") >= F.col("seconds")), F.col("seq")).otherwise(F.greatest(F.col("seq") - 1, F.lit(0))).alias("path_index"))
