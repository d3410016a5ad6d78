"""The box around an incident: each sector stands off as far as the fire runs while the line is built, which depends on how far it stands off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import destination, haversine_m

# Iterations, tolerance, least, largest and first stand-off in metres; sectors in their order.
ITERATIONS, TOLERANCE_M, LEAST_M, MOST_M, SEED_M = 3, 15.0, 30.0, 5000.0, 100.0
SECTORS = ("head", "leftFlank", "rightFlank", "rear")


def moved(p: Column, metres: Column) -> Column:
    """A vertex (lat, lng, bearing) moved outwards."""
    lat, lng = destination(p["lat"], p["lng"], p["bearing"], metres)
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def line_m(points: Column) -> Column:
    steps = F.transform(points, lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(haversine_m(F.get(points, i - 1)["lat"], F.get(points, i - 1)["lng"], p["lat"], p["lng"])))
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)


def stand_off(vertices: DataFrame, fires: DataFrame) -> DataFrame:
    """fire, sector, ros, distance_m, hours, converged, vertices of each sector that has vertices.

    vertices: as from ``spatial.sectors`` (fire, id, lat, lng, bearing, sector).  fires: fire, head, flank, rear (metres an hour that the fire runs; without a flank's or rear's
    the head's holds) and pace (metres an hour that the slowest usable resource builds).  Starting from SEED_M a sector's line is moved out, the time to build it taken, and the distance
    set to what the fire runs in that time, within LEAST_M and MOST_M, until it changes by TOLERANCE_M at most or for ITERATIONS times: a fold in the row.  A
    sector of one vertex borrows the first vertex of the first other sector for a line; without one no time can be told (hours null, the seed holds).
    """
    place = F.array_position(F.array(*map(F.lit, SECTORS)), F.col("sector"))
    v = vertices.groupBy("fire", "sector").agg(F.sort_array(F.collect_list(F.struct("id", "lat", "lng", "bearing"))).alias("_v")).withColumn("_place", place)  # one sector's vertices
    first = F.struct("_place", F.col("_v")[0]["lat"].alias("lat"), F.col("_v")[0]["lng"].alias("lng"))
    others = v.withColumn("_all", F.sort_array(F.collect_list(first).over(Window.partitionBy("fire"))))  # four sectors at most
    v = others.withColumn("_near", F.get(F.filter("_all", lambda o: o["_place"] != F.col("_place")), F.lit(0))).join(fires, "fire")
    v = v.withColumn("ros", F.when(F.col("sector") == "head", F.col("head")).when(F.col("sector") == "rear", F.coalesce("rear", "head")).otherwise(F.coalesce("flank", "head")))
    borrowed = F.when((F.size("_v") < 2) & F.col("_near").isNotNull(), F.array(F.struct(F.col("_near.lat").alias("lat"), F.col("_near.lng").alias("lng")))).otherwise(F.array().cast("array<struct<lat:double,lng:double>>"))
    state = lambda d, h, ok, end: F.struct(d.alias("d"), h.alias("h"), ok.alias("ok"), end.alias("end"))

    def step(s: Column, _: Column) -> Column:
        line = F.concat(F.transform("_v", lambda p: moved(p, s["d"])), borrowed)
        metres = F.transform(F.array(line), line_m)[0]  # the line is made once
        hours = F.when(F.size("_v") + F.size(borrowed) < 2, F.lit(None).cast("double")).when(metres < 1, 0.0).otherwise(metres / F.col("pace"))
        return F.transform(F.array(hours), lambda h: F.transform(F.array(F.least(F.lit(MOST_M), F.greatest(F.lit(LEAST_M), F.col("ros") * h))), lambda need: F.when(s["end"], s).when(h.isNull(), state(s["d"], h, F.lit(False), F.lit(True))).otherwise(state(need, h, F.abs(need - s["d"]) <= TOLERANCE_M, F.abs(need - s["d"]) <= TOLERANCE_M)))[0])[0]

    begun = state(F.lit(SEED_M), F.lit(None).cast("double"), F.lit(False), F.lit(False))
    out = v.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), begun, step))
    return out.select("fire", "sector", "ros", F.col("_s.d").alias("distance_m"), F.col("_s.h").alias("hours"), F.col("_s.ok").alias("converged"), F.size("_v").alias("vertices"))


def box(vertices: DataFrame, distances: DataFrame) -> DataFrame:
    """fire, place, lat, lng of the closed ring: vertices moved out by their sector's distance, the first again at the end."""
    lat, lng = destination(F.col("lat"), F.col("lng"), F.col("bearing"), F.col("distance_m"))
    p = vertices.join(distances.select("fire", "sector", "distance_m"), ["fire", "sector"]).select("fire", "id", lat.alias("lat"), lng.alias("lng"))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("fire").orderBy("id")) - 1)
    n = p.groupBy("fire").agg(F.max("place").alias("_n"))
    last = p.filter("place = 0").join(n, "fire").select("fire", (F.col("_n") + 1).alias("place"), "lat", "lng")
    return p.select("fire", "place", "lat", "lng").unionByName(last)
