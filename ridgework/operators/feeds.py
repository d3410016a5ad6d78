"""Incident feeds: rows of several sources as one table; dates, levels and positions as they come."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id", "source", "state", "title", "category", "status", "level", "lng", "lat", "updated", "updated_raw", "size")
AU_DATE = r"(?i)(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?)?"


def warning_level(raw: Column) -> Column:
    """Level of a warning's text: the first of these words that it holds, in this order; without any, an incident."""
    s = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(F.contains(s, F.lit("emergency")), "emergency-warning").when(F.contains(s, F.lit("watch")), "watch-and-act").when(F.contains(s, F.lit("advice")), "advice").otherwise("incident")


def au_date(date: Column, time: Column | None = None) -> Column:
    """ISO time (UTC) of a day/month/year with an optional time, else that of ``time``; days and months beyond their range run on; null if there is none."""
    g = lambda i: F.regexp_extract(date, AU_DATE, i)
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    timed = g(4) != ""
    other = lambda i: number(F.regexp_extract(time, r"(\d{1,2}):(\d{2})", i)) if time is not None else F.lit(0)
    hour, half = number(g(4)), F.upper(g(7))
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    day = F.date_add(F.add_months(F.make_date(F.greatest(number(g(3)), F.lit(1)), F.lit(1), F.lit(1)), number(g(2)) - 1), number(g(1)) - 1)
    seconds = F.when(timed, hour * 3600 + number(g(5)) * 60 + number(g(6))).otherwise(other(1) * 3600 + other(2) * 60)
    at = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds)
    return F.when(F.coalesce(g(3), F.lit("")) != "", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.000Z'"))


def first_point(geometry: Column) -> Column:
    """[lng, lat] of a GeoJSON text: a point, the mean of a polygon's outer ring, the first of a collection; null of others."""
    kind = F.get_json_object(geometry, "$.type")
    point = lambda g: F.from_json(F.get_json_object(g, "$.coordinates"), "array<double>")
    ring = F.from_json(F.get_json_object(geometry, "$.coordinates[0]"), "array<array<double>>")
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[i]) / F.nullif(F.size(ring), F.lit(0))
    inner = F.from_json(F.get_json_object(geometry, "$.geometries"), "array<string>")
    of_inner = F.get(F.filter(F.transform(inner, lambda g: F.when(F.get_json_object(g, "$.type") == "Point", point(g))), lambda p: p.isNotNull()), F.lit(0))
    return F.when(kind == "Point", point(geometry)).when(kind == "Polygon", F.array(mean(0), mean(1))).when(kind == "GeometryCollection", of_inner)


def after(label: str, text: Column) -> Column:
    """What stands after ``label:`` up to the next tag; null without it."""
    found = F.regexp_extract(text, rf"(?i){label}:\s*([^<]+)", 1)
    return F.when(found != "", F.trim(found))


def nsw(rows: DataFrame) -> DataFrame:
    """rows: guid, title, category, description, pub_date, geometry."""
    r = rows.withColumn("p", first_point(F.col("geometry"))).filter("p IS NOT NULL")
    return r.select(
        F.concat(F.lit("nsw-"), F.coalesce("guid", "title")).alias("id"), F.lit("NSW RFS").alias("source"), F.lit("NSW").alias("state"), F.coalesce("title", F.lit("Incident")).alias("title"), F.coalesce("category", F.lit("Incident")).alias("category"),
        F.coalesce(after("STATUS", F.col("description")), F.lit("")).alias("status"), warning_level(after("ALERT LEVEL", F.col("description"))).alias("level"), F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"),
        au_date(F.col("pub_date")).alias("updated"), F.col("pub_date").alias("updated_raw"), after("SIZE", F.col("description")).alias("size"),
    )


def vic(rows: DataFrame) -> DataFrame:
    """rows: id, feed_type, name, category1, category2, status, updated, size, geometry; burn areas are left out."""
    r = rows.filter("coalesce(feed_type, '') <> 'burn-area'").withColumn("p", first_point(F.col("geometry"))).filter("p IS NOT NULL")
    return r.select(
        F.concat(F.lit("vic-"), "id").alias("id"), F.lit("VIC EMV").alias("source"), F.lit("VIC").alias("state"), F.coalesce("name", "category2", F.lit("Incident")).alias("title"), F.coalesce("category2", "category1", F.lit("Incident")).alias("category"),
        F.coalesce("status", F.lit("")).alias("status"), F.when(F.col("feed_type") == "warning", warning_level(F.col("category1"))).otherwise("incident").alias("level"), F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"),
        "updated", F.col("updated").alias("updated_raw"), "size",
    )


def sa(rows: DataFrame) -> DataFrame:
    """rows: no, name, type, status, location (lat,lng), date, time; rows without two numbers as location are left out."""
    xy = F.split("location", ",")
    r = rows.withColumn("lat", F.trim(F.get(xy, F.lit(0))).try_cast("double")).withColumn("lng", F.trim(F.get(xy, F.lit(1))).try_cast("double")).filter("lat IS NOT NULL AND lng IS NOT NULL")
    return r.select(
        F.concat(F.lit("sa-"), "no").alias("id"), F.lit("SA CFS").alias("source"), F.lit("SA").alias("state"), F.coalesce("name", F.lit("Incident")).alias("title"), F.coalesce("type", F.lit("Incident")).alias("category"), F.coalesce("status", F.lit("")).alias("status"),
        F.lit("incident").alias("level"), "lng", "lat", au_date(F.col("date"), F.col("time")).alias("updated"), F.nullif(F.concat_ws(" ", "date", "time"), F.lit("")).alias("updated_raw"), F.lit(None).cast("string").alias("size"),
    )


def _wa(rows: DataFrame, prefix: str, what: str, status: str, level: Column) -> DataFrame:
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    r = rows.withColumn("p", F.when(placed, F.array("longitude", "latitude")).otherwise(first_point(F.col("geometry")))).filter("p IS NOT NULL")
    return r.select(
        F.concat(F.lit(prefix), "id").alias("id"), F.lit("DFES (Emergency WA)").alias("source"), F.lit("WA").alias("state"), F.coalesce("name", F.lit(what)).alias("title"), F.coalesce("type", F.lit(what)).alias("category"),
        F.coalesce(status, F.lit("")).alias("status"), level.alias("level"), F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"), "updated", F.col("updated").alias("updated_raw"), F.lit(None).cast("string").alias("size"),
    )


def wa_incidents(rows: DataFrame) -> DataFrame:
    """rows: id, name, type, status, latitude, longitude, geometry (used where a number lacks), updated."""
    return _wa(rows, "wa-", "Incident", "status", F.lit("incident"))


def wa_warnings(rows: DataFrame) -> DataFrame:
    """The same with subtype, after whose ``--`` the level stands."""
    return _wa(rows, "wa-warn-", "Warning", "status", warning_level(F.replace(F.get(F.split("subtype", "--"), F.lit(1)), F.lit("-"), F.lit(" "))))


def act(rows: DataFrame) -> DataFrame:
    """rows: guid, title, type, description, point (lat lng between white space), pub_date, which is kept as it is; rows without two numbers as point are left out."""
    xy = F.split(F.trim("point"), r"\s+")
    r = rows.withColumn("lat", F.get(xy, F.lit(0)).try_cast("double")).withColumn("lng", F.get(xy, F.lit(1)).try_cast("double")).filter("lat IS NOT NULL AND lng IS NOT NULL")
    status = F.trim(F.regexp_extract(F.coalesce("description", F.lit("")), r"(?i)Status:\s*([^\r\n]+)", 1))
    return r.select(
        F.concat(F.lit("act-"), "guid").alias("id"), F.lit("ACT ESA").alias("source"), F.lit("ACT").alias("state"), F.coalesce(F.trim("title"), F.lit("Incident")).alias("title"), F.coalesce(F.trim("type"), F.lit("Incident")).alias("category"),
        status.alias("status"), F.lit("incident").alias("level"), "lng", "lat", F.lit(None).cast("string").alias("updated"), F.trim("pub_date").alias("updated_raw"), F.lit(None).cast("string").alias("size"),
    )


def union(*feeds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (f.select(*COLUMNS) for f in feeds))


def status(incidents: DataFrame, sources: dict[str, str], failed: dict[str, str]) -> DataFrame:
    """label, ok, count, error of each source (id to label), also of those that gave nothing or failed (id to message)."""
    spark = incidents.sparkSession
    known = spark.createDataFrame([(k, v, failed.get(k)) for k, v in sources.items()], "id string, label string, error string")  # a row a source
    n = incidents.groupBy(F.lower("state").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(known).join(n, "id", "left").select("id", "label", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("count"), "error")
