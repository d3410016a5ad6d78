"""Plans written as files of several formats, and read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.text import number_text
from ..sources import gis_files
from ..sources.shared import fresh_folder
from .lines import _VERT, vertices
from .registry import query

#: Plans of a file: those of so many numbers in a row.
PER_FILE = 2000
_GROUP, _FORMAT = f"CAST(floor(plan / {PER_FILE}.0e0) AS INTEGER)", "CASE CAST(floor(plan / {per}.0e0) AS INTEGER) % 4 WHEN 0 THEN 'kml' WHEN 1 THEN 'gpx' WHEN 2 THEN 'geojson' ELSE 'kmz' END".format(per=PER_FILE)


def _joined(parts: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.col(parts)), lambda x: x["p"]), by)


def documents(spark, sf):
    """file, content: the plans of a range of numbers in one document; plans of three vertices and more are polygons where the format has them, if their number is divisible by three."""
    v = vertices(spark, sf).select("plan", "seq", number_text(F.col("lat")).alias("lat"), number_text(F.col("lng")).alias("lng"))
    lat, lng = F.col("lat"), F.col("lng")
    v = v.withColumn("tuple", F.concat(lng, F.lit(","), lat, F.lit(",0"))).withColumn("pair", F.concat(F.lit("["), lng, F.lit(", "), lat, F.lit("]")))
    point = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("<trkpt lon='"), lng, F.lit("' lat=\""), lat, F.lit("\"/>"))).otherwise(F.concat(F.lit('<trkpt lat="'), lat, F.lit('" lon="'), lng, F.lit('"><ele>0</ele></trkpt>')))
    ending = F.expr(_FORMAT)
    # each vertex in its file's form only; a plan's vertices are bounded, and so is a range of plans
    form = F.when(ending == "gpx", point).when(ending == "geojson", F.col("pair")).otherwise(F.col("tuple"))
    one = v.select("plan", "seq", form.alias("p")).groupBy("plan").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("seq", "p"))).alias("points"))
    one = one.withColumn("ending", ending).withColumn("points", F.transform("points", lambda x: x["p"]))
    points, first = lambda by: F.array_join("points", by), F.get("points", F.lit(0))
    ring = (F.col("n") >= 3) & (F.col("plan") % 3 == 0)
    name = F.concat(F.lit("plan <"), F.col("plan").cast("string"), F.lit("> & more"))
    escaped = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tuples, pairs = points(" "), points(", ")
    shape = F.when(ring, F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), tuples, F.lit(" "), first, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))).otherwise(F.concat(F.lit("<LineString><tessellate>1</tessellate><coordinates>"), tuples, F.lit("</coordinates></LineString>")))
    kml = F.concat(F.lit("<Placemark><name>"), escaped, F.lit("</name><description><![CDATA[<p>a & b</p>]]></description>"), shape, F.lit("</Placemark>"))
    gpx = F.concat(F.lit("<trk><name>"), escaped, F.lit("</name><trkseg>"), points("\n"), F.lit("</trkseg></trk>"))
    geometry = F.when(ring, F.concat(F.lit('"Polygon", "coordinates": [['), pairs, F.lit(", "), first, F.lit("]]"))).otherwise(F.concat(F.lit('"LineString", "coordinates": ['), pairs, F.lit("]")))
    geojson = F.concat(F.lit('{"type": "Feature", "properties": {"name": "'), name, F.lit('"}, "geometry": {"type": '), geometry, F.lit("}}"))
    one = one.withColumn("p", F.when(F.col("ending") == "gpx", gpx).when(F.col("ending") == "geojson", geojson).otherwise(kml))
    all_ = one.groupBy(F.expr(_GROUP).alias("part"), "ending").agg(F.collect_list(F.struct("plan", "p")).alias("all"))
    body = F.when(F.col("ending") == "gpx", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1"><metadata><name>plans</name></metadata>'), _joined("all", "\n"), F.lit("</gpx>")))
    body = body.when(F.col("ending") == "geojson", F.concat(F.lit('{"type": "FeatureCollection", "features": ['), _joined("all", ",\n"), F.lit("]}")))
    body = body.otherwise(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>plans</name><Folder>'), _joined("all", "\n"), F.lit("</Folder></Document></kml>")))
    return all_.select(F.concat(F.lit("plans-"), F.col("part").cast("string"), F.lit("."), "ending").alias("file"), body.alias("content"))


@query(f"""
SELECT concat('plans-', {_GROUP}, '.', {_FORMAT}) AS file, concat('plan <', plan, '> & more') AS name, CASE WHEN ring THEN 'polygon' ELSE 'line' END AS kind, CAST(k + CASE WHEN ring THEN 1 ELSE 0 END AS INTEGER) AS points,
       round(s + CASE WHEN ring THEN (k + 1) * (lat0 + 36) ELSE 0 END, 6) AS order_lat, round(t + CASE WHEN ring THEN (k + 1) * (lng0 - 148) ELSE 0 END, 6) AS order_lng
FROM (SELECT plan, count(*) AS k, count(*) >= 3 AND plan % 3 = 0 AND {_FORMAT} <> 'gpx' AS ring, sum((seq + 1) * (lat + 36)) AS s, sum((seq + 1) * (lng - 148)) AS t, arg_min(lat, seq) AS lat0, arg_min(lng, seq) AS lng0 FROM {_VERT} GROUP BY plan) WHERE k >= 2""")
def gis_roundtrip(spark, sf):
    """Plans as KML, KMZ, GPX and GeoJSON files in the shared folder, and the lines and polygons that are read back from them."""
    folder = fresh_folder(spark, "gis")
    written = gis_files.write_files(documents(spark, sf), folder)
    written.agg(F.sum("bytes")).first()  # the files are there now
    found = gis_files.read_gis(spark, folder).filter("error IS NULL")
    total = lambda c, less: F.round(F.aggregate(F.transform(F.col("rings")[0], lambda p, i: (i + 1) * (p[c] - less)), F.lit(0.0), lambda a, x: a + x), 6)
    return found.select("file", "name", "kind", F.size(F.col("rings")[0]).alias("points"), total("lat", -36).alias("order_lat"), total("lng", 148).alias("order_lng"))
