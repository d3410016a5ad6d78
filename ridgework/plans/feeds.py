"""Feeds, catalogue writes, telemetry and request limits over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import entities, feeds, graph
from ..sources import tables as t
from ..streaming import incidents, telemetry
from .lines import _VERT, vertices
from .registry import query

#: Feed texts made of an event's columns; s is the engine's name of a text type.
DATE = "concat(CAST(1 + n % 35 AS {s}), '/', CAST(1 + n % 14 AS {s}), '/', CAST(2020 + n % 6 AS {s}), CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' ', CAST(1 + n % 12 AS {s}), ':05:09 PM') WHEN 2 THEN concat(' ', CAST(n % 24 AS {s}), ':30') ELSE ' 12:15 am' END)"
GEOMETRY = (
    "CASE n % 5 WHEN 0 THEN concat('{{\"type\": \"Point\", \"coordinates\": [', CAST(149 + n % 7 AS {s}), '.5, -35.25]}}') WHEN 1 THEN concat('{{\"type\": \"GeometryCollection\", \"geometries\": [{{\"type\": \"LineString\", \"coordinates\": [[1, 2], [3, 4]]}}, "
    "{{\"type\": \"Point\", \"coordinates\": [', CAST(148 + n % 5 AS {s}), '.25, -34.5]}}]}}') WHEN 2 THEN concat('{{\"type\": \"Polygon\", \"coordinates\": [[[149, -35], [150, -35], [150, -34], [', CAST(149 + n % 3 AS {s}), ', -34]]]}}') WHEN 3 THEN '{{\"type\": \"LineString\", \"coordinates\": [[1, 2], [3, 4]]}}' END"
)
TEXT = {
    "date": DATE, "geometry": GEOMETRY, "description": "concat('ALERT LEVEL: ', CASE n % 5 WHEN 0 THEN 'Emergency Warning' WHEN 1 THEN 'Watch and Act' WHEN 2 THEN 'Advice' ELSE 'Planned' END, ' <br />STATUS: ', kind, ' <br />SIZE: ', CAST(n % 90 AS {s}), ' ha')",
}


def _event(engine: str) -> str:
    return f"(SELECT n, usr, kind, {', '.join(f'{e.format(s=engine)} AS {k}' for k, e in TEXT.items())} FROM (SELECT event_id AS n, user_id AS usr, event_type AS kind FROM events))"


_E = _event("VARCHAR")


def _events(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("event_id").alias("n"), F.col("user_id").alias("usr"), F.col("event_type").alias("kind"))
    return e.select("*", *(F.expr(x.format(s="STRING")).alias(k) for k, x in TEXT.items()))


def _level_sql(x: str) -> str:
    return f"CASE WHEN contains(lower(coalesce({x}, '')), 'emergency') THEN 'emergency-warning' WHEN contains(lower(coalesce({x}, '')), 'watch') THEN 'watch-and-act' WHEN contains(lower(coalesce({x}, '')), 'advice') THEN 'advice' ELSE 'incident' END"


def _date_sql(d: str) -> str:
    g = lambda i: f"coalesce(TRY_CAST(regexp_extract({d}, '{feeds.AU_DATE}', {i}) AS INTEGER), 0)"
    half = f"upper(regexp_extract({d}, '{feeds.AU_DATE}', 7))"
    hour = f"CASE WHEN {half} = 'PM' AND {g(4)} < 12 THEN {g(4)} + 12 WHEN {half} = 'AM' AND {g(4)} = 12 THEN 0 ELSE {g(4)} END"
    day = f"(CAST(make_date(greatest({g(3)}, 1), 1, 1) + to_months({g(2)} - 1) AS DATE) + CAST({g(1)} - 1 AS INTEGER))"
    return f"CASE WHEN {g(3)} > 0 THEN strftime(CAST({day} AS TIMESTAMP) + to_seconds(({hour}) * 3600 + {g(5)} * 60 + {g(6)}), '%Y-%m-%dT%H:%M:%S.000Z') END"


@query(f"SELECT n AS id, {_date_sql('date')} AS iso FROM {_E}")
def au_date_parse(spark, sf):
    """ISO times of day/month/year texts."""
    return _events(spark, sf).select(F.col("n").alias("id"), feeds.au_date(F.col("date")).alias("iso"))


_PT = """CASE WHEN g->>'$.type' = 'Point' THEN [CAST(g->>'$.coordinates[0]' AS DOUBLE), CAST(g->>'$.coordinates[1]' AS DOUBLE)]
  WHEN g->>'$.type' = 'Polygon' THEN [list_avg(list_transform(CAST(g->'$.coordinates[0]' AS DOUBLE[][]), lambda p: p[1])), list_avg(list_transform(CAST(g->'$.coordinates[0]' AS DOUBLE[][]), lambda p: p[2]))]
  WHEN g->>'$.type' = 'GeometryCollection' THEN [CAST(g->>'$.geometries[1].coordinates[0]' AS DOUBLE), CAST(g->>'$.geometries[1].coordinates[1]' AS DOUBLE)] END"""
_POINTS = f"(SELECT *, {_PT} AS p FROM (SELECT *, CAST(geometry AS JSON) AS g FROM {_E}))"


@query(f"SELECT n AS id, p[1] AS lng, p[2] AS lat FROM {_POINTS}")
def first_point(spark, sf):
    """A position of each geometry."""
    e = _events(spark, sf).withColumn("p", feeds.first_point(F.col("geometry")))
    return e.select(F.col("n").alias("id"), F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"))


_AFTER = "nullif(trim(regexp_extract(description, '(?i){}:\\s*([^<]+)', 1)), '')"
_NSW = f"SELECT concat('nsw-', CAST(n AS VARCHAR)) AS id, 'NSW RFS' AS source, 'NSW' AS state, kind AS title, 'Incident' AS category, coalesce({_AFTER.format('STATUS')}, '') AS status, {_level_sql(_AFTER.format('ALERT LEVEL'))} AS level, p[1] AS lng, p[2] AS lat, {_date_sql('date')} AS updated, date AS updated_raw, {_AFTER.format('SIZE')} AS size FROM {_POINTS} WHERE n % 3 = 0 AND p IS NOT NULL"
_VICT = "CASE n % 4 WHEN 0 THEN 'warning' WHEN 1 THEN 'burn-area' ELSE 'incident' END"
_VIC = f"SELECT concat('vic-', CAST(n AS VARCHAR)) AS id, 'VIC EMV' AS source, 'VIC' AS state, coalesce(CASE WHEN n % 2 = 0 THEN kind END, 'Fire') AS title, 'Fire' AS category, '' AS status, CASE WHEN n % 4 = 0 THEN {_level_sql(_AFTER.format('ALERT LEVEL'))} ELSE 'incident' END AS level, p[1] AS lng, p[2] AS lat, date AS updated, date AS updated_raw, NULL AS size FROM {_POINTS} WHERE n % 3 = 1 AND n % 4 <> 1 AND p IS NOT NULL"
_SA = "SELECT concat('sa-', CAST(n AS VARCHAR)) AS id, 'SA CFS' AS source, 'SA' AS state, kind AS title, 'Incident' AS category, 'Going' AS status, 'incident' AS level, 138.5 + (n % 9)::DOUBLE AS lng, -34.5 AS lat, " + _date_sql("d") + " AS updated, concat(d, ' ', '09:41') AS updated_raw, NULL AS size FROM (SELECT n, kind, regexp_extract(date, '^[^ ]+', 0) AS d FROM " + _E + ") WHERE n % 3 = 2 AND n % 7 <> 0"
_SA = _SA.replace("to_seconds((", "to_seconds(9 * 3600 + 41 * 60 + (")


def _nsw(spark, sf):
    e = _events(spark, sf).filter("n % 3 = 0")
    return feeds.nsw(e.select(F.col("n").cast("string").alias("guid"), F.col("kind").alias("title"), F.lit(None).cast("string").alias("category"), "description", F.col("date").alias("pub_date"), "geometry"))


def _vic(spark, sf):
    e = _events(spark, sf).filter("n % 3 = 1")
    return feeds.vic(e.select(F.col("n").cast("string").alias("id"), F.expr(_VICT).alias("feed_type"), F.expr("CASE WHEN n % 2 = 0 THEN kind END").alias("name"), feeds.after("ALERT LEVEL", F.col("description")).alias("category1"), F.lit("Fire").alias("category2"), F.lit(None).cast("string").alias("status"), F.col("date").alias("updated"), F.lit(None).cast("string").alias("size"), "geometry"))


def _sa(spark, sf):
    e = _events(spark, sf).filter("n % 3 = 2")
    return feeds.sa(e.select(F.col("n").cast("string").alias("no"), F.col("kind").alias("name"), F.lit(None).cast("string").alias("type"), F.lit("Going").alias("status"), F.expr("CASE WHEN n % 7 = 0 THEN 'near town' ELSE concat('-34.5, ', CAST(138.5D + n % 9 AS STRING)) END").alias("location"), F.regexp_extract("date", "^[^ ]+", 0).alias("date"), F.lit("09:41").alias("time")))


_FEEDS = f"({_NSW} UNION ALL {_VIC} UNION ALL {_SA})"


@query(f"SELECT {', '.join(feeds.COLUMNS)} FROM {_FEEDS}")
def feed_union(spark, sf):
    """Incidents of three feeds as one table."""
    return feeds.union(_nsw(spark, sf), _vic(spark, sf), _sa(spark, sf))


_SOURCES = {"nsw": "NSW RFS", "vic": "VIC (EMV)", "sa": "SA CFS", "wa": "WA DFES", "act": "ACT ESA"}


@query(f"SELECT id, label, id <> 'act' AS ok, coalesce(n, 0) AS count, CASE WHEN id = 'act' THEN 'HTTP 503' END AS error FROM (SELECT * FROM (VALUES {', '.join(f"('{k}', '{x}')" for k, x in _SOURCES.items())}) AS s(id, label)) LEFT JOIN (SELECT lower(state) AS st, count(*) AS n FROM {_FEEDS} GROUP BY state) ON st = id")
def feed_status(spark, sf):
    """What each feed gave; one gave nothing, one failed."""
    return feeds.status(feed_union(spark, sf), _SOURCES, {"act": "HTTP 503"})


_IP = "CASE n % 4 WHEN 0 THEN concat('10.0.', CAST(usr % 9 AS {s}), '.7:443, 172.16.0.1') WHEN 1 THEN concat('  192.168.1.', CAST(usr % 200 AS {s}), ' ') WHEN 2 THEN ':80' END"


@query(f"SELECT n AS id, CASE WHEN fwd IS NULL THEN 'unknown' ELSE coalesce(nullif(regexp_replace(trim(split_part(fwd, ',', 1)), ':\\d+$', ''), ''), 'unknown') END AS ip FROM (SELECT n, {_IP.format(s='VARCHAR')} AS fwd FROM {_E})")
def client_ip(spark, sf):
    """The first hop of forwarded requests without its port."""
    e = _events(spark, sf).select("n", F.expr(_IP.format(s="STRING")).alias("fwd"))
    return e.select(F.col("n").alias("id"), F.coalesce(F.nullif(F.regexp_replace(F.trim(F.split_part("fwd", F.lit(","), F.lit(1))), r":\d+$", ""), F.lit("")), F.lit("unknown")).alias("ip"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS clients, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def telemetry_daily(spark, sf):
    return telemetry.daily(t.table(spark, sf, "events"))


LIMIT, WINDOW_S = 3, 6 * 3600


@query(f"""
WITH RECURSIVE e AS (SELECT event_id, user_id AS k, ts FROM events),
w(k, start) AS (SELECT k, min(ts) FROM e GROUP BY k UNION ALL SELECT w.k, (SELECT min(ts) FROM e WHERE e.k = w.k AND e.ts >= w.start + INTERVAL {WINDOW_S} SECOND) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.k = w.k AND e.ts >= w.start + INTERVAL {WINDOW_S} SECOND))
SELECT event_id, count <= {LIMIT} AS allowed, greatest(0, {LIMIT} - count) AS remaining, CAST(greatest(1, ceil(({WINDOW_S} * 1000000::BIGINT - (epoch_us(ts) - epoch_us(start))) / 1e6)) AS BIGINT) AS retry_after_s
FROM (SELECT event_id, ts, start, row_number() OVER (PARTITION BY e.k, start ORDER BY ts, event_id) AS count FROM e ASOF JOIN w ON e.k = w.k AND e.ts >= w.start)""")
def rate_limit(spark, sf):
    """Requests of each client in windows that open at the first hit after the last has ended: which are allowed."""
    e = t.table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("key"), "ts")
    return telemetry.limited(e, LIMIT, WINDOW_S)


_ENT = "(SELECT p_partkey AS id, CAST(1 + p_size % 3 AS BIGINT) AS version, p_partkey % 9 = 0 AS standard FROM part)"
_UPD = "(SELECT event_id % 2500 AS id, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN CAST(1 + event_id % 4 AS BIGINT) END AS expected FROM events)"


@query(f"""
WITH RECURSIVE u AS (SELECT u.id, u.seq, u.expected, e.version, e.standard, e.id IS NULL AS gone, row_number() OVER (PARTITION BY u.id ORDER BY seq) AS k FROM {_UPD} AS u LEFT JOIN {_ENT} AS e ON e.id = u.id),
s AS (SELECT id, seq, k, CASE WHEN gone THEN 404 WHEN standard OR expected <> version THEN 409 ELSE 200 END AS status, CASE WHEN gone OR standard OR expected <> version THEN version ELSE version + 1 END AS version FROM u WHERE k = 1
  UNION ALL SELECT u.id, u.seq, u.k, CASE WHEN gone THEN 404 WHEN standard OR expected <> s.version THEN 409 ELSE 200 END, CASE WHEN gone OR standard OR expected <> s.version THEN s.version ELSE s.version + 1 END FROM s JOIN u ON u.id = s.id AND u.k = s.k + 1)
SELECT id, seq, CAST(status AS INTEGER) AS status, version FROM s""")
def upsert_versions(spark, sf):
    """Updates against versions, in order."""
    upd = t.table(spark, sf, "events").select((F.col("event_id") % 2500).alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, 1 + F.col("event_id") % 4).alias("expected"))
    return entities.updated(t.derived(spark, sf, "part", {"id": "p_partkey", "version": "CAST(1 + p_size % 3 AS BIGINT)", "standard": "p_partkey % 9 = 0"}), upd)


@query("SELECT id, seq, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY seq) = 1 AND id NOT IN (SELECT p_partkey FROM part) THEN 201 ELSE 409 END AS status FROM (SELECT event_id % 4000 AS id, event_id AS seq FROM events)")
def insert_new(spark, sf):
    """Inserts of ids that may be there."""
    ins = t.table(spark, sf, "events").select((F.col("event_id") % 4000).alias("id"), F.col("event_id").alias("seq"))
    return entities.inserted(t.table(spark, sf, "part").select(F.col("p_partkey").alias("id")), ins)


_BASE = {"id": "p_partkey", "rate": "CASE WHEN p_size % 4 > 0 THEN p_retailprice END", "max_slope": "p_size * 0.5e0", "active": "p_size % 2 = 0"}
_PATCH = "CASE id % 5 WHEN 0 THEN '{\"rate\": 12.5, \"bogus\": 1}' WHEN 1 THEN '{\"active\": true, \"max_slope\": null}' WHEN 2 THEN '{not json' WHEN 3 THEN concat('{\"max_slope\": ', CAST(id % 40 AS STRING), '}') END"
_B = t.derived_sql("part", _BASE)
_PATCHED = f"""(SELECT id, CASE WHEN json_exists(j, '$.rate') THEN CAST(j->>'$.rate' AS DOUBLE) ELSE rate END AS rate, CASE WHEN json_exists(j, '$.max_slope') THEN CAST(j->>'$.max_slope' AS DOUBLE) ELSE max_slope END AS max_slope, CASE WHEN json_exists(j, '$.active') THEN CAST(j->>'$.active' AS BOOLEAN) ELSE active END AS active
  FROM (SELECT *, TRY_CAST({_PATCH.replace('STRING', 'VARCHAR')} AS JSON) AS j FROM {_B}))"""


def _patched(spark, sf):
    base = t.derived(spark, sf, "part", _BASE)
    return base, entities.patched(base, base.select("id", F.expr(_PATCH).alias("fields")).filter("fields IS NOT NULL"))


@query(f"SELECT id, rate, max_slope, active FROM {_PATCHED}")
def equip_override_patch(spark, sf):
    """Catalogue rows with users' sparse patches."""
    return _patched(spark, sf)[1]


@query(f"SELECT b.id, concat_ws(',', CASE WHEN b.rate IS DISTINCT FROM p.rate THEN 'rate' END, CASE WHEN b.max_slope IS DISTINCT FROM p.max_slope THEN 'max_slope' END, CASE WHEN b.active IS DISTINCT FROM p.active THEN 'active' END) AS fields FROM {_B} AS b JOIN {_PATCHED} AS p ON p.id = b.id")
def equip_override_diff(spark, sf):
    """The fields in which patched rows differ from their base."""
    return entities.differing(*_patched(spark, sf))


@query("SELECT p_partkey, p_type FROM part WHERE p_type = 'LARGE' OR p_partkey = 7")
def kv_lookup(spark, sf):
    """Rows of one partition, and one row by its key: filters that reach the scan."""
    return t.table(spark, sf, "part").filter("p_type = 'LARGE' OR p_partkey = 7").select("p_partkey", "p_type")


@query("SELECT cell, count(*) AS routes FROM (SELECT DISTINCT l_orderkey AS route, l_partkey % 500 AS cell FROM lineitem) GROUP BY cell")
def chokepoints(spark, sf):
    """How many routes pass each cell."""
    return t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), (F.col("l_partkey") % 500).alias("cell")).distinct().groupBy("cell").agg(F.count(F.lit(1)).alias("routes"))


@query("SELECT event_type, max(CASE WHEN i = floor((n - 1) * 0.1e0 + 0.5) THEN value END) AS p10, max(CASE WHEN i = floor((n - 1) * 0.5e0 + 0.5) THEN value END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.9e0 + 0.5) THEN value END) AS p90 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def percentile_pick(spark, sf):
    """Values at rounded ranks, not interpolated.  Equal values are counted first, and a type's values are ranked over many tasks."""
    c = t.table(spark, sf, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    n = c.groupBy("event_type").agg(F.sum("c").alias("n"))
    c = graph.running(c, ["value"], F.col("c"), "start", ["event_type"]).join(n, "event_type")
    rank = lambda p: F.floor((F.col("n") - 1) * F.lit(p) + 0.5)
    at = lambda p: F.max(F.when((F.col("start") <= rank(p)) & (rank(p) < F.col("start") + F.col("c")), F.col("value")))
    return c.groupBy("event_type").agg(at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


@query("SELECT a, b, round(product(1 + l_discount), 6) AS penalty FROM (SELECT l_suppkey % 60 AS a, l_partkey % 60 AS b, l_discount FROM lineitem UNION ALL SELECT l_partkey % 60, l_suppkey % 60, l_discount FROM lineitem) GROUP BY a, b HAVING count(*) < 40")
def penalty_product(spark, sf):
    """Penalties of measures placed on edges, multiplied, in both directions."""
    p = t.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 60).alias("x"), (F.col("l_partkey") % 60).alias("y"), "l_discount")
    p = p.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("e"), "l_discount")
    return p.groupBy("e.a", "e.b").agg(F.product(1 + F.col("l_discount")).alias("p"), F.count(F.lit(1)).alias("n")).filter("n < 40").select("a", "b", F.round("p", 6).alias("penalty"))


@query(f"SELECT plan, round(abs(sum(lng * nlat - nlng * lat)) / 2 * 1e8, 4) AS area FROM (SELECT *, coalesce(lead(lat) OVER w, first_value(lat) OVER w) + 35 AS nlat, coalesce(lead(lng) OVER w, first_value(lng) OVER w) - 149 AS nlng FROM (SELECT plan, seq, lat, lng FROM {_VERT}) WINDOW w AS (PARTITION BY plan ORDER BY seq)) CROSS JOIN (SELECT 1) WHERE true GROUP BY plan".replace("sum(lng * nlat - nlng * lat)", "sum((lng - 149) * nlat - nlng * (lat + 35))"))
def ring_area(spark, sf):
    """Area of each line closed to a ring, by the shoelace, in 1e-8 square degrees."""
    w = Window.partitionBy("plan").orderBy("seq")
    v = vertices(spark, sf).select("plan", "seq", (F.col("lat") + 35).alias("y"), (F.col("lng") - 149).alias("x"))
    v = v.select("plan", "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(w)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(w)).alias("y2"))
    return v.groupBy("plan").agg(F.round(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2 * 1e8, 4).alias("area"))


@query("SELECT p_partkey AS id, round(-10000 + ((p_partkey % 4) * 65536 + (p_size * 5) * 256 + p_partkey % 256) * 0.1e0, 4) AS elev FROM part")
def terrain_rgb(spark, sf):
    """Heights from the colours of a terrain tile."""
    r, g, b = F.col("p_partkey") % 4, F.col("p_size") * 5, F.col("p_partkey") % 256
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(-10000 + (r * 65536 + g * 256 + b) * F.lit(0.1), 4).alias("elev"))


_SLIP = "(SELECT id, (lng + 180) / 360 * 32768 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768 AS y FROM (SELECT c_custkey AS id, -35.0e0 + (c_custkey % 211) * 0.0137e0 AS lat, 149.0e0 + (c_custkey % 307) * 0.0113e0 AS lng FROM customer))"


@query(f"SELECT id, CAST(floor(x) AS INTEGER) AS tile_x, CAST(floor(y) AS INTEGER) AS tile_y, CAST(floor((x - floor(x)) * 256) AS INTEGER) AS pixel_x, CAST(floor((y - floor(y)) * 256) AS INTEGER) AS pixel_y FROM {_SLIP}")
def slippy_tile(spark, sf):
    """Web map tile and pixel of each position at zoom 15."""
    p = t.derived(spark, sf, "customer", {"id": "c_custkey", "lat": "-35.0e0 + (c_custkey % 211) * 0.0137e0", "lng": "149.0e0 + (c_custkey % 307) * 0.0113e0"})
    p = p.select("id", F.expr("(lng + 180) / 360 * 32768").alias("x"), F.expr("(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768").alias("y"))
    whole = lambda c: F.floor(c).cast("int")
    return p.select("id", whole("x").alias("tile_x"), whole("y").alias("tile_y"), whole((F.col("x") - F.floor("x")) * 256).alias("pixel_x"), whole((F.col("y") - F.floor("y")) * 256).alias("pixel_y"))


_BOXES = {"id": "s_suppkey", "x0": "149e0 + (s_suppkey % 7) * 0.13e0", "y0": "-35e0 - (s_suppkey % 5) * 0.17e0", "x1": "149e0 + (s_suppkey % 7) * 0.13e0 + (s_suppkey % 11) * 0.31e0", "y1": "-35e0 + (s_suppkey % 13) * 0.11e0"}
_TB = f"(SELECT *, floor(x0 / 0.5e0) AS tx0, floor(x1 / 0.5e0) AS tx1, floor(y0 / 0.5e0) AS ty0, floor(y1 / 0.5e0) AS ty1 FROM {t.derived_sql('supplier', _BOXES)})"


@query(f"SELECT id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty FROM {_TB} CROSS JOIN (SELECT unnest(range(-100, 400)) AS tx) CROSS JOIN (SELECT unnest(range(-100, 20)) AS ty) WHERE tx BETWEEN tx0 AND tx1 AND ty BETWEEN ty0 AND ty1 AND (tx1 - tx0 + 1) * (ty1 - ty0 + 1) <= 12")
def tiles_covering(spark, sf):
    """Half-degree tiles of each box, none for boxes that need more than twelve."""
    b = t.derived(spark, sf, "supplier", _BOXES)
    b = b.select("id", *(F.floor(F.col(c) / 0.5).cast("int").alias(f"t{c}") for c in ("x0", "x1", "y0", "y1")))
    b = b.filter("(tx1 - tx0 + 1) * (ty1 - ty0 + 1) <= 12")
    return b.withColumn("tx", F.explode(F.sequence("tx0", "tx1"))).withColumn("ty", F.explode(F.sequence("ty0", "ty1"))).select("id", "tx", "ty")


_RS = f"(SELECT plan, d, cos(radians(lat)) AS unused, CASE WHEN d = 0 THEN 0 ELSE degrees(atan(abs(greatest(0.0, 100 + sin(0.07 * lat) * 120 + cos(0.05 * lng) * 80) - greatest(0.0, 100 + sin(0.07 * y0) * 120 + cos(0.05 * x0) * 80)) / d)) END AS s FROM {_VERT} WHERE seq > 0)"


@query(f"SELECT plan, round(sum(d), 3) AS distance_m, round(max(s), 6) AS max_slope, round(coalesce(sum(s * d) / nullif(sum(d), 0), 0), 6) AS mean_slope, round(sum(CASE WHEN s >= 25 THEN d ELSE 0 END), 3) AS steep_m FROM {_RS} GROUP BY plan")
def route_stats(spark, sf):
    """Distance, slopes and steep metres of each line."""
    from ..operators import linear

    s = linear.track_slopes(t.derived(spark, sf, "lineitem", t.POINT))
    return s.groupBy("plan").agg(F.round(F.sum("dist_m"), 3).alias("distance_m"), F.round(F.max("slope"), 6).alias("max_slope"), F.expr("round(coalesce(sum(slope * dist_m) / nullif(sum(dist_m), 0e0), 0e0), 6)").alias("mean_slope"), F.round(F.sum(F.when(F.col("slope") >= 25, F.col("dist_m")).otherwise(0.0)), 3).alias("steep_m"))


# WA rows are placed by numbers where they have them, else by geometry; ACT rows by a text of two numbers, which some lack.
_WEST = {"latitude": "CASE WHEN n % 3 <> 1 THEN -31.5e0 - n % 4 END", "longitude": "CASE WHEN n % 5 <> 2 THEN 115.25e0 + n % 6 END", "subtype": "CASE n % 4 WHEN 0 THEN 'warnings_bushfire--emergency-warning' WHEN 1 THEN 'warnings_bushfire--watch-and-act' WHEN 2 THEN 'warnings_flood' END"}
_WEST_SQL = f"(SELECT *, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN [longitude, latitude] ELSE p END AS place FROM (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _WEST.items())} FROM {_POINTS}))"
_ACT = {"point": "CASE n % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE concat(' -35.', CAST(n % 9 AS {s}), '  149.', CAST(n % 7 AS {s}), ' ') END", "told": "CASE n % 4 WHEN 0 THEN concat('Agency: x', chr(10), 'STATUS: on scene ', chr(13), chr(10), 'Units: 3') WHEN 1 THEN 'none' END"}
_NO = "CAST(NULL AS VARCHAR)"


@query(f"""
SELECT concat('wa-', CAST(n AS VARCHAR)) AS id, 'DFES (Emergency WA)' AS source, 'WA' AS state, coalesce(CASE WHEN n % 2 = 0 THEN kind END, 'Incident') AS title, 'Incident' AS category, 'Active' AS status, 'incident' AS level, place[1] AS lng, place[2] AS lat, date AS updated, date AS updated_raw, {_NO} AS size FROM {_WEST_SQL} WHERE n % 3 <> 2 AND place IS NOT NULL
UNION ALL SELECT concat('wa-warn-', CAST(n AS VARCHAR)), 'DFES (Emergency WA)', 'WA', kind, 'Warning', '', CASE WHEN n % 4 = 0 THEN 'emergency-warning' WHEN n % 4 = 1 THEN 'watch-and-act' ELSE 'incident' END, place[1], place[2], date, date, {_NO} FROM {_WEST_SQL} WHERE n % 3 = 2 AND place IS NOT NULL
UNION ALL SELECT concat('act-', CAST(n AS VARCHAR)), 'ACT ESA', 'ACT', kind, 'Incident', CASE WHEN n % 4 = 0 THEN 'on scene' ELSE '' END, 'incident', CAST(regexp_extract(point, '149[.][0-9]+') AS DOUBLE), CAST(regexp_extract(point, '-35[.][0-9]+') AS DOUBLE), {_NO}, date, {_NO} FROM (SELECT *, {_ACT['point'].format(s='VARCHAR')} AS point FROM {_E}) WHERE n % 6 > 1""")
def feed_west_act(spark, sf):
    """Incidents and warnings of WA and incidents of ACT as one table."""
    e = _events(spark, sf)
    west = e.select("*", *(F.expr(x).alias(k) for k, x in _WEST.items())).select(F.col("n").cast("string").alias("id"), "n", "kind", F.lit(None).cast("string").alias("type"), "latitude", "longitude", "geometry", "subtype", F.col("date").alias("updated"))
    incidents = west.filter("n % 3 <> 2").withColumn("name", F.expr("CASE WHEN n % 2 = 0 THEN kind END")).withColumn("status", F.lit("Active"))
    warnings = west.filter("n % 3 = 2").withColumn("name", F.col("kind")).withColumn("status", F.lit(None).cast("string"))
    act = e.select(F.col("n").cast("string").alias("guid"), F.col("kind").alias("title"), F.lit(None).cast("string").alias("type"), F.expr(_ACT["told"]).alias("description"), F.expr(_ACT["point"].format(s="STRING")).alias("point"), F.col("date").alias("pub_date"))
    return feeds.union(feeds.wa_incidents(incidents), feeds.wa_warnings(warnings), feeds.act(act))


# Each event is what a poll gave of an incident: it may be given again by the next poll, unchanged.
_POLL = {"id": "concat('i-', CAST(user_id % 97 AS {s}))", "source": "concat('s', CAST(user_id % 97 % 5 AS {s}))", "level": "CASE event_id % 4 WHEN 0 THEN 'advice' WHEN 1 THEN 'watch-and-act' ELSE 'incident' END", "title": "event_type"}
_POLLS = f"(SELECT event_id, date_trunc('hour', ts) AS updated, date_trunc('day', ts) + INTERVAL 1 DAY AS polled, {', '.join(f'{e.format(s='VARCHAR')} AS {k}' for k, e in _POLL.items())} FROM events)"


def polls(spark, sf):
    e = t.table(spark, sf, "events")
    return e.select("event_id", F.date_trunc("hour", "ts").alias("updated"), (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).alias("polled"), *(F.expr(x.format(s="STRING")).alias(k) for k, x in _POLL.items()))


@query(f"SELECT id, source, updated, level, title, versions FROM (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY updated DESC, level DESC, title DESC) AS k, count(*) OVER (PARTITION BY id, source) AS versions FROM (SELECT id, any_value(source) AS source, updated, max((level, title))[1] AS level, max((level, title))[2] AS title FROM {_POLLS} GROUP BY id, updated)) WHERE k = 1")
def incident_latest(spark, sf):
    """The latest version of each polled incident."""
    # which of several rows of one version stays is decided here, so that any engine finds the same
    one = polls(spark, sf).groupBy("id", "source", "updated").agg(F.max(F.struct("level", "title")).alias("v")).select("id", "source", "updated", "v.level", "v.title")
    return incidents.latest(one)


@query(f"SELECT source, polled, count(*) AS incidents, max(updated) AS newest FROM {_POLLS} GROUP BY ALL")
def incident_polls(spark, sf):
    """What each poll of a source gave."""
    return incidents.given(polls(spark, sf))
