"""Cases by hand: what plans, grids, feeds and streams do at their edges."""

import datetime
import tempfile

import pytest
from pyspark.sql import functions as F

from ridgework.operators import entities, evaluation, feeds, grid, linear, spatial, text
from ridgework.streaming import telemetry

SEGMENT = "plan long, len double, slope double, side double, veg string, water boolean, conf double"
DOZER = ("dozer", "Machinery", 1000.0, 100.0, 3.0, 25.0, None, "flat,medium", "grassland,lightshrub", None, None, None)
FREE = ("free", "Machinery", 900.0, None, 3.0, 25.0, None, "flat,medium", "grassland,lightshrub", None, None, None)


def evaluated(spark, rows, *resources, width=3.0):
    segments = spark.createDataFrame(rows, SEGMENT)
    return {(r["plan"], r["resource"]): r for r in evaluation.evaluate_lines(segments, resources or (DOZER,), width).collect()}


def test_gates_and_levels(spark):
    rows = [
        (1, 900.0, 5.0, 0.0, "grassland", False, 0.8), (1, 100.0, 40.0, 0.0, "grassland", False, 0.6),  # a tenth too steep
        (2, 500.0, 5.0, 0.0, "heavyforest", False, 0.8), (2, 500.0, 5.0, 0.0, "grassland", False, 0.8),  # half in fuel that isn't allowed
        (3, 1000.0, 5.0, 30.0, "grassland", False, 0.8),  # all on a side slope
        (4, 800.0, 80.0, 80.0, "heavyforest", True, 0.1),  # water alone
        (5, 1000.0, 25.0, 24.0, "grassland", False, None),  # at the limits, not over them
    ]
    got = evaluated(spark, rows)
    assert [got[i, "dozer"]["level"] for i in range(1, 6)] == ["partial", "incompatible", "incompatible", "full", "full"]
    one = got[1, "dozer"]
    hours = (900 / (1000 * 0.975) + 100 / (1000 * 0.35)) * (1 + 2 * 0.1)  # slope factors of 5 and 40 degrees
    assert one["hours"] == pytest.approx(hours) and one["cost"] == pytest.approx(100 * hours, rel=1e-6) and one["over_share"] == 0.1 and one["max_slope_exceeded"] == 40.0
    assert one["note"] == "~10% of route over limits; time penalty applied" and one["confidence"] == pytest.approx(0.78)
    assert got[2, "dozer"]["hours"] == 0 == got[2, "dozer"]["cost"] and got[2, "dozer"]["max_slope_exceeded"] is None
    assert got[3, "dozer"]["max_side_exceeded"] == 30.0 and "sidehill steeper than 24°" in got[3, "dozer"]["note"]
    assert (got[4, "dozer"]["total_m"], got[4, "dozer"]["hours"], got[4, "dozer"]["cost"], got[4, "dozer"]["confidence"]) == (0, 0, 0, None)
    wide = evaluated(spark, rows, width=9.5)[5, "dozer"]
    assert wide["passes"] == 4 and wide["note"] == "4 passes for 10m break" and wide["hours"] == pytest.approx(got[5, "dozer"]["hours"] * (1 + 3 * 0.85))


def test_a_machine_without_a_price_is_recommended(spark):
    rows = evaluation.recommend(evaluation.evaluate_lines(spark.createDataFrame([(1, 1000.0, 0.0, 0.0, "grassland", False, 1.0)], SEGMENT), (DOZER, FREE), 3.0)).collect()
    assert {r["resource"]: (r["recommended"], r["note"]) for r in rows} == {"free": (True, "Cost-optimised selection"), "dozer": (False, "$100 more than cost-optimised choice")}


POINT = "plan long, line long, part long, supp long, price double, len double, slope double, lat double, lng double"


def vertices(spark, *plans):
    rows = [(p, i, 0, 0, 0.0, 0.0, 0.0, lat, lng) for p, pts in enumerate(plans) for i, (lat, lng) in enumerate(pts)]
    return linear.vertices(spark.createDataFrame(rows, POINT))


def test_lines_of_one_vertex_and_repeated_ones(spark):
    v = vertices(spark, [(-35.0, 149.0)], [(-35.0, 149.0), (-35.0, 149.0), (-35.0, 149.01)])
    at = {(r["plan"], r["k"]): (r["lat"], round(r["lng"], 6)) for r in linear.points_at(v, F.array(F.lit(-5.0), F.lit(1e9))).collect()}
    assert at == {(0, 0): (-35.0, 149.0), (0, 1): (-35.0, 149.0), (1, 0): (-35.0, 149.0), (1, 1): (-35.0, 149.01)}
    dense = linear.densify(v).filter("plan = 1").orderBy("seq", "j").collect()
    gaps = [(b["lng"] - a["lng"]) for a, b in zip(dense, dense[1:])]
    assert len(dense) == 1 + 10 and all(g > 0 for g in gaps)  # 911 m: nine points and the end
    assert {r["plan"] for r in linear.slices(v, F.lit(10.0), F.lit(10.0)).collect()} == {0, 1}


def test_overlay_leaves_out_slivers(spark):
    a = spark.createDataFrame([(1, 0.0, 100.0, "x"), (1, 100.0, 200.0, "y")], "plan long, start_m double, end_m double, a string")
    b = spark.createDataFrame([(1, 0.0, 100.4, "p"), (1, 100.4, 200.0, "q")], "plan long, start_m double, end_m double, b string")
    got = [tuple(r) for r in linear.overlay(a, b).orderBy("start_m").collect()]
    assert got == [(1, 0.0, 100.0, "x", "p"), (1, 100.4, 200.0, "y", "q")]


def test_hex_rounding_is_half_up(spark):
    rows = spark.createDataFrame([(0.5, 0.0), (-0.5, 0.0), (0.2, 0.7)], "q double, r double")
    got = [tuple(r) for r in rows.select(*grid.cube_round(F.col("q"), F.col("r"))).collect()]
    assert got[0] == (1, 0) and got[1] == (0, 0) and got[2] == (0, 1)


def test_even_odd_with_hole_and_first_polygon(spark):
    square = lambda x0, y0, x1, y1: [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]
    polys = spark.createDataFrame([(2, square(0.0, 0.0, 4.0, 4.0)), (1, square(0.0, 0.0, 4.0, 4.0) + square(1.0, 1.0, 2.0, 2.0))], "ord int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.0, 9.0)], "id int, lat double, lng double")
    assert {tuple(r) for r in spatial.in_polygons(points, polys, 0.7).collect()} == {(1, 1), (2, 2)}


def test_claims_and_payloads(spark):
    rows = spark.createDataFrame([(1, "$1,200 and 3 items, 3 hours, 3 Hours, 12 km then 4.5"), (2, None), (3, "")], "id int, text string")
    got = [(r["id"], r["raw"], r["value"], r["unit"]) for r in text.claims(rows).orderBy("id", "place").collect()]
    assert got == [(1, "$1,200", 1200.0, "$"), (1, "3 hours", 3.0, "hours"), (1, "3", 3.0, None), (1, "12 km", 12.0, "km"), (1, "4.5", 4.5, None)] or got == [(1, "$1,200", 1200.0, "$"), (1, "3 hours", 3.0, "hours"), (1, "12 km", 12.0, "km"), (1, "4.5", 4.5, None)]
    nums = spark.range(1).select(text.payload_numbers(F.lit('{"a 1": "2 x \\" 3", "b": [4, {"c": -5.5e1}], "d": true}')).alias("n")).first()["n"]
    assert nums == [4.0, -55.0]


def test_plans_that_are_refused(spark):
    bad = spark.createDataFrame([(1, "%%%"), (2, "eyJjIjpbWzEsMl1dfQ"), (3, "eyJjIjpbWzEsMl0sWzk5LDJdLFszLDRdXSwidyI6MjAwMH0")], "plan long, encoded string")
    got = {r["plan"]: (r["coords"], r["width"]) for r in text.decode_plans(bad).collect()}
    assert got[1] == (None, None) and got[2][0] is None and [(c["lat"], c["lng"]) for c in got[3][0]] == [(1.0, 2.0), (3.0, 4.0)] and got[3][1] is None


def test_dates_run_on_and_levels_have_an_order(spark):
    rows = spark.createDataFrame([("31/02/2023", None), ("1/13/2023 12:05 am", None), ("5/6/2024", "17:20"), ("soon", None), (None, None)], "d string, t string")
    assert [r[0] for r in rows.select(feeds.au_date(F.col("d"), F.col("t"))).collect()] == ["2023-03-03T00:00:00.000Z", "2024-01-01T00:05:00.000Z", "2024-06-05T17:20:00.000Z", None, None]
    levels = spark.createDataFrame([("Watch and Act, was Emergency",), ("ADVICE watch",), ("advice",), (None,)], "s string")
    assert [r[0] for r in levels.select(feeds.warning_level(F.col("s"))).collect()] == ["emergency-warning", "watch-and-act", "advice", "incident"]


def test_patches_that_are_no_objects(spark):
    base = spark.createDataFrame([(1, 2.0, 3.0, True), (2, 2.0, 3.0, True), (3, 2.0, 3.0, True)], "id int, rate double, max_slope double, active boolean")
    patches = spark.createDataFrame([(1, '{"rate": null, "active": false, "name": "x"}'), (2, "nonsense"), (3, "[1]")], "id int, fields string")
    got = {r["id"]: tuple(r)[1:] for r in entities.patched(base, patches).collect()}
    assert got == {1: (None, 3.0, False), 2: (2.0, 3.0, True), 3: (2.0, 3.0, True)}


def test_streams_agree_with_batches(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, f"k{i % 3}", t0 + datetime.timedelta(seconds=37 * i + (i % 5)), i % 7, "a" if i % 2 else "b", float(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, key string, ts timestamp, user_id long, event_type string, value double").orderBy("ts")
    d = tempfile.mkdtemp(prefix="spark-")
    for i, part in enumerate(("event_id < 70", "event_id BETWEEN 70 AND 139", "event_id > 139")):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{d}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{d}/in/*")
    for name, df, mode in (("limited", telemetry.limited_stream(stream, 3, 600), "append"), ("daily", telemetry.daily(stream), "complete")):
        q = df.writeStream.format("memory").queryName(f"ridgework_{name}").outputMode(mode).option("checkpointLocation", f"{d}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(300)
    want = {tuple(r) for r in telemetry.limited(events, 3, 600).collect()}
    assert {tuple(r) for r in spark.table("ridgework_limited").collect()} == want and {r[1] for r in want} == {True, False}
    daily = {tuple(r) for r in spark.table("ridgework_daily").collect()}
    assert daily == {tuple(r) for r in telemetry.daily(events).collect()}


def test_a_polled_stream_equals_the_batch_across_a_restart(spark):
    """Shuffled, late and repeated polls in several files; the query stops after two of them and goes on from its checkpoint."""
    from ridgework.streaming import incidents

    t0 = datetime.datetime(2024, 1, 1)
    hour = lambda n: t0 + datetime.timedelta(hours=n)
    # poll p gives every incident's version of that time; every third incident isn't changed by every poll
    rows = [(f"s{i % 2}", hour(p), f"i{i}", hour(p - (i % 3)), ("advice", "watch-and-act")[(i + p) % 2] if i % 3 == 0 else "incident", f"t{p - (i % 3)}") for p in range(12) for i in range(9)]
    df = spark.createDataFrame(rows, "source string, polled timestamp, id string, updated timestamp, level string, title string")
    d = tempfile.mkdtemp(prefix="spark-")
    parts = [rows[60:80] + rows[:30], rows[30:60] + rows[70:90], rows[80:], rows[50:100]]  # out of order, overlapping
    put = lambda i: spark.createDataFrame(parts[i], df.schema).coalesce(1).write.mode("append").parquet(f"{d}/in/{i}")
    seen: dict = {}

    def run(name):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in/*")

        def keep(batch, _):
            for r in batch.collect():  # rows of a test
                seen[r.id, r.source] = tuple(r)

        q = incidents.latest(stream, "1 day").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{d}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(300)

    put(0)
    put(1)
    run("latest")
    put(2)
    put(3)
    run("latest")
    want = {(r.id, r.source): tuple(r) for r in incidents.latest(df).collect()}
    assert seen == want and {k: v[5] for k, v in want.items()} == {(f"i{i}", f"s{i % 2}"): 12 for i in range(9)}
    stream = spark.readStream.schema(df.schema).parquet(f"{d}/in/*")
    q = incidents.given(stream.dropDuplicates(["source", "polled", "id"]), "1 hour").writeStream.outputMode("append").format("memory").queryName("ridgework_given").option("checkpointLocation", f"{d}/given").trigger(availableNow=True).start()
    q.awaitTermination(300)
    given = {tuple(r) for r in spark.table("ridgework_given").collect()}
    assert given and given <= {tuple(r) for r in incidents.given(df).collect()} and len(given) >= 20  # the last polls wait for the watermark


def test_windows_of_a_stream_end_by_event_time(spark):
    """A key's window lives while the stream stands still, and a restart finds it; it goes when the watermark has passed its end."""
    t0, d = datetime.datetime(2024, 1, 1), tempfile.mkdtemp(prefix="spark-")
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    schema = "event_id long, key string, ts timestamp"
    for i, part in enumerate(([(0, "a", at(0)), (1, "b", at(1))], [(2, "a", at(5)), (3, "a", at(9))], [(4, "b", at(5000))], [(5, "a", at(5001)), (6, "b", at(5002))])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{d}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{d}/in/*")
        q = telemetry.limited_stream(stream, 2, 600, "1 minute").writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/state").trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = {r.event_id: (r.allowed, r.remaining) for r in spark.read.parquet(f"{d}/out").collect()}
    assert got == {0: (True, 1), 1: (True, 1), 2: (True, 0), 3: (False, 0), 4: (True, 1), 5: (True, 1), 6: (True, 0)}


def test_limits_by_a_plain_walk(spark):
    rows = [(i, "k", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 9, 10, 11, 25))]
    got = [tuple(r) for r in telemetry.limited(spark.createDataFrame(rows, "event_id long, key string, ts timestamp"), 2, 10).orderBy("event_id").collect()]
    assert got == [(0, True, 1, 10), (1, True, 0, 9), (2, False, 0, 8), (3, False, 0, 1), (4, True, 1, 10), (5, True, 0, 9), (6, True, 1, 10)]
