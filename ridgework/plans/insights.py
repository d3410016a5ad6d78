"""What a plan's assessment says: rules over runs, shares, ends, confidence and resources; segments for costing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import production as p
from ..operators import linear, overrides
from ..sources import tables as t
from . import equipment, lines
from .equipment import SEG, segments
from .registry import SQL, query

#: Slopes that stand for a class where only its length is known.
STANDS_FOR = {"flat": 5.0, "medium": 17.0, "steep": 34.0, "very_steep": 50.0}
_C = p.slope_class_sql("slope")


@query(f"""
SELECT plan, category, round(m, 3) AS len, CASE category WHEN 'flat' THEN 5.0e0 WHEN 'medium' THEN 17.0e0 WHEN 'steep' THEN 34.0e0 ELSE 50.0e0 END AS slope, veg
FROM (SELECT plan, {_C} AS category, sum(len) AS m FROM {SEG} GROUP BY 1, 2) JOIN (SELECT plan, veg FROM ({SQL['predominant_veg']})) USING (plan) WHERE m > 0""")
def profile_fallback(spark, sf):
    """Segments of plans of which only the length by slope class and the predominant vegetation are known."""
    by = segments(spark, sf).withColumn("category", F.expr(_C)).groupBy("plan", "category").agg(F.sum("len").alias("m")).filter("m > 0")
    stands = F.create_map(*(F.lit(x) for kv in STANDS_FOR.items() for x in kv))
    return by.join(lines.predominant_veg(spark, sf).select("plan", "veg"), "plan").select("plan", "category", F.round("m", 3).alias("len"), stands[F.col("category")].alias("slope"), "veg")


_OVERLAY = lines._OVERLAY.replace("b - a >= 1", "b - a > 0.001")


@query(f"""
SELECT s.plan, round(start_m, 3) AS start_m, round(end_m - start_m, 3) AS len, round(slope, 6) AS slope,
       CASE WHEN enabled AND listed AND mid BETWEEN a0 AND a1 THEN 'grassland' WHEN enabled AND listed AND mid BETWEEN b0 AND b1 THEN 'heavyforest' WHEN enabled AND route IS NOT NULL THEN route ELSE veg END AS veg,
       CASE WHEN enabled AND (route IS NOT NULL OR listed AND (mid BETWEEN a0 AND a1 OR mid BETWEEN b0 AND b1)) THEN 1.0 ELSE round(conf, 6) END AS confidence
FROM (SELECT *, (start_m + end_m) / 2 AS mid FROM {_OVERLAY}) AS s LEFT JOIN {lines._OVR} AS o ON o.plan = s.plan""")
def route_profile(spark, sf):
    """Slope and vegetation laid over each other for costing: pieces down to a millimetre, users' overrides at their middles."""
    slope = linear.chainage(lines.classed(spark, sf)).select("plan", "start_m", "end_m", "slope")
    o = linear.overlay(slope, lines._second(spark, sf), 0.001).withColumn("mid", (F.col("start_m") + F.col("end_m")) / 2)
    return overrides.effective(o, overrides.derived(spark, sf)).select("plan", F.round("start_m", 3).alias("start_m"), F.round(F.col("end_m") - F.col("start_m"), 3).alias("len"), F.round("slope", 6).alias("slope"), "veg", F.round("confidence", 6).alias("confidence"))


def _id(name: str, m: str) -> str:
    return f"concat('{name}-', CAST(CAST(floor({m} + 0.5e0) AS BIGINT) AS STRING))"


_SHARES = f"""(SELECT plan, sum(len) AS total, sum(CASE WHEN {_C} IN ('steep', 'very_steep') THEN len ELSE 0 END) / greatest(1, sum(len)) AS steep, sum(CASE WHEN veg = 'heavyforest' THEN len ELSE 0 END) / greatest(1, sum(len)) AS heavy, avg(conf) AS conf, bool_or(part % 29 = 0) AS mock FROM {SEG} GROUP BY plan)"""
_ENDS = f"(SELECT plan, max(CASE WHEN seg_no = 1 THEN veg END) AS first, max(CASE WHEN seg_no = n THEN veg END) AS last FROM (SELECT *, count(*) OVER (PARTITION BY plan) AS n FROM {lines._CHAIN}) GROUP BY plan)"
_FUEL = "IN ('heavyforest', 'mediumscrub')"
_RULES = f"""(
  SELECT plan, 0 AS sev, 0 AS seq, rank, {_id('very-steep', 'start_m')} AS id FROM ({SQL['steep_runs_top3']}) WHERE slope_class = 'very_steep'
  UNION ALL SELECT plan, 1, 1, rank, {_id('steep', 'start_m')} FROM ({SQL['steep_runs_top3']}) WHERE slope_class = 'steep'
  UNION ALL SELECT plan, 1, 2, rank, {_id('heavy-fuel', 'start_m')} FROM ({SQL['heavy_runs_top3']})
  UNION ALL SELECT plan, 1, 3, 1, 'anchor-start' FROM {_ENDS} JOIN {_SHARES} USING (plan) WHERE total > 400 AND first {_FUEL}
  UNION ALL SELECT plan, 1, 4, 1, 'anchor-end' FROM {_ENDS} JOIN {_SHARES} USING (plan) WHERE total > 400 AND last {_FUEL}
  UNION ALL SELECT plan, 2, 5, 1, 'optimize-route' FROM {_SHARES} WHERE total > 300 AND (steep > 0.12 OR heavy > 0.18)
  UNION ALL SELECT plan, CASE WHEN mock THEN 0 ELSE 3 END, 6, 1, CASE WHEN mock THEN 'estimated-data' ELSE 'low-confidence' END FROM {_SHARES} WHERE mock OR conf < 0.6
  UNION ALL SELECT DISTINCT plan, 2, 7, 1, 'strategy' FROM ({SQL['value_pick']}))"""


@query(f"""
WITH r AS (SELECT * FROM {_RULES.replace('AS STRING', 'AS VARCHAR')})
SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY sev, seq, rank) AS INTEGER) AS place, id, CASE sev WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'advice' ELSE 'info' END AS severity FROM (
  SELECT plan, sev, seq, rank, id FROM r UNION ALL SELECT plan, 3, 8, 1, 'good-line' FROM {_SHARES} WHERE plan NOT IN (SELECT plan FROM r WHERE sev < 3 AND id <> 'strategy'))""")
def insights_rules(spark, sf):
    """The findings of each plan by severity: steep and heavy runs, unanchored ends, better routes, estimates, resources; a good line if there is nothing else."""
    s = linear.chainage(lines.classed(spark, sf))
    # the mean is one of decimals: of doubles it depends on the order of a plan's rows whether 0.6 is below 0.6
    land = s.groupBy("plan").agg(
        F.sum("len").alias("total"), (F.sum(F.when(F.col("slope_class").isin("steep", "very_steep"), F.col("len")).otherwise(0.0)) / F.greatest(F.lit(1.0), F.sum("len"))).alias("steep"),
        (F.sum(F.when(F.col("veg") == "heavyforest", F.col("len")).otherwise(0.0)) / F.greatest(F.lit(1.0), F.sum("len"))).alias("heavy"), F.avg(F.col("conf").cast("decimal(18,12)")).alias("conf"), F.bool_or(F.col("part") % 29 == 0).alias("mock"),
        F.min_by("veg", "seg_no").alias("first"), F.max_by("veg", "seg_no").alias("last"),
    )
    # the rules of a plan's own sums are an array of its one row
    rules = [
        ("total > 400 AND first IN ('heavyforest', 'mediumscrub')", 1, 3, "'anchor-start'"), ("total > 400 AND last IN ('heavyforest', 'mediumscrub')", 1, 4, "'anchor-end'"),
        ("total > 300 AND (steep > 0.12e0 OR heavy > 0.18e0)", 2, 5, "'optimize-route'"), ("mock", 0, 6, "'estimated-data'"), ("NOT mock AND conf < 0.6", 3, 6, "'low-confidence'"),
    ]
    found = F.array_compact(F.array(*(F.expr(f"CASE WHEN {cond} THEN named_struct('sev', {sev}, 'seq', {seq}, 'rank', CAST(1 AS BIGINT), 'id', {name}) END") for cond, sev, seq, name in rules)))
    own = land.select("plan", F.explode(found).alias("x")).select("plan", "x.*")
    run = lambda df, name, sev, seq: df.select("plan", F.lit(sev).alias("sev"), F.lit(seq).alias("seq"), "rank", F.expr(_id(name, "start_m")).alias("id"))
    steep = lines.steep_runs_top3(spark, sf)
    picks = equipment.value_pick(spark, sf).select("plan").distinct().select("plan", F.lit(2).alias("sev"), F.lit(7).alias("seq"), F.lit(1).cast("long").alias("rank"), F.lit("strategy").alias("id"))
    good = land.select("plan", F.lit(3).alias("sev"), F.lit(8).alias("seq"), F.lit(1).cast("long").alias("rank"), F.lit("good-line").alias("id"))
    r = own.unionByName(run(steep.filter("slope_class = 'very_steep'"), "very-steep", 0, 0)).unionByName(run(steep.filter("slope_class = 'steep'"), "steep", 1, 1)).unionByName(run(lines.heavy_runs_top3(spark, sf), "heavy-fuel", 1, 2)).unionByName(picks).unionByName(good)
    by = Window.partitionBy("plan")
    r = r.withColumn("_poor", F.max((F.col("sev") < 3) & (F.col("id") != "strategy")).over(by)).filter("id <> 'good-line' OR NOT _poor")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "warning", "advice", "info"))), F.col("sev") + 1)
    return r.select("plan", F.row_number().over(by.orderBy("sev", "seq", "rank")).alias("place"), "id", severity.alias("severity"))


# Factors of time by terrain level and by vegetation of the coarse model.
COARSE_TERRAIN = {"flat": 1.0, "medium": 1.3, "steep": 1.7, "very_steep": 2.2}
COARSE_FUEL = {"grassland": 1.0, "lightshrub": 1.1, "mediumscrub": 1.5, "heavyforest": 2.0}
_LEVELS = tuple(COARSE_TERRAIN)
_case = lambda x, table: f"(CASE {x} {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items())} END)"
_RANK = f"(CASE required {' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_LEVELS))} END)"
_COARSE = f"""(SELECT plan, d, top, veg, flat, medium, steep, very_steep, {p.terrain_level_sql("top")} AS required FROM (
  SELECT plan, sum(len) AS d, max(slope) AS top, {', '.join(f"sum(CASE WHEN {_C} = '{c}' THEN len ELSE 0 END) AS {c}" for c in _LEVELS)} FROM {SEG} GROUP BY plan) JOIN (SELECT plan, veg FROM ({SQL['predominant_veg']})) USING (plan))"""


@query(f"""
SELECT plan, resource, level, CAST(CASE WHEN level <> 'incompatible' AND kind = 'Aircraft' THEN ceil(d / drop_m) END AS BIGINT) AS drops, round(hours, 6) AS hours, round(hours * coalesce(cost_hour, 0), 4) AS cost FROM (
  SELECT *, CASE WHEN level = 'incompatible' THEN 0 WHEN kind = 'Aircraft' THEN ceil(d / drop_m) * turnaround / 60 ELSE d / (rate / ({_case('required', COARSE_TERRAIN)} * {_case('veg', COARSE_FUEL)})) * CASE WHEN level = 'partial' THEN 1 + 2 * over_ / d ELSE 1 END END AS hours FROM (
    SELECT *, CASE WHEN kind = 'Machinery' AND max_slope IS NOT NULL AND top > max_slope THEN 'incompatible' WHEN fuel AND {_RANK} <= best THEN 'full' WHEN kind = 'Machinery' AND fuel AND over_ > 0 AND over_ / d <= 0.15 THEN 'partial' ELSE 'incompatible' END AS level FROM (
      SELECT *, list_contains(string_split(veg_allowed, ','), veg) AS fuel, CASE WHEN best < 3 THEN very_steep ELSE 0 END + CASE WHEN best < 2 THEN steep ELSE 0 END + CASE WHEN best < 1 THEN medium ELSE 0 END AS over_ FROM (
        SELECT c.*, r.*, CASE WHEN list_contains(string_split(terrain, ','), 'very_steep') THEN 3 WHEN list_contains(string_split(terrain, ','), 'steep') THEN 2 WHEN list_contains(string_split(terrain, ','), 'medium') THEN 1 ELSE 0 END AS best FROM {_COARSE} AS c CROSS JOIN {equipment.RES} AS r))))""")
def equip_coarse_fallback(spark, sf):
    """Resources by one terrain level (of the largest slope) and one vegetation a plan, for when the full model is away; only machines can be partial."""
    by = segments(spark, sf).groupBy("plan").agg(F.sum("len").alias("d"), F.max("slope").alias("top"), *(F.expr(f"sum(CASE WHEN {_C} = '{c}' THEN len ELSE 0e0 END)").alias(c) for c in _LEVELS))
    c = by.join(lines.predominant_veg(spark, sf).select("plan", "veg"), "plan").withColumn("required", F.expr(p.terrain_level_sql("top")))
    number = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"{float(x)!r}e0"
    rows = []
    for name, kind, rate, cost, _, max_slope, _, terrain, fuels, drop_m, turn, _ in t.RESOURCES:
        best = max(_LEVELS.index(x) for x in terrain.split(","))
        over, fuel = " + ".join(_LEVELS[best + 1 :]) or "0e0", f"veg IN ({', '.join(f"'{v}'" for v in fuels.split(','))})"
        partial = f"WHEN {fuel} AND {over} > 0 AND ({over}) / d <= {p.PARTIAL_SHARE}e0 THEN 'partial'" if kind == "Machinery" else ""
        steep = f"WHEN top > {number(max_slope)} THEN 'incompatible'" if kind == "Machinery" and max_slope is not None else ""
        level = f"CASE {steep} WHEN {fuel} AND {_RANK} <= {best} THEN 'full' {partial} ELSE 'incompatible' END"
        rows.append(f"named_struct('resource', '{name}', 'kind', '{kind}', 'rate', {number(rate)}, 'cost_hour', {number(cost)}, 'drop_m', {number(drop_m)}, 'turn', {number(turn)}, 'over', {over}, 'level', {level})")
    x = c.select("plan", "d", "veg", "required", F.expr(f"inline(array({', '.join(rows)}))"))
    hours = f"CASE WHEN level = 'incompatible' THEN 0e0 WHEN kind = 'Aircraft' THEN ceil(d / drop_m) * turn / 60 ELSE d / (rate / ({_case('required', COARSE_TERRAIN)} * {_case('veg', COARSE_FUEL)})) * CASE WHEN level = 'partial' THEN 1 + 2 * over / d ELSE 1e0 END END"
    x = x.withColumn("_h", F.expr(hours))
    return x.select("plan", "resource", "level", F.expr("CASE WHEN level <> 'incompatible' AND kind = 'Aircraft' THEN CAST(ceil(d / drop_m) AS BIGINT) END").alias("drops"), F.round("_h", 6).alias("hours"), F.round(F.col("_h") * F.coalesce("cost_hour", F.lit(0.0)), 4).alias("cost"))
