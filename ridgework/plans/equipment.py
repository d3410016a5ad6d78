"""Evaluation of resources along plans, from the star schema's line items as segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import production as p
from ..operators import evaluation
from ..sources import tables as t
from .registry import query

SEG, RES, W = t.derived_sql("lineitem", t.SEGMENT), t.resources_sql(), t.BREAK_WIDTH_M


def segments(spark, sf):
    return t.derived(spark, sf, "lineitem", t.SEGMENT)


def _sql(text: str) -> str:
    """The same expression for DuckDB."""
    return text.replace("AS STRING)", "AS VARCHAR)")


def _clauses(x: str) -> str:
    return f"sum(CASE WHEN water THEN 0 ELSE {x} END)"


_LIMITED = f"(SELECT *, {p.max_slope_sql('kind', 'max_slope', 'terrain')} AS slope_limit, {p.max_side_sql('kind', 'max_side')} AS side_limit, row_number() OVER () - 1 AS ord FROM {RES})"
_RATE = f"rate * {p.fuel_sql('kind', 'veg')} * {p.slope_factor_sql('kind', 'greatest(0.0, slope)')}"
_LINES = f"""
  SELECT plan, ord, resource, kind, cost_hour, cut, slope_limit, side_limit, {_clauses("len")} AS total_m, {_clauses("len * conf")} AS c, {_clauses("CASE WHEN out THEN len ELSE 0 END")} AS over_m,
         {_clauses("CASE WHEN side > side_limit THEN len ELSE 0 END")} AS side_over_m, max(CASE WHEN out AND NOT water THEN slope END) AS steepest, max(CASE WHEN side > side_limit AND NOT water THEN side END) AS steepest_side,
         {_clauses(f"len / CASE WHEN {_RATE} > 0 THEN {_RATE} ELSE rate * 0.1 END")} AS h
  FROM (SELECT *, slope > slope_limit OR side > side_limit OR NOT list_contains(string_split(veg_allowed, ','), veg) AS out FROM {SEG} AS s CROSS JOIN {_LIMITED} AS r WHERE kind <> 'Aircraft') GROUP BY ALL"""
_EVAL = _sql(f"""
SELECT plan, CAST(ord AS INTEGER) AS ord, resource, kind, round(total_m, 3) AS total_m, round(over_m, 3) AS over_m, level, round(t, 6) AS hours, round(t * coalesce(cost_hour, 0), 4) AS cost, passes, round(nullif(f, 0), 6) AS over_share,
       CASE WHEN steepest > slope_limit THEN round(steepest, 6) END AS max_slope_exceeded, CASE WHEN steepest_side > side_limit THEN round(steepest_side, 6) END AS max_side_exceeded,
       round(round(c / nullif(total_m, 0), 9), 6) AS confidence, {evaluation.line_note_sql(W)} AS note
FROM (SELECT *, CASE level WHEN 'incompatible' THEN 0.0 WHEN 'partial' THEN h * (1 + 2.0 * f) * mult ELSE h * mult END AS t
      FROM (SELECT *, CASE WHEN f = 0 THEN 'full' WHEN f <= 0.15 THEN 'partial' ELSE 'incompatible' END AS level
            FROM (SELECT *, coalesce(over_m / nullif(total_m, 0), 0) AS f, {p.width_sql("kind", str(W), "cut")} AS mult, CASE WHEN kind = 'Machinery' THEN CAST(greatest(1, ceil({W} / coalesce(cut, 3.4))) AS BIGINT) END AS passes FROM ({_LINES}))))""")


@query(_EVAL)
def equip_line_eval(spark, sf):
    """Ground resources along all plans."""
    return evaluation.evaluate_lines(segments(spark, sf), t.RESOURCES, W)


_AIR = _sql(f"""
SELECT plan, resource, drops, round(hours, 6) AS hours, round(CASE WHEN cost_drop > 0 THEN drops * cost_drop ELSE coalesce(hours * cost_hour, 0) END, 4) AS cost, level, round(nullif(f, 0), 6) AS over_share, round(round(c / nullif(total_m, 0), 9), 6) AS confidence, {evaluation.drop_note_sql()} AS note
FROM (SELECT *, drops * turnaround / 60 AS hours FROM (SELECT *, CASE WHEN level = 'incompatible' THEN 0 ELSE CAST(greatest(1.0, ceil(round(d, 6))) AS BIGINT) END AS drops
  FROM (SELECT *, CASE WHEN f = 0 THEN 'full' WHEN f <= 0.15 THEN 'partial' ELSE 'incompatible' END AS level FROM (SELECT *, coalesce(over_m / nullif(total_m, 0), 0) AS f FROM (
    SELECT plan, resource, turnaround, cost_hour, cost_drop, {_clauses("len")} AS total_m, {_clauses("len * conf")} AS c, {_clauses("CASE WHEN list_contains(string_split(veg_allowed, ','), veg) THEN 0 ELSE len END")} AS over_m, {_clauses(f"len / (drop_m * {p.fuel_sql('kind', 'veg')})")} AS d
    FROM {SEG} AS s CROSS JOIN {RES} AS r WHERE kind = 'Aircraft' GROUP BY plan, resource, turnaround, cost_hour, cost_drop)))))""")


@query(_AIR)
def equip_aircraft_eval(spark, sf):
    return evaluation.evaluate_drops(segments(spark, sf), t.RESOURCES)


@query(_sql(f"""
SELECT plan, resource, hours, cost, ord = best AS recommended, {evaluation.recommendation_sql("ord = best", "fastest", "best_cost")} AS note FROM (
  SELECT *, first_value(ord) OVER w AS best, first_value(cost) OVER w AS best_cost FROM (
    SELECT *, min(hours) OVER (PARTITION BY plan) AS fastest, count(*) OVER (PARTITION BY plan) AS n FROM ({_EVAL}) WHERE kind = 'Machinery' AND level <> 'incompatible')
  WINDOW w AS (PARTITION BY plan ORDER BY hours > 2 * fastest, cost, ord)) WHERE n > 1"""))
def equip_recommend(spark, sf):
    """The recommended machine of each plan and why the others are not."""
    return evaluation.recommend(equip_line_eval(spark, sf))


_ALL = f"SELECT plan, ord, resource, level, hours, cost FROM ({_EVAL}) UNION ALL SELECT plan, CAST(CASE WHEN resource = 'airtanker' THEN 5 ELSE 4 END AS INTEGER), resource, level, hours, cost FROM ({_AIR})"


@query(f"""
SELECT plan, resource, CAST(row_number() OVER (PARTITION BY plan ORDER BY CASE level WHEN 'full' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, CASE WHEN level <> 'incompatible' THEN floor(hours / 0.1) END, CASE WHEN level <> 'incompatible' THEN cost END, CASE WHEN level <> 'incompatible' THEN hours END, ord) AS INTEGER) AS place
FROM ({_ALL})""")
def equip_order(spark, sf):
    """Order of a plan's results: level, hours by tenths, cost, hours, catalogue; incompatible ones by catalogue.

    Comparing costs whenever two times differ by less than a tenth is no order (it isn't transitive); tenths of hours are.
    """
    names = {r[0]: i for i, r in enumerate(t.RESOURCES)}
    air = equip_aircraft_eval(spark, sf).withColumn("ord", F.element_at(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v)))), F.col("resource")))
    cols = ["plan", "ord", "resource", "level", "hours", "cost"]
    rows = equip_line_eval(spark, sf).select(*cols).unionByName(air.select(*cols))
    w = Window.partitionBy("plan").orderBy(F.expr("CASE level WHEN 'full' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END"), *(F.expr(f"CASE WHEN level <> 'incompatible' THEN {x} END") for x in ("floor(hours / 0.1e0)", "cost", "hours")), "ord")
    return rows.select("plan", "resource", F.row_number().over(w).alias("place"))


@query(f"""
SELECT plan, round(l, 3) AS total_m, round(coalesce(ls / nullif(l, 0), 0), 6) AS mean_slope, round(greatest(0, coalesce(m, 0)), 6) AS max_slope, round(w, 3) AS water_m, round(round(coalesce(c / nullif(l, 0), 0), 9), 6) AS confidence,
       {p.terrain_level_sql("round(coalesce(ls / nullif(l, 0), 0), 6)")} AS terrain
FROM (SELECT plan, {_clauses("len")} AS l, {_clauses("len * slope")} AS ls, max(CASE WHEN NOT water THEN slope END) AS m, sum(CASE WHEN water THEN len ELSE 0 END) AS w, {_clauses("len * conf")} AS c FROM {SEG} GROUP BY plan)""")
def equip_meta(spark, sf):
    """Slopes, water, confidence and terrain level of each plan."""
    return evaluation.plan_summary(segments(spark, sf))


_C = p.slope_class_sql("slope")
_PART = "round(least(100.0, 0.55 * (30 * m + 70 * s + 100 * v) / greatest(1.0, l) + 0.45 * (25 * a + 55 * b + 100 * c) / greatest(1.0, l)), 6)"


@query(f"""
SELECT plan, CAST(floor({_PART} + 0.5) AS BIGINT) AS score, CASE WHEN floor({_PART} + 0.5) < 25 THEN 'Low' WHEN floor({_PART} + 0.5) < 50 THEN 'Moderate' WHEN floor({_PART} + 0.5) < 75 THEN 'High' ELSE 'Extreme' END AS label
FROM (SELECT plan, sum(len) AS l,
  sum(CASE WHEN {_C} = 'medium' THEN len ELSE 0 END) AS m, sum(CASE WHEN {_C} = 'steep' THEN len ELSE 0 END) AS s, sum(CASE WHEN {_C} = 'very_steep' THEN len ELSE 0 END) AS v,
  sum(CASE WHEN veg = 'lightshrub' THEN len ELSE 0 END) AS a, sum(CASE WHEN veg = 'mediumscrub' THEN len ELSE 0 END) AS b, sum(CASE WHEN veg = 'heavyforest' THEN len ELSE 0 END) AS c
  FROM {SEG} GROUP BY plan)""")
def difficulty_score(spark, sf):
    return evaluation.difficulty(segments(spark, sf))


@query(f"""
WITH u AS (SELECT *, min(hours) OVER (PARTITION BY plan, kind) AS fast FROM ({_EVAL}) WHERE level <> 'incompatible' AND hours > 0)
SELECT plan, kind, max(CASE WHEN f = 1 THEN resource END) AS fastest, max(CASE WHEN v = 1 THEN resource END) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY plan, kind ORDER BY hours, ord) AS f,
         row_number() OVER (PARTITION BY plan, kind ORDER BY CASE WHEN cost > 0 AND hours <= 1.5 * fast THEN 0 WHEN cost > 0 THEN 1 ELSE 2 END, CASE WHEN cost > 0 THEN cost ELSE hours END, ord) AS v FROM u) GROUP BY plan, kind""")
def value_pick(spark, sf):
    """The fastest and the best-value resource of each kind."""
    return evaluation.value_pick(equip_line_eval(spark, sf))


@query(f"""
SELECT resource, kind, slope, veg, round(rate * {p.fuel_sql("kind", "veg")} * {p.slope_factor_sql("kind", "slope")}, 6) AS effective
FROM {RES} AS r CROSS JOIN (SELECT DISTINCT p_size * 1.25e0 AS slope FROM part) AS s CROSS JOIN (SELECT unnest(['grassland', 'lightshrub', 'mediumscrub', 'heavyforest']) AS veg) AS v WHERE rate > 0""")
def rate_curve(spark, sf):
    """Effective rates of the catalogue over slopes and vegetation."""
    slopes = t.table(spark, sf, "part").select((F.col("p_size") * F.expr("1.25D")).alias("slope")).distinct()
    rows = slopes.withColumn("veg", F.explode(F.array(*map(F.lit, p.VEGETATION)))).crossJoin(F.broadcast(t.resources(spark).filter("rate > 0")))
    return rows.select("resource", "kind", "slope", "veg", F.round(F.col("rate") * F.expr(p.fuel_sql("kind", "veg")) * F.expr(p.slope_factor_sql("kind", "slope")), 6).alias("effective"))


@query(f"SELECT p_partkey, resource, round({p.width_sql('kind', 'p_size * 0.5', 'cut')}, 6) AS multiplier FROM part CROSS JOIN {RES} AS r")
def width_multiplier(spark, sf):
    rows = t.table(spark, sf, "part").crossJoin(F.broadcast(t.resources(spark)))
    return rows.select("p_partkey", "resource", F.round(F.expr(p.width_sql("kind", "p_size * 0.5D", "cut")), 6).alias("multiplier"))


#: Catalogue rows as users enter them, with gaps.
ENTERED = {
    "id": "p_partkey", "kind": "(CASE p_partkey % 3 WHEN 0 THEN 'Machinery' WHEN 1 THEN 'HandCrew' ELSE 'Aircraft' END)", "name": "(CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END)",
    "terrain": "(CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'flat' WHEN 2 THEN 'flat,medium' WHEN 3 THEN 'steep' ELSE 'flat,very_steep' END)",
    "fuels": "(CASE WHEN p_size % 7 = 0 THEN '' ELSE 'grassland' END)", "max_slope": "(CASE WHEN p_partkey % 4 = 0 THEN p_size * 1.0e0 WHEN p_partkey % 4 = 1 THEN 0e0 END)", "max_side": "(CASE WHEN p_partkey % 6 = 0 THEN p_size * 0.5e0 END)",
    "rate": "(CASE WHEN p_partkey % 5 = 0 THEN 0e0 WHEN p_partkey % 5 <> 1 THEN p_retailprice END)", "drop_m": "(CASE WHEN p_partkey % 7 <> 0 THEN p_size * 1.0e0 END)", "turn": "(p_size - 10) * 1.0e0",
    "crew": "p_partkey % 4", "person_rate": "(CASE WHEN p_partkey % 8 < 5 THEN 15e0 END)",
}
ENT = t.derived_sql("part", ENTERED)


@query(f"SELECT id, kind, round({p.max_slope_sql('kind', 'max_slope', 'terrain')}, 6) AS max_slope, round({p.max_side_sql('kind', 'max_side')}, 6) AS max_side FROM {ENT}")
def max_slope_resolve(spark, sf):
    """Limits of each catalogue row: explicit ones, else by terrain levels and kind."""
    e = t.derived(spark, sf, "part", ENTERED)
    ceilings = F.create_map(*(F.lit(x) for kv in p.TERRAIN_CEILING.items() for x in kv))
    default = F.create_map(*(F.lit(x) for kv in p.MAX_SLOPE.items() for x in kv))[F.col("kind")]
    ceiling = F.when(F.col("terrain") == "", default).otherwise(F.array_max(F.transform(F.split("terrain", ","), lambda x: F.coalesce(ceilings[x], F.lit(0.0)))))
    limit = F.when(F.col("max_slope") > 0, F.col("max_slope")).otherwise(F.least(ceiling, default * F.lit(1.8)))
    return e.select("id", "kind", F.round(limit, 6).alias("max_slope"), F.round(F.expr(p.max_side_sql("kind", "max_side")), 6).alias("max_side"))


_CHECKS = (
    ("trim(name) = ''", "Equipment name is required"), ("terrain = ''", "Equipment must specify allowed terrain types"), ("fuels = ''", "Equipment must specify allowed vegetation types"),
    ("kind = 'Machinery' AND coalesce(rate, 0) <= 0", "Machinery must have positive clearing rate"), ("kind = 'Aircraft' AND coalesce(drop_m, 0) <= 0", "Aircraft must have positive drop length"),
    ("kind = 'Aircraft' AND coalesce(turn, 0) <= 0", "Aircraft must have positive turnaround time"), ("kind = 'HandCrew' AND coalesce(crew, 0) <= 0", "Hand crew must have positive crew size"),
    ("kind = 'HandCrew' AND coalesce(person_rate, 0) <= 0", "Hand crew must have positive clearing rate per person"),
)


@query(f"SELECT id, concat_ws(', ', {', '.join(f"CASE WHEN {c} THEN '{m}' END" for c, m in _CHECKS)}) AS errors FROM {ENT}")
def equip_validate(spark, sf):
    """What is wrong with each catalogue row; empty if nothing."""
    return t.derived(spark, sf, "part", ENTERED).select("id", F.array_join(F.array_compact(F.array(*(F.when(F.expr(c), m) for c, m in _CHECKS))), ", ").alias("errors"))
