"""Time and cost of resources along planned lines.

A plan's sums for all resources are conditional aggregates of one grouping by plan: rows are not
multiplied by the catalogue, the sums combine before the one shuffle, and what follows (levels, notes, the recommended
machine) works on the array of a plan's results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import production as p

Resource = tuple  # a row of sources.tables.RESOURCES

LEVEL_SQL = f"(CASE WHEN coalesce(over_m / nullif(total_m, 0e0), 0e0) = 0 THEN 'full' WHEN over_m / nullif(total_m, 0e0) <= {p.PARTIAL_SHARE} THEN 'partial' ELSE 'incompatible' END)"
SHARE_SQL = "coalesce(over_m / nullif(total_m, 0e0), 0e0)"
LINE_NOTE_SQL = """nullif(concat_ws(' • ',
  CASE level WHEN 'incompatible' THEN concat({share}, '% of route exceeds this resource', chr(39), 's slope/fuel limits') WHEN 'partial' THEN concat('~', {share}, '% of route over limits; time penalty applied') END,
  CASE WHEN side_over_m > 0 THEN concat('~', {side}, '% on sidehill steeper than ', {limit}, '° — rollover risk, not just along-line grade') END,
  CASE WHEN level = 'incompatible' THEN NULL WHEN passes > 1 THEN concat(CAST(passes AS STRING), ' passes for ', {width}, 'm break')
       WHEN kind = 'HandCrew' AND mult > 1 THEN concat('effort scaled ×', CAST(round(mult, 1) AS STRING), ' for ', {width}, 'm break') END), '')"""
DROP_NOTE_SQL = "(CASE level WHEN 'incompatible' THEN concat({share}, '% of route in fuel this aircraft cannot effectively treat') WHEN 'partial' THEN concat('~', {share}, '% of route in marginal fuel') END)"


def line_note_sql(width: float) -> str:
    return LINE_NOTE_SQL.format(share=p.rounded_sql(f"100 * {SHARE_SQL}"), side=p.rounded_sql("100 * side_over_m / nullif(total_m, 0e0)"), limit="CASE WHEN side_limit = floor(side_limit) THEN CAST(CAST(side_limit AS BIGINT) AS STRING) ELSE CAST(side_limit AS STRING) END", width=f"'{int(width + 0.5)}'")


def drop_note_sql() -> str:
    return DROP_NOTE_SQL.format(share=p.rounded_sql(f"100 * {SHARE_SQL}"))


def _number(x: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"{float(x)!r}e0"


def _fuels(allowed: str) -> str:
    return f"coalesce(veg IN ({', '.join(f"'{v}'" for v in allowed.split(','))}), false)"


def _sum(x: str, where: str = "true") -> F.Column:
    return F.expr(f"coalesce(sum(CASE WHEN NOT coalesce(water, false) AND ({where}) THEN {x} ELSE 0e0 END), 0e0)")


def evaluate_lines(segments: DataFrame, resources: Sequence[Resource], width: float) -> DataFrame:
    """Per plan and ground resource: level, hours, cost, what is over the limits, passes, confidence and notes.

    A segment is over if its slope, side slope or fuel is; full means none over, partial up to 15 % of the length (hours grow by twice
    that share), more is incompatible (no hours, no cost).  Water is crossed for nothing: a plan of water alone is full and free.
    Null side slopes and confidences count as 0, a null or unknown fuel is over and takes the notional rate.
    """
    ground = [r for r in resources if r[1] != "Aircraft"]
    sums, rows = [_sum("len").alias("total_m"), _sum("len * coalesce(conf, 0e0)").alias("_conf")], []
    for i, (name, kind, rate, cost_hour, cut, max_slope, max_side, terrain, fuels, *_) in enumerate(ground):
        limit, side = p.max_slope(kind, max_slope, terrain), max_side or p.MAX_SIDE[kind]
        sided = f"coalesce(side, 0e0) > {_number(side)}"
        over = f"slope > {_number(limit)} OR {sided} OR NOT {_fuels(fuels)}"
        effective = f"({_number(rate)} * {p.fuel_sql(f"'{kind}'", 'veg')} * {p.slope_factor_sql(f"'{kind}'", 'greatest(0e0, slope)')})"
        sums += [
            _sum("len", over).alias(f"_o{i}"), _sum("len", sided).alias(f"_s{i}"), _sum(f"CASE WHEN {effective} > 0 THEN len / {effective} ELSE len / {_number(rate * p.NOTIONAL_RATE)} END").alias(f"_h{i}"),
            F.expr(f"max(CASE WHEN NOT coalesce(water, false) AND ({over}) THEN slope END)").alias(f"_m{i}"), F.expr(f"max(CASE WHEN NOT coalesce(water, false) AND {sided} THEN side END)").alias(f"_n{i}"),
        ]
        passes, mult = p.width(kind, width, cut)
        rows.append(
            f"named_struct('ord', {i}, 'resource', '{name}', 'kind', '{kind}', 'cost_hour', {_number(cost_hour)}, 'slope_limit', {_number(limit)}, 'side_limit', {_number(side)}, 'passes', CAST({'NULL' if passes is None else passes} AS BIGINT), "
            f"'mult', {_number(mult)}, 'over_m', _o{i}, 'side_over_m', _s{i}, '_h', _h{i}, 'steepest', _m{i}, 'steepest_side', _n{i})"
        )
    out = segments.groupBy("plan").agg(*sums).select("plan", "total_m", "_conf", F.expr(f"inline(array({', '.join(rows)}))")).withColumn("level", F.expr(LEVEL_SQL))
    hours = F.expr(f"CASE WHEN level = 'incompatible' THEN 0e0 ELSE _h * (CASE WHEN level = 'partial' THEN 1 + {p.PARTIAL_PENALTY} * over_m / total_m ELSE 1e0 END) * mult END")
    out = out.withColumn("_t", hours)
    return out.select(
        "plan", "ord", "resource", "kind", F.round("total_m", 3).alias("total_m"), F.round("over_m", 3).alias("over_m"), "level", F.round("_t", 6).alias("hours"),
        F.round(F.col("_t") * F.coalesce("cost_hour", F.lit(0.0)), 4).alias("cost"), "passes", F.expr(f"round(nullif({SHARE_SQL}, 0e0), 6)").alias("over_share"),
        F.expr("CASE WHEN steepest > slope_limit THEN round(steepest, 6) END").alias("max_slope_exceeded"), F.expr("CASE WHEN steepest_side > side_limit THEN round(steepest_side, 6) END").alias("max_side_exceeded"),
        F.expr("round(round(_conf / nullif(total_m, 0e0), 9), 6)").alias("confidence"), F.expr(line_note_sql(width)).alias("note"),
    )


def evaluate_drops(segments: DataFrame, resources: Sequence[Resource]) -> DataFrame:
    """Per plan and aircraft: level by fuel alone, drops, hours by turns, cost (by drop where it has a price, else by hour)."""
    air = [r for r in resources if r[1] == "Aircraft"]
    sums, rows = [_sum("len").alias("total_m"), _sum("len * coalesce(conf, 0e0)").alias("_conf")], []
    for i, (name, kind, _, cost_hour, _, _, _, _, fuels, drop_m, turn, cost_drop) in enumerate(air):
        reach = f"({_number(drop_m or 100)} * {p.fuel_sql(f"'{kind}'", 'veg')})"
        sums += [_sum("len", f"NOT {_fuels(fuels)}").alias(f"_o{i}"), _sum(f"CASE WHEN {reach} > 0 THEN len / {reach} ELSE 0e0 END").alias(f"_d{i}")]
        rows.append(f"named_struct('resource', '{name}', 'cost_hour', {_number(cost_hour)}, 'turn', {_number(turn or 15)}, 'cost_drop', {_number(cost_drop)}, 'over_m', _o{i}, '_d', _d{i})")
    out = segments.groupBy("plan").agg(*sums).select("plan", "total_m", "_conf", F.expr(f"inline(array({', '.join(rows)}))")).withColumn("level", F.expr(LEVEL_SQL))
    # sums of drops are rounded, as a sum's last bits depend on its order
    out = out.withColumn("drops", F.expr("CASE WHEN level = 'incompatible' THEN 0 ELSE greatest(1, CAST(ceil(round(_d, 6)) AS BIGINT)) END")).withColumn("_t", F.expr("drops * turn / 60e0"))
    cost = F.expr("CASE WHEN cost_drop > 0 THEN drops * cost_drop ELSE coalesce(_t * cost_hour, 0e0) END")
    return out.select(
        "plan", "resource", F.col("drops").cast("long").alias("drops"), F.round("_t", 6).alias("hours"), F.round(cost, 4).alias("cost"), "level",
        F.expr(f"round(nullif({SHARE_SQL}, 0e0), 6)").alias("over_share"), F.expr("round(round(_conf / nullif(total_m, 0e0), 9), 6)").alias("confidence"), F.expr(drop_note_sql()).alias("note"),
    )


def recommend(evaluated: DataFrame, within: float = 2.0) -> DataFrame:
    """Per plan with several usable machines, each of them: the cheapest within twice the fastest's hours is recommended, the others say why not.

    Of equal costs the first of the catalogue is taken.  A machine without a cost is free, so it wins where it is fast enough.
    """
    machines = evaluated.filter("kind = 'Machinery' AND level <> 'incompatible'").groupBy("plan").agg(F.sort_array(F.collect_list(F.struct("ord", "resource", "hours", "cost", "note"))).alias("_m"))  # a catalogue's machines at most
    machines = machines.filter(F.size("_m") > 1).withColumn("_f", F.expr("array_min(transform(_m, x -> x.hours))"))
    machines = machines.withColumn("_best", F.expr(f"array_min(transform(filter(_m, x -> x.hours <= {within}e0 * _f), x -> named_struct('cost', x.cost, 'ord', x.ord)))"))
    rows = machines.select("plan", "_f", "_best", F.explode("_m").alias("m")).select("plan", "_f", "_best", "m.*")
    return rows.select("plan", "resource", "hours", "cost", F.expr("ord = _best.ord").alias("recommended"), F.expr(recommendation_sql("ord = _best.ord", "_f", "_best.cost", within)).alias("note"))


def recommendation_sql(best: str, fastest: str, cost: str, within: float = 2.0) -> str:
    """The machine's note, its reason appended; an empty reason still leaves the separator."""
    reason = f"(CASE WHEN hours > {within}e0 * {fastest} THEN concat('Takes ', CAST(round(hours / {fastest}, 1) AS STRING), '× longer than fastest option') WHEN cost > {cost} THEN concat('$', {p.rounded_sql(f'(cost - {cost})')}, ' more than cost-optimised choice') ELSE '' END)"
    return f"concat(CASE WHEN note IS NULL THEN '' ELSE concat(note, ' • ') END, CASE WHEN {best} THEN 'Cost-optimised selection' ELSE {reason} END)"


def plan_summary(segments: DataFrame) -> DataFrame:
    """Per plan: length, length-weighted mean slope, largest slope and confidence of its land, length of its water, terrain level of the mean."""
    s = segments.groupBy("plan").agg(
        _sum("len").alias("_l"), _sum("len * slope").alias("_ls"), F.expr("max(CASE WHEN NOT coalesce(water, false) THEN slope END)").alias("_m"), F.expr("sum(CASE WHEN water THEN len ELSE 0e0 END)").alias("_w"),
        _sum("len * coalesce(conf, 0e0)").alias("_c"),
    )
    mean = "coalesce(_ls / nullif(_l, 0e0), 0e0)"
    return s.select("plan", F.round("_l", 3).alias("total_m"), F.expr(f"round({mean}, 6)").alias("mean_slope"), F.expr("round(greatest(0e0, coalesce(_m, 0e0)), 6)").alias("max_slope"), F.round("_w", 3).alias("water_m"), F.expr("round(round(coalesce(_c / nullif(_l, 0e0), 0e0), 9), 6)").alias("confidence"), F.expr(p.terrain_level_sql(f"round({mean}, 6)")).alias("terrain"))


def difficulty(segments: DataFrame) -> DataFrame:
    """Per plan a score of 0 to 100 from slope classes and fuels, and its label."""
    share = lambda cond: F.expr(f"sum(CASE WHEN {cond} THEN len ELSE 0e0 END)")
    c = p.slope_class_sql("slope")
    s = segments.groupBy("plan").agg(
        F.sum("len").alias("_l"), share(f"{c} = 'medium'").alias("_m"), share(f"{c} = 'steep'").alias("_s"), share(f"{c} = 'very_steep'").alias("_v"),
        share("veg = 'lightshrub'").alias("_a"), share("veg = 'mediumscrub'").alias("_b"), share("veg = 'heavyforest'").alias("_c"),
    )
    part = "round(least(100e0, 0.55e0 * (30 * _m + 70 * _s + 100 * _v) / greatest(1e0, _l) + 0.45e0 * (25 * _a + 55 * _b + 100 * _c) / greatest(1e0, _l)), 6)"
    s = s.select("plan", F.expr(f"CAST(floor({part} + 0.5e0) AS BIGINT)").alias("score"))
    return s.select("plan", "score", F.expr("CASE WHEN score < 25 THEN 'Low' WHEN score < 50 THEN 'Moderate' WHEN score < 75 THEN 'High' ELSE 'Extreme' END").alias("label"))


def value_pick(evaluated: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Per plan and kind the best value: the cheapest priced one within 1.5 times the fastest, else the cheapest priced, else the fastest."""
    usable = evaluated.filter("level <> 'incompatible' AND hours > 0").groupBy("plan", "kind").agg(F.collect_list(F.struct("ord", "resource", "hours", "cost")).alias("_m"))  # a catalogue at most
    fast = usable.withColumn("_f", F.expr("array_min(transform(_m, x -> named_struct('hours', x.hours, 'ord', x.ord, 'resource', x.resource)))"))
    by_cost = "transform(filter(_m, x -> x.cost > 0{0}), x -> named_struct('cost', x.cost, 'ord', x.ord, 'resource', x.resource))"
    near, priced = by_cost.format(f" AND x.hours <= _f.hours * {tolerance}e0"), by_cost.format("")
    return fast.select("plan", "kind", F.expr("_f.resource").alias("fastest"), F.expr(f"coalesce(array_min({near}).resource, array_min({priced}).resource, _f.resource)").alias("value"))
