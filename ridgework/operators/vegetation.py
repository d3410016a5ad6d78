"""Vegetation lookups: hierarchical mappings and nearest colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vegetation as v

#: Confidence of a hit: of a type and a class, as an override and else; of a formation.
HITS = {"type": (0.99, 0.95), "class": (0.94, 0.9), "formation": (0.8, 0.8)}


def hierarchical(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """Add vegetation, matched and confidence to rows (formation, class, type): by the type, else the class, else the formation; null without a hit.

    mappings: ord, formation, class, type, vegetation, is_override, active.  A level takes rows without values of the levels below it, compares
    without case and takes the first of several; inactive rows don't count.  Each level is reduced to a row a key, then joined.
    """
    out, hits = rows, []
    keys = ["formation", "class", "type"]
    for n, level in ((3, "type"), (2, "class"), (1, "formation")):
        own, below = keys[:n], keys[n:]
        m = mappings.filter("active")
        for k in own:
            m = m.filter(F.coalesce(k, F.lit("")) != "")
        for k in below:
            m = m.filter(F.coalesce(k, F.lit("")) == "")
        m = m.groupBy(*(F.lower(k).alias(f"_{k}") for k in own)).agg(F.min(F.struct("ord", "vegetation", "is_override")).alias(f"_{level}_hit"))
        cond = [F.lower(out[k]) == m[f"_{k}"] for k in own]
        out = out.join(m, cond, "left").drop(*(f"_{k}" for k in own))
        hits.append((level, F.col(f"_{level}_hit")))
    pick = lambda f: F.coalesce(*(F.when(h.isNotNull(), f(level, h)) for level, h in hits))
    found = {"vegetation": pick(lambda level, h: h["vegetation"]), "matched": pick(lambda level, h: F.lit(level)), "confidence": pick(lambda level, h: F.when(h["is_override"], HITS[level][0]).otherwise(HITS[level][1]))}
    return out.select(*rows.columns, *(x.alias(k) for k, x in found.items()))


def _legend(rows, names: str) -> str:
    return f"array({', '.join(f"named_struct({', '.join(f"'{n}', {x!r}{'e0' if isinstance(x, float) else ''}" for n, x in zip(names.split(), (i, *r)))})" for i, r in enumerate(rows))})"


def _distances(legend: str) -> str:
    return f"transform({legend}, e -> named_struct('d', pow(cr - e.r, 2) + pow(cg - e.g, 2) + pow(cb - e.b, 2), 'e', e))"


def nearest_code(colours: DataFrame, legend, tolerance: int = v.COLOUR_TOLERANCE) -> DataFrame:
    """Add code: that of the legend's nearest colour (the first of equals) within the tolerance, else null.  Colours: cr, cg, cb."""
    return colours.withColumn("_b", F.expr(f"array_min({_distances(_legend(legend, 'i code r g b'))})")).withColumn("code", F.expr(f"CASE WHEN _b.d <= {tolerance} THEN _b.e.code END")).drop("_b")


def wet_share(colours: DataFrame) -> DataFrame:
    """Add frequency: the ramp's nearest value, drawn to the nearer of its neighbours by distance; null beyond the tolerance."""
    last = len(v.WET_RAMP) - 1
    c = colours.withColumn("_d", F.expr(_distances(_legend(v.WET_RAMP, "i f r g b")))).withColumn("_b", F.expr("array_min(_d)"))
    c = c.withColumn("_n", F.expr(f"CASE WHEN _b.e.i = 0 THEN _d[1] WHEN _b.e.i = {last} THEN _d[{last - 1}] WHEN get(_d, _b.e.i - 1).d < get(_d, _b.e.i + 1).d THEN get(_d, _b.e.i - 1) ELSE get(_d, _b.e.i + 1) END"))
    f = f"CASE WHEN _b.d <= {v.WET_TOLERANCE} THEN greatest(0e0, least(1e0, _b.e.f + coalesce(sqrt(_b.d) / nullif(sqrt(_b.d) + sqrt(_n.d), 0e0), 0e0) * (_n.e.f - _b.e.f))) END"
    return c.withColumn("frequency", F.expr(f)).drop("_d", "_b", "_n")


def fire_years(colours: DataFrame) -> DataFrame:
    """Add years and coarse: of the nearest colours the most years, coarse if several are equally near; null beyond the tolerance."""
    c = colours.withColumn("_d", F.expr(_distances(_legend(v.FIRE_YEARS, "i years r g b")))).withColumn("_m", F.expr("array_min(_d).d")).withColumn("_t", F.expr("filter(_d, x -> x.d <= _m + 1e-6)"))
    hit = f"_m <= {v.COLOUR_TOLERANCE}"
    return c.withColumn("years", F.expr(f"CASE WHEN {hit} THEN array_max(transform(_t, x -> x.e.years)) END")).withColumn("coarse", F.expr(f"CASE WHEN {hit} THEN size(_t) > 1 END")).drop("_d", "_m", "_t")
