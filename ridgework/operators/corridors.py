"""Corridors of movement: clusters of routes, smoothed density of their cells, components of dense cells, and what measures do to them.

A route is rows (route, i, q, r, seconds): its cells in order, and its whole time.  Routes are clustered first, so that avenues that
share their ends stay apart; density, membership and components are then of a cluster each.  Joins are merges: rows of routes are many times those of the
table that they come from, by whose size whole fields would be broadcast, through the driver.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import hex_center, neighbour_array
from ..sources.shared import written
from .graph import connected_components, ranked
from .grid import SIZE_M, STEP_M, TILE

# Where along a route samples are taken, how many cell widths apart they may be; smoothing; share of the peak that makes a member; least cells.
FRACTIONS, NEAR_WIDTHS = (0.25, 0.5, 0.75), 7
SMOOTHING, SMOOTH_ROUNDS, MEMBER_SHARE, LEAST_CELLS = 0.5, 3, 0.12, 4
# Slices of arrival times; cover and pinch from which movement is unconstrained; overlap that makes two corridors the same.
SLICES, UNCONSTRAINED_COVER, UNCONSTRAINED_PINCH, MATCH_OVERLAP = 18, 0.6, 0.35, 0.25
_AXES = ("x0", "y0", "x1", "y1", "x2", "y2")


def route_samples(routes: DataFrame) -> DataFrame:
    """route, x0, y0, x1, y1, x2, y2: the cells' centres at a quarter, half and three quarters of the route's steps, rounded half up."""
    at = [F.col("i") == F.floor(F.lit(f) * F.col("last") + 0.5) for f in FRACTIONS]
    found = routes.filter("route IS NOT NULL").select("route", "i", "q", "r", F.max("i").over(Window.partitionBy("route")).alias("last")).filter(reduce(lambda a, b: a | b, at))
    x, y = hex_center(F.col("q"), F.col("r"), SIZE_M)
    return found.groupBy("route").agg(*(F.max(F.when(at[k], v)).alias(f"{a}{k}") for k in range(3) for a, v in (("x", x), ("y", y))))


def cluster_samples(samples: DataFrame, near: float) -> DataFrame:
    """route, cluster (its least route): routes are of one cluster if all three samples are at most ``near`` apart, and so on from route to route.

    Samples fall into boxes whose diagonal is below ``near``, so routes of one box are linked without being compared.  Boxes meet on
    coarse cells of their first two samples; the rectangles that their routes span decide most of them, and only the routes of boxes that those leave open are compared.
    """
    side = near / 2  # its diagonal is 0.71 near
    box = F.struct(*(F.floor(F.col(a) / side).cast("int").alias(a) for a in _AXES))
    points = written(samples.groupBy(*_AXES).agg(F.min("route").alias("rep")).withColumn("box", box), "samples")
    boxes = written(points.groupBy("box").agg(F.min("rep").alias("rep"), *(f(a).alias(f"{n}_{a}") for a in _AXES for n, f in (("lo", F.min), ("hi", F.max)))), "boxes")
    cell = [F.floor(F.col(f"lo_{a}") / (2 * near)).cast("int") for a in _AXES[:4]]  # boxes within ``near`` are in the same cell or the next
    left = boxes.select(F.struct(*boxes.columns).alias("s"), *(c.alias(f"c{i}") for i, c in enumerate(cell)))
    right = boxes.select(F.struct(*boxes.columns).alias("t"), *(c.alias(f"_c{i}") for i, c in enumerate(cell)))
    for i in range(4):
        right = right.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"_c{i}") - 1, F.col(f"_c{i}") + 1)))
    pairs = left.join(right.drop(*(f"_c{i}" for i in range(4))).hint("merge"), [f"c{i}" for i in range(4)]).filter("s.rep < t.rep")
    least = lambda a: F.greatest(F.col(f"s.lo_{a}") - F.col(f"t.hi_{a}"), F.col(f"t.lo_{a}") - F.col(f"s.hi_{a}"), F.lit(0.0))
    most = lambda a: F.greatest(F.col(f"s.hi_{a}") - F.col(f"t.lo_{a}"), F.col(f"t.hi_{a}") - F.col(f"s.lo_{a}"))
    all_near = lambda gap: reduce(lambda a, b: a & b, (F.sqrt(gap(f"x{k}") * gap(f"x{k}") + gap(f"y{k}") * gap(f"y{k}")) <= near for k in range(3)))
    pairs = written(pairs.filter(all_near(least)).select(F.col("s.rep").alias("a"), F.col("t.rep").alias("b"), F.col("s.box").alias("box"), F.col("t.box").alias("box2"), all_near(most).alias("sure")), "box-pairs")
    far = points.select(F.col("box").alias("box2"), *(F.col(a).alias(f"_{a}") for a in _AXES))
    apart = lambda a: F.abs(F.col(a) - F.col(f"_{a}"))
    compared = pairs.filter("NOT sure").join(points.drop("rep").hint("merge"), "box").join(far.hint("merge"), "box2").filter(all_near(apart)).select("a", "b").distinct()
    labels = connected_components(pairs.filter("sure").select("a", "b").unionByName(compared))
    of_box = boxes.select("box", F.col("rep").alias("node")).join(labels.hint("merge"), "node", "left").select("box", F.coalesce("component", "node").alias("cluster"))
    return samples.select("route", box.alias("box")).join(of_box.hint("merge"), "box").select("route", "cluster")


def cluster_routes(routes: DataFrame, near: float = NEAR_WIDTHS * STEP_M) -> DataFrame:
    return cluster_samples(route_samples(routes), near)


def components(members: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``first``, the least cell (r, q) of the component of neighbouring cells of a cluster that a member (cluster, q, r) is in.

    A tile's cells are joined by one task; components that meet over rims are joined as nodes of a graph, so a component may wind through any number of tiles.
    """

    def local(cells: pd.DataFrame) -> pd.DataFrame:
        left, labels = set(zip(cells["r"], cells["q"])), {}
        for start in sorted(left):
            if start in labels:
                continue
            labels[start], queue = start, [start]
            while queue:
                r, q = queue.pop()
                for at in ((r, q + 1), (r - 1, q + 1), (r - 1, q), (r, q - 1), (r + 1, q - 1), (r + 1, q)):
                    if at in left and at not in labels:
                        labels[at] = start
                        queue.append(at)
        own = [labels[c] for c in zip(cells["r"], cells["q"])]
        return pd.DataFrame({"cluster": cells["cluster"], "q": cells["q"], "r": cells["r"], "fr": [f[0] for f in own], "fq": [f[1] for f in own]})

    tiled = members.select("cluster", "q", "r").groupBy("cluster", F.floor(F.col("q") / tile), F.floor(F.col("r") / tile))
    found = tiled.applyInPandas(local, "cluster long, q int, r int, fr int, fq int")
    found = written(found.select("cluster", "q", "r", F.struct("cluster", F.col("fr").alias("r"), F.col("fq").alias("q")).alias("node")), "tiles")
    # half of the directions see each pair of neighbours once
    out = found.withColumn("n", F.explode(F.slice(neighbour_array(), 1, 3))).select("cluster", F.col("node").alias("a"), "q", "r", (F.col("q") + F.col("n.dq")).alias("q2"), (F.col("r") + F.col("n.dr")).alias("r2"))
    out = out.filter(f"floor(q / {tile}) <> floor(q2 / {tile}) OR floor(r / {tile}) <> floor(r2 / {tile})").drop("q", "r")
    rims = out.join(found.select("cluster", F.col("q").alias("q2"), F.col("r").alias("r2"), F.col("node").alias("b")).hint("merge"), ["cluster", "q2", "r2"]).select("a", "b").distinct()
    labels = connected_components(rims)
    return found.join(labels.hint("merge"), "node", "left").select("cluster", "q", "r", F.coalesce("component", "node").alias("_f")).select("cluster", "q", "r", F.struct("_f.r", "_f.q").alias("first"))


def density(routes: DataFrame, clusters: DataFrame, cells: DataFrame, rounds: int = SMOOTH_ROUNDS, weight: float = SMOOTHING, by_time: bool = True) -> DataFrame:
    """cluster, q, r, density, routes (that pass the very cell): the routes of a cluster laid on the grid's cells and smoothed over neighbours.

    A route counts by the best time over its own, at least 0.05 (1 if ``by_time`` is false, or without a time).  A cell's neighbours are those in the grid.
    """
    best = routes.agg(F.min("seconds").alias("_best"))  # one row
    w = F.when(F.col("seconds") > 0, F.greatest(F.lit(0.05), F.col("_best") / F.col("seconds"))).otherwise(1.0) if by_time else F.lit(1.0)
    crossed = routes.select("route", "q", "r", "seconds").distinct().join(clusters.hint("merge"), "route").crossJoin(F.broadcast(best))
    raw = crossed.groupBy("cluster", "q", "r").agg(F.sum(w).alias("v"), F.count(F.lit(1)).alias("routes"))
    sides = neighbour_array()
    present = cells.select("q", "r").withColumn("n", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("dir"), F.lit(0).alias("dq"), F.lit(0).alias("dr"))), sides)))
    degree = present.groupBy((F.col("q") + F.col("n.dq")).alias("q"), (F.col("r") + F.col("n.dr")).alias("r")).agg(F.sum((F.col("n.dir") >= 0).cast("int")).alias("near"), F.bool_or(F.col("n.dir") < 0).alias("in")).filter("in").drop("in")
    s = raw.join(cells.select("q", "r").hint("merge"), ["q", "r"], "left_semi").select("cluster", "q", "r", "v")
    for _ in range(rounds):  # what a cell sends to its neighbours; cells that nothing reaches stay at 0
        sent = s.withColumn("n", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("dir"), F.lit(0).alias("dq"), F.lit(0).alias("dr"))), sides)))
        g = sent.groupBy("cluster", (F.col("q") + F.col("n.dq")).alias("q"), (F.col("r") + F.col("n.dr")).alias("r"))
        g = g.agg(F.sum(F.when(F.col("n.dir") < 0, F.col("v")).otherwise(0.0)).alias("own"), F.sum(F.when(F.col("n.dir") >= 0, F.col("v")).otherwise(0.0)).alias("sum")).join(degree.hint("merge"), ["q", "r"])
        s = g.select("cluster", "q", "r", F.when(F.col("near") > 0, F.col("own") * (1 - weight) + F.col("sum") / F.col("near") * weight).otherwise(F.col("own")).alias("v"))
    return s.join(raw.select("cluster", "q", "r", "routes").hint("merge"), ["cluster", "q", "r"], "left").select("cluster", "q", "r", F.col("v").alias("density"), F.coalesce("routes", F.lit(0).cast("long")).alias("routes"))


def corridor_cells(routes: DataFrame, clusters: DataFrame, cells: DataFrame, share: float = MEMBER_SHARE, least: int = LEAST_CELLS, tile: int = TILE) -> DataFrame:
    """Written table cluster, first, q, r, density (of the peak, 1 at most), routes: the cells of corridors, which are components of at least ``least`` member cells.

    Members have at least ``share`` of the largest density of all clusters.
    """
    d = written(density(routes, clusters, cells), "density")
    peak = d.agg(F.max("density").alias("_peak"))  # one row
    # the last bits of a sum depend on its order: they don't decide who is a member
    member = written(d.crossJoin(F.broadcast(peak)).filter(F.round(F.col("density") - F.col("_peak") * share, 9) >= 0).filter("_peak > 0"), "members")
    found = components(member, tile)
    kept = found.groupBy("cluster", "first").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rows = found.join(kept.drop("n").hint("merge"), ["cluster", "first"]).join(member.hint("merge"), ["cluster", "q", "r"])
    return written(rows.select("cluster", "first", "q", "r", F.least(F.lit(1.0), F.col("density") / F.col("_peak")).alias("density"), "routes"), "corridor-cells")


def corridors(found: DataFrame, routes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Written table cluster, first, rank, cells, routes, share, median_s, fastest_s: corridors ranked by routes, then by cells, then by their place.

    A corridor's routes are those of its cluster that pass any of its cells; the median of an even number is the mean of the two in the middle.
    """
    of = routes.select("route", "q", "r").distinct().join(clusters.hint("merge"), "route").join(found.select("cluster", "first", "q", "r").hint("merge"), ["cluster", "q", "r"]).select("cluster", "first", "route").distinct()
    times = of.join(routes.groupBy("route").agg(F.max("seconds").alias("seconds")).hint("merge"), "route")
    use = times.groupBy("cluster", "first").agg(F.count(F.lit(1)).alias("routes"), F.median("seconds").alias("median_s"), F.min("seconds").alias("fastest_s"))
    size = found.groupBy("cluster", "first").agg(F.count(F.lit(1)).alias("cells"))
    n = routes.agg(F.countDistinct("route").alias("_n"))  # one row
    rows = size.join(use.hint("merge"), ["cluster", "first"], "left").crossJoin(F.broadcast(n))
    rows = rows.withColumn("routes", F.coalesce("routes", F.lit(0).cast("long"))).withColumn("share", F.col("routes") / F.greatest(F.col("_n"), F.lit(1))).drop("_n")
    return written(ranked(rows, [F.col("routes").desc(), F.col("cells").desc(), "cluster", "first"]), "corridors")


def width_slices(found: DataFrame, facts: DataFrame, slices: int = SLICES) -> DataFrame:
    """cluster, first, bottleneck, widest, unrestricted, restricted, severe, water: cells of the narrowest and widest of the slices of arrival time, and shares of cells.

    facts: q, r, arrival (null: not reached), mobility (null counts as severely-restricted), water.  Without two arrivals, or all alike, both widths are all cells.
    """
    x = found.select("cluster", "first", "q", "r").join(facts.hint("merge"), ["q", "r"], "left")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    mobility = F.coalesce("mobility", F.lit("severely-restricted"))
    g = x.groupBy("cluster", "first").agg(
        F.min("arrival").alias("lo"), F.max("arrival").alias("hi"), F.count(F.lit(1)).alias("n"), share(mobility == "unrestricted").alias("unrestricted"), share(mobility == "restricted").alias("restricted"),
        share(mobility == "severely-restricted").alias("severe"), share(F.coalesce("water", F.lit(False))).alias("water"),
    )
    at = x.filter("arrival IS NOT NULL").join(g.select("cluster", "first", "lo", "hi").filter("hi > lo").hint("merge"), ["cluster", "first"])
    at = at.withColumn("slice", F.least(F.lit(slices - 1), F.floor((F.col("arrival") - F.col("lo")) / (F.col("hi") - F.col("lo")) * slices)))
    width = at.groupBy("cluster", "first", "slice").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster", "first").agg(F.min("c").alias("bottleneck"), F.max("c").alias("widest"))
    return g.join(width.hint("merge"), ["cluster", "first"], "left").select("cluster", "first", F.coalesce("bottleneck", "n").alias("bottleneck"), F.coalesce("widest", "n").alias("widest"), "unrestricted", "restricted", "severe", "water")


def summary(ranked_corridors: DataFrame, widths: DataFrame, mover_width_m: float) -> DataFrame:
    """What ``corridors`` and ``width_slices`` tell together: ease, width, how many abreast, pinch and risk of each corridor."""
    x = ranked_corridors.join(widths.hint("merge"), ["cluster", "first"])
    x = x.withColumn("pinch", F.when(F.col("widest") > 0, F.col("bottleneck") / F.col("widest")).otherwise(1.0)).withColumn("width_m", F.col("bottleneck") * STEP_M)
    x = x.withColumn("abreast", F.floor(F.col("width_m") / mover_width_m).cast("long") if mover_width_m > 0 else F.lit(0).cast("long"))
    ease = F.when(F.col("unrestricted") >= 0.6, "unrestricted").when(F.col("unrestricted") >= 0.25, "restricted").otherwise("severely-restricted")
    frontage = F.when(F.col("abreast") >= 3, "multi-lane").when(F.col("abreast") == 2, "two-abreast").otherwise("single-file")
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * (F.col("restricted") + F.col("severe")) + 0.3 * F.col("water") + 0.3 * (1 - F.col("pinch"))))
    return x.withColumns({"ease": ease, "frontage": frontage, "risk": risk})


def totals(summaries: DataFrame, routes: DataFrame, cells: DataFrame) -> DataFrame:
    """One row of the field: corridors, cells, routed_cells, coverage, pinch (of the first in rank), unconstrained, likely (1 where there is one) and risky (the rank of the highest risk)."""
    s = summaries.agg(
        F.count(F.lit(1)).alias("corridors"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.min(F.struct("rank", "pinch"))["pinch"].alias("pinch"), F.min("rank").alias("likely"),
        F.max(F.struct(F.round("risk", 9).alias("x"), (-F.col("rank")).alias("k")))["k"].alias("k"),
    )
    n = cells.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(routes.select("q", "r").distinct().agg(F.count(F.lit(1)).alias("routed_cells"))))
    out = s.crossJoin(F.broadcast(n)).withColumn("coverage", F.coalesce(F.try_divide("cells", "n"), F.lit(0.0)))
    return out.select("corridors", "cells", "routed_cells", "coverage", "pinch", F.coalesce((F.col("coverage") >= UNCONSTRAINED_COVER) & (F.col("pinch") > UNCONSTRAINED_PINCH), F.lit(False)).alias("unconstrained"), "likely", (-F.col("k")).alias("risky"))


def effects(before: DataFrame, before_cells: DataFrame, after: DataFrame, after_cells: DataFrame) -> DataFrame:
    """Per corridor before the measures what became of it: rank_before, rank_after, status, overlap, routes and widths before and after, delay_s.

    Corridors meet on the cells they share; the match is the one after that holds most of a corridor's cells, of equals the first in rank.  Below a quarter the corridor has collapsed (null delay).
    A match with more routes is displaced-into; one a minute slower, of less than three quarters of the width or with fewer routes is degraded.
    """
    key = lambda cells, of: cells.join(of.select("cluster", "first", "rank").hint("merge"), ["cluster", "first"]).select("rank", "q", "r")
    shared = key(before_cells, before).join(key(after_cells, after).withColumnRenamed("rank", "rank2").hint("merge"), ["q", "r"]).groupBy("rank", "rank2").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("rank").agg(F.max(F.struct("shared", (-F.col("rank2")).alias("k"))).alias("m")).select("rank", F.col("m.shared").alias("shared"), (-F.col("m.k")).alias("rank2"))
    a = after.select(F.col("rank").alias("rank2"), F.col("routes").alias("routes_after"), F.col("median_s").alias("_median2"), F.col("width_m").alias("width_after"))
    x = before.join(best.hint("merge"), "rank", "left").withColumn("overlap", F.coalesce(F.col("shared") / F.col("cells"), F.lit(0.0))).withColumn("rank2", F.when(F.col("overlap") >= MATCH_OVERLAP, F.col("rank2"))).join(a.hint("merge"), "rank2", "left")
    delay = F.col("_median2") - F.col("median_s")
    status = (
        F.when(F.col("rank2").isNull(), "collapsed").when(F.col("routes_after") > F.col("routes"), "displaced-into")
        .when(F.coalesce(delay > 60, F.lit(True)) | (F.col("width_after") < F.col("width_m") * 0.75) | (F.col("routes_after") < F.col("routes")), "degraded").otherwise("unchanged")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select(F.col("rank").alias("rank_before"), F.col("rank2").alias("rank_after"), status.alias("status"), "overlap", F.col("routes").alias("routes_before"), zero("routes_after").alias("routes_after"), delay.alias("delay_s"), F.col("width_m").alias("width_before"), F.coalesce("width_after", F.lit(0.0)).alias("width_after"))


def impact(found: DataFrame) -> DataFrame:
    """One row: how many corridors collapsed, degraded or took movement in, and their weighted share."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    x = found.agg(F.count(F.lit(1)).alias("corridors"), n("collapsed").alias("collapsed"), n("degraded").alias("degraded"), n("displaced-into").alias("displaced"))
    return x.withColumn("score", (F.col("collapsed") + 0.5 * F.col("degraded") + 0.25 * F.col("displaced")) / F.greatest(F.lit(1), F.col("corridors")))
