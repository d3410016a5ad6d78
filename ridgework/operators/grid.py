"""Hex-grid operators: stencils are equi-joins or scatters on the cell key, never all-pairs."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mobility as m
from ..functions.geo import hex_center, neighbour_array
from ..sources.shared import dropped, spread, written

SIZE_M = 25.0
STEP_M = SIZE_M * 3**0.5
# Trail and boundary factors, the gap in vegetation cost that makes a boundary, costs of vegetation and slope.
TRAIL, BOUNDARY, BOUNDARY_GAP = 0.35, 0.65, 1.0
VEG_COST_SQL = "(CASE {v} WHEN 'grassland' THEN 1.0e0 WHEN 'lightshrub' THEN 1.4e0 WHEN 'mediumscrub' THEN 2.2e0 ELSE 3.8e0 END)"
SLOPE_COST_SQL = "((1 + 0.6e0 * pow({s} / 15, 2) + pow({s} / 30, 2)) * (CASE WHEN {s} >= 25 THEN 1.6e0 ELSE 1e0 END) * (CASE WHEN {s} >= 45 THEN 3e0 ELSE 1e0 END))"
# Severity of vegetation, anchors of the severity of slope.
VEG_SEVERITY_SQL = "(CASE veg WHEN 'grassland' THEN 0e0 WHEN 'lightshrub' THEN 0.18e0 WHEN 'mediumscrub' THEN 0.38e0 ELSE 0.55e0 END)"
SEVERITY = ((0, 0.0), (10, 0.14), (25, 0.5), (35, 0.78), (45, 1.0))
ISOCHRONES = (15, 30, 60, 120, 180)
#: Cells along a side of a tile, in which components are found by one task, and of one in which costs are relaxed; tables of improved costs that are merged.
TILE, COST_TILE, MERGE_EVERY = 64, 256, 6
#: Lines that are drawn together, and steps of one before those of the next.
SO_MANY, STEPS = 64, 128
#: Tiles up to this number are named in a filter.
MOST_TILES = 10_000


def edges(cells: DataFrame) -> DataFrame:
    """Directed edges between neighbouring cells, both ends' columns (b_ for the far end).

    Joins of cells with cells are merges here: files are so much smaller than the rows derived from them that whole grids would be broadcast.
    """
    far = cells.select(*(F.col(c).alias(f"b_{c}") for c in cells.columns))
    near = cells.withColumn("_n", F.explode(neighbour_array())).select("*", (F.col("q") + F.col("_n.dq")).alias("b_q"), (F.col("r") + F.col("_n.dr")).alias("b_r"), F.col("_n.dir").alias("dir")).drop("_n")
    return near.join(far.hint("merge"), ["b_q", "b_r"]).withColumn("grade", (F.col("b_elev") - F.col("elev")) / STEP_M).withColumn("slope", F.degrees(F.atan(F.abs("grade"))))


def around(cells: DataFrame, *columns: str) -> DataFrame:
    """What cells send to themselves (dir -1) and their six neighbours: q, r of the receiver, dir from it to the sender, b_ columns.

    A grouping by (q, r) then sees a cell with all its neighbours in one shuffle; groups without a row of dir -1 are outside the grid.
    """
    to = F.concat(F.array(F.struct(F.lit(-1).alias("dir"), F.lit(0).alias("dq"), F.lit(0).alias("dr"))), neighbour_array())
    sent = cells.select("q", "r", *(F.col(c).alias(f"b_{c}") for c in columns), F.explode(to).alias("n"))
    # the neighbour in direction i sees the sender in direction i + 3
    return sent.select((F.col("q") + F.col("n.dq")).alias("q"), (F.col("r") + F.col("n.dr")).alias("r"), F.when(F.col("n.dir") < 0, -1).otherwise(F.pmod(F.col("n.dir") + 3, F.lit(6))).alias("dir"), *(f"b_{c}" for c in columns))


def _own(x: str) -> Column:
    return F.max(F.when(F.col("dir") == -1, F.expr(x)))


def _near(f, x: str) -> Column:
    return f(F.when(F.col("dir") >= 0, F.expr(x)))


def boundaries(cells: DataFrame) -> DataFrame:
    """q, r, boundary: whether some neighbour's vegetation cost differs by 1 or more."""
    v = VEG_COST_SQL.format(v="b_veg")
    g = around(cells, "veg").groupBy("q", "r").agg(_own(v).alias("v"), _near(F.min, v).alias("lo"), _near(F.max, v).alias("hi")).filter("v IS NOT NULL")
    return g.select("q", "r", F.expr(f"coalesce(greatest(hi - v, v - lo) >= {BOUNDARY_GAP}e0, false)").alias("boundary"))


def marked_edges(cells: DataFrame) -> DataFrame:
    """Edges with both ends' boundary marks."""
    return edges(cells.join(boundaries(cells).hint("merge"), ["q", "r"]))


def route_cost() -> Column:
    """Cost of a marked edge for route search: metres, slope cost, mean vegetation cost; on trails and along boundaries (both ends) less."""
    veg = (F.expr(VEG_COST_SQL.format(v="veg")) + F.expr(VEG_COST_SQL.format(v="b_veg"))) / 2
    trail = F.when(F.col("trail") & F.col("b_trail"), TRAIL).otherwise(1.0)
    border = F.when(F.col("boundary") & F.col("b_boundary"), BOUNDARY).otherwise(1.0)
    return STEP_M * F.expr(SLOPE_COST_SQL.format(s="slope")) * veg * trail * border


def stencil(cells: DataFrame) -> DataFrame:
    """Per cell: neighbours, mean and largest slope to them, mean cost a metre; cells without neighbours have 0.6 and no slope."""
    e = marked_edges(cells).withColumn("cost", route_cost() / STEP_M)
    agg = e.groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"), F.avg("slope").alias("_a"), F.max("slope").alias("_m"), F.avg("cost").alias("_c"))
    out = cells.select("q", "r", "veg").join(agg.hint("merge"), ["q", "r"], "left")
    return out.select("q", "r", "veg", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.coalesce("_a", F.lit(0.0)), 6).alias("mean_slope"), F.round("_m", 6).alias("max_slope"), F.round(F.coalesce("_c", F.lit(0.6)), 6).alias("cost"))


def normalised(cells: DataFrame) -> DataFrame:
    """Add normal: the cost between the least (0) and the largest (1) of all, 0.5 if all are alike.  Costs are written once; one row of bounds is broadcast."""
    cells = written(cells, "costs")
    bounds = cells.agg(F.min("cost").alias("_lo"), F.max("cost").alias("_hi"))
    return cells.crossJoin(F.broadcast(bounds)).withColumn("normal", F.expr("CASE WHEN _hi - _lo > 1e-9 THEN (cost - _lo) / (_hi - _lo) ELSE 0.5e0 END")).drop("_lo", "_hi")


def smooth(cells: DataFrame, value: str, rounds: int = 3, weight: float = 0.5) -> DataFrame:
    """q, r and ``value``, ``rounds`` times drawn to the mean of the neighbours; without neighbours it stays."""
    s = cells.select("q", "r", value)
    for _ in range(rounds):
        g = around(s, value).groupBy("q", "r").agg(_own(f"b_{value}").alias("x"), _near(F.avg, f"b_{value}").alias("m"), F.bool_or(F.col("dir") == -1).alias("in")).filter("in")
        s = g.select("q", "r", (F.col("x") * (1 - weight) + F.coalesce("m", "x") * weight).alias(value))
    return s


def plane_fit(cells: DataFrame) -> DataFrame:
    """Per cell the plane z = a + b x + c y through it and its neighbours: cross slope, roughness (spread of the neighbours' residuals), and its place.

    Without a plane (fewer than 3 points, or all in line) the steepest neighbour gives the slope.  Place: ridge or valley where the
    height above the neighbours' mean is more than half the mean difference.
    """
    g = around(cells, "elev").groupBy("q", "r").agg(F.collect_list(F.struct("dir", F.col("b_elev").alias("z"))).alias("_all"))  # seven at most
    g = g.withColumn("z", F.expr("get(filter(_all, x -> x.dir = -1), 0).z")).filter("z IS NOT NULL")
    xs, ys = zip(*((STEP_M * (dq + dr / 2), SIZE_M * 1.5 * dr) for dq, dr in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))))
    table = lambda v: f"array({', '.join(f'{x!r}e0' if 'e' not in repr(x) else f'CAST({x!r} AS DOUBLE)' for x in v)})"
    g = g.withColumn("_p", F.expr(f"transform(filter(_all, x -> x.dir >= 0), x -> named_struct('x', {table(xs)}[x.dir], 'y', {table(ys)}[x.dir], 'z', x.z))"))
    total = lambda e: f"aggregate(_p, 0e0, (s, p) -> s + {e})"
    g = g.selectExpr("q", "r", "z", "_p", "1e0 + size(_p) AS n", *(f"{total(e)} AS {name}" for name, e in (("sx", "p.x"), ("sy", "p.y"), ("sxx", "p.x * p.x"), ("syy", "p.y * p.y"), ("sxy", "p.x * p.y"), ("sxz", "p.x * p.z"), ("syz", "p.y * p.z"))), f"z + {total('p.z')} AS sz")
    g = g.selectExpr("*", *(f"{e} AS {name}" for name, e in CRAMER.items()))
    g = g.selectExpr("*", "CASE WHEN n >= 3 AND abs(det) >= 1e-6 THEN sqrt(pow(db / det, 2) + pow(dc / det, 2)) ELSE coalesce(array_max(transform(_p, p -> abs(p.z - z) / sqrt(p.x * p.x + p.y * p.y))), 0e0) END AS tan_")
    g = g.selectExpr("*", "CASE WHEN n >= 3 AND abs(det) >= 1e-6 THEN transform(_p, p -> p.z - (da / det + db / det * p.x + dc / det * p.y)) END AS _res")
    g = g.selectExpr("*", "aggregate(_res, 0e0, (s, x) -> s + x) / nullif(size(_res), 0) AS _mean", "(sz - z) / nullif(n - 1, 0) AS _nz", "aggregate(_p, 0e0, (s, p) -> s + abs(p.z - z)) / nullif(n - 1, 0) AS _relief")
    return g.selectExpr("q", "r", "round(degrees(atan(tan_)), 5) AS cross_slope", "round(coalesce(sqrt(aggregate(_res, 0e0, (s, x) -> s + pow(x - _mean, 2)) / nullif(size(_res), 0)), 0e0), 5) AS roughness", f"{PLACE_SQL.format(own='z', mean='_nz', relief='_relief')} AS place")


def with_tile(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Add tile, a number of the tile that a cell is in, by which stored tables are partitioned."""
    return cells.withColumn("tile", F.floor(F.col("q") / tile) * 1_000_000 + F.floor(F.col("r") / tile))


def refitted(cells: DataFrame, fresh: DataFrame, tile: int = TILE, most_tiles: int = MOST_TILES) -> DataFrame:
    """The rows of ``plane_fit`` that new cells (q, r) change: their own and those of their neighbours; all others hold as they are.

    ``cells`` has all cells, the new ones among them, and ``tile`` as from ``with_tile``; where it is a table partitioned by tile, only tiles of new cells and those around are
    read.  The list of tiles is looked up in the driver while it has at most ``most_tiles`` entries; beyond, every tile is read.
    """
    step = F.concat(F.array(F.struct(F.lit(-1).alias("dir"), F.lit(0).alias("dq"), F.lit(0).alias("dr"))), neighbour_array())
    grow = lambda c: c.select("q", "r", F.explode(step).alias("n")).select((F.col("q") + F.col("n.dq")).cast("int").alias("q"), (F.col("r") + F.col("n.dr")).cast("int").alias("r")).distinct()
    changed = grow(fresh.select("q", "r").distinct())
    needed = grow(changed)
    tiles = with_tile(needed, tile).select("tile").distinct().limit(most_tiles + 1).collect()
    near = cells.filter(F.col("tile").isin([r["tile"] for r in tiles])) if len(tiles) <= most_tiles else cells
    fitted = plane_fit(near.drop("tile").join(needed.hint("merge"), ["q", "r"], "left_semi"))
    return fitted.join(changed.hint("merge"), ["q", "r"], "left_semi")


def merged_planes(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored rows of ``plane_fit`` with the changed ones in their place."""
    return stored.select(*changed.columns).join(changed.select("q", "r").hint("merge"), ["q", "r"], "left_anti").unionByName(changed)


#: Cramer's rule for the three coefficients of a plane.
CRAMER = {
    "det": "n * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy)",
    "da": "sz * (sxx * syy - sxy * sxy) - sx * (sxz * syy - sxy * syz) + sy * (sxz * sxy - sxx * syz)",
    "db": "n * (sxz * syy - sxy * syz) - sz * (sx * syy - sxy * sy) + sy * (sx * syz - sxz * sy)",
    "dc": "n * (sxx * syz - sxz * sxy) - sx * (sx * syz - sxz * sy) + sz * (sx * sxy - sxx * sy)",
}
PLACE_SQL = "(CASE WHEN round({relief}, 9) > 0 AND round({own} - {mean} - 0.5e0 * {relief}, 9) > 0 THEN 'ridge' WHEN round({relief}, 9) > 0 AND round({mean} - {own} - 0.5e0 * {relief}, 9) > 0 THEN 'valley' ELSE 'midslope' END)"


def foot_seconds(e: DataFrame) -> DataFrame:
    """Seconds on foot per edge: on the network if both ends are on a trail, at least 0.1 km/h."""
    return e.select("q", "r", "dir", F.expr(f"round({STEP_M!r} / 1000 / greatest(0.1e0, {m.foot_sql('trail AND b_trail', 'grade')}) * 3600, 6)").alias("seconds"))


#: What an edge means to a mover, over the columns of an edge and of a mover; on: both ends on a trail.
EDGE_SQL = {
    "depth": f"(CASE WHEN NOT on_ THEN {m.ford_sql('b_water_body', 'b_waterway', 'b_frequency')} END)",
    "blocked": f"(CASE WHEN NOT on_ AND slope > max_climb THEN 'climb' WHEN NOT on_ AND side > max_side THEN 'side-slope' WHEN depth IS NOT NULL AND NOT coalesce(depth <= ford, false) THEN 'ford' WHEN NOT on_ AND {m.too_dense_sql('b_veg')} THEN 'vegetation' END)",
    "ceiling": f"(CASE WHEN on_ THEN CASE WHEN b_highway IS NOT NULL THEN {m.ceiling_sql('b_highway', 'b_surface', 'b_tracktype', 'b_smoothness')} ELSE {m.ceiling_sql('highway', 'surface', 'tracktype', 'smoothness')} END END)",
    "base": f"(CASE model WHEN 'offpath' THEN {m.foot_sql('on_', 'grade')} WHEN 'tobler' THEN {m.foot_sql('true', 'grade')} ELSE CASE WHEN on_ THEN CASE WHEN model = 'vehicle' THEN least(road_kmh, coalesce(ceiling, road_kmh)) ELSE road_kmh END ELSE road_kmh * cross_factor END * greatest(0.05e0, {m.grade_factor_sql('slope', 'max_climb')}) END)",
    "kmh": f"greatest(0.1e0, base * coalesce(load, 1e0) * (CASE WHEN dark THEN night ELSE 1e0 END) * (CASE WHEN depth IS NULL THEN 1e0 ELSE {m.FORD_FACTOR}e0 END))",
    "ratio": f"greatest(slope / max_climb, side / max_side, CASE WHEN class = 'wheeled' THEN width / greatest(0.1e0, {m.gap_sql('b_veg')}) ELSE 0e0 END)",
    "mobility": f"(CASE WHEN blocked IS NOT NULL THEN 'severely-restricted' WHEN ratio > {m.NEAR}e0 OR (b_veg IN ('heavyforest', 'mediumscrub') AND NOT b_trail) OR depth IS NOT NULL THEN 'restricted' ELSE 'unrestricted' END)",
}


def edge_mobility(e: DataFrame, movers: DataFrame, night: bool = False) -> DataFrame:
    """Per edge and mover: seconds (null if blocked), what blocks it, mobility class.

    Gates in order: climb, side slope of the cell that is left (both only off the network), ford judged at the far end, vegetation of
    the far end; then the mover's speed model with load, night and ford factors, at least 0.1 km/h.  Movers are a few rows.
    """
    x = e.withColumn("on_", F.col("trail") & F.col("b_trail")).withColumn("dark", F.lit(night))
    for name in ("depth", "ceiling"):  # the same for all movers
        x = x.withColumn(name, F.expr(EDGE_SQL[name]))
    x = x.crossJoin(F.broadcast(movers))
    for name, sql in EDGE_SQL.items():
        x = x if name in ("depth", "ceiling") else x.withColumn(name, F.expr(sql))
    return x.select("q", "r", "dir", "mover", F.expr(f"CASE WHEN blocked IS NULL THEN round({STEP_M!r} / 1000 / kmh * 3600, 5) END").alias("seconds"), "blocked", "mobility")


#: The same for a cell, by the steepest way to a neighbour.
CELL_SQL = {
    "depth": f"(CASE WHEN NOT trail THEN {m.ford_sql()} END)",
    "blocked": f"(NOT trail AND (steepest > max_climb OR side > max_side OR {m.too_dense_sql('veg')} OR (depth IS NOT NULL AND NOT coalesce(depth <= ford, false))))",
    "mobility": f"(CASE WHEN blocked THEN 'severely-restricted' WHEN steepest / max_climb > {m.NEAR}e0 OR side / max_side > {m.NEAR}e0 OR (veg IN ('heavyforest', 'mediumscrub') AND NOT trail) OR depth IS NOT NULL THEN 'restricted' ELSE 'unrestricted' END)",
}


def trafficability(cells: DataFrame, movers: DataFrame) -> DataFrame:
    """Per cell and mover its mobility class."""
    steep = around(cells, "elev").groupBy("q", "r").agg(_own("b_elev").alias("z"), _near(F.min, "b_elev").alias("lo"), _near(F.max, "b_elev").alias("hi")).filter("z IS NOT NULL")
    steep = steep.select("q", "r", F.expr(f"coalesce(degrees(atan(greatest(hi - z, z - lo) / {STEP_M!r})), 0e0)").alias("steepest"))
    x = cells.join(steep.hint("merge"), ["q", "r"]).crossJoin(F.broadcast(movers))
    for name, sql in CELL_SQL.items():
        x = x.withColumn(name, F.expr(sql))
    return x.select("q", "r", "mover", "mobility")


def _tile_shape(cells: DataFrame, tile: int) -> tuple[int, int, int, int]:
    """(least q, least r, width, height): tiles of at most tile * tile cells, counted from the least cell; those of a narrow grid span it and are longer."""
    q0, q1, r0, r1 = cells.agg(F.min("q"), F.max("q"), F.min("r"), F.max("r")).first()
    if q0 is None:
        return 0, 0, tile, tile
    wide, high = q1 - q0 + 1, r1 - r0 + 1
    if min(wide, high) >= tile:
        return q0, r0, tile, tile
    return (q0, r0, wide, tile * tile // wide) if wide <= high else (q0, r0, tile * tile // high, high)


def accumulated_cost(weights: DataFrame, sources: DataFrame, tile: int = COST_TILE) -> DataFrame:
    """q, r, cost: least sums of weights from the sources (q, r) to all cells that they reach.

    weights: q, r, b_q, b_r, w of directed edges, w positive or null (no way).  The grid is cut into tiles; in a round each tile that
    some improved cost has entered is relaxed by one task (a tile has tile * tile cells at most, whatever the grid's size and shape), and what crosses its
    rim opens other tiles.  A round writes what it has improved and nothing else; every few rounds that is merged.  Rounds end when nothing is open, after
    about as many as the longest least path enters tiles; lost executors cost one round.  A round reads the edges of its own tiles, by their numbers up to MOST_TILES.
    """
    ways = written(weights.filter("w IS NOT NULL").select("q", "r", "b_q", "b_r", "w"), "ways")
    ql, rl, wide, high = _tile_shape(ways, tile)
    of = lambda q, r: F.floor((F.col(q) - ql) / wide) * 2**32 + F.floor((F.col(r) - rl) / high)
    e = written(ways.withColumn("tile", of("q", "r")).repartition("tile").sortWithinPartitions("tile"), "edges")
    dropped(ways)
    # round: when a cost was found; open: it was found outside its own tile, which has not been relaxed with it
    tables = [written(sources.select("q", "r", F.lit(0.0).alias("cost"), F.lit(True).alias("open"), F.lit(0).alias("round")).distinct(), "cost")]

    def relax(of_tile: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        q0, r0 = (int(known[c].iloc[0] - low) // n * n + low for c, low, n in (("q", ql, wide), ("r", rl, high)))
        inside = lambda q, r: (q >= q0) & (q < q0 + wide) & (r >= r0) & (r < r0 + high)
        at = lambda q, r: (q - q0 + 1) * (high + 2) + (r - r0 + 1)  # noqa: E731  with a rim of the cells around
        if len(of_tile) == 0:
            return pd.DataFrame({"q": [], "r": [], "cost": [], "open": []}).astype({"q": "int32", "r": "int32", "open": "bool"})
        start = at(of_tile["q"].to_numpy(np.int64), of_tile["r"].to_numpy(np.int64))
        order = np.argsort(start, kind="stable")
        first = np.searchsorted(start[order], np.arange((wide + 2) * (high + 2) + 1)).tolist()
        bq, br = of_tile["b_q"].to_numpy(np.int64)[order], of_tile["b_r"].to_numpy(np.int64)[order]
        to, w, stays = at(bq, br).tolist(), of_tile["w"].to_numpy(np.float64)[order].tolist(), inside(bq, br).tolist()
        cost = np.full((wide + 2) * (high + 2), np.inf)
        own = at(known["q"].to_numpy(np.int64), known["r"].to_numpy(np.int64))
        cost[own] = known["cost"]
        cost = cost.tolist()
        heap = [(cost[i], i) for i in own[known["open"].to_numpy()].tolist()]
        heapq.heapify(heap)
        better: set[int] = set()
        while heap:
            c, i = heapq.heappop(heap)
            if c > cost[i]:
                continue
            for k in range(first[i], first[i + 1]):
                j, d = to[k], c + w[k]
                if d < cost[j]:
                    cost[j] = d
                    better.add(j)
                    if stays[k]:
                        heapq.heappush(heap, (d, j))
        found = np.array(sorted(better), np.int64)
        q, r = found // (high + 2) + q0 - 1, found % (high + 2) + r0 - 1
        return pd.DataFrame({"q": q.astype(np.int32), "r": r.astype(np.int32), "cost": np.array(cost)[found] if len(found) else np.zeros(0), "open": ~inside(q, r)})

    def merged(rows: DataFrame) -> DataFrame:
        """The least cost of each cell; of equal ones that which isn't open has been relaxed."""
        return rows.groupBy("q", "r").agg(F.min(F.struct("cost", "open", "round")).alias("c")).select("q", "r", "c.cost", "c.open", "c.round")

    turn = 0
    while True:
        tiles = tables[-1].filter(f"open AND round = {turn}").select(of("q", "r").alias("tile")).distinct()
        named = [x["tile"] for x in tiles.limit(MOST_TILES + 1).collect()]
        if not named:
            break
        within = (lambda x: x.filter(F.col("tile").isin(named))) if len(named) <= MOST_TILES else (lambda x: x.join(tiles, "tile", "left_semi"))
        rows = reduce(DataFrame.unionByName, tables).withColumn("open", F.expr(f"open AND round = {turn}"))
        known = merged(within(rows.withColumn("tile", of("q", "r"))).drop("tile")).withColumn("tile", of("q", "r"))
        found = within(e).groupBy("tile").cogroup(known.groupBy("tile")).applyInPandas(relax, "q int, r int, cost double, open boolean")
        turn += 1
        tables.append(written(found.withColumn("round", F.lit(turn)), "cost"))
        if len(tables) > MERGE_EVERY and not tables[-1].isEmpty():
            # the costs of this round stay a table of their own, as they open tiles
            old = written(merged(reduce(DataFrame.unionByName, tables[:-1])), "cost")
            for t in tables[:-1]:
                dropped(t)
            tables = [old, tables[-1]]
    dropped(e)
    return merged(reduce(DataFrame.unionByName, tables)).select("q", "r", F.round("cost", 4).alias("cost"))


def reversed_edges(weights: DataFrame) -> DataFrame:
    """For costs to a target in place of those from a source."""
    return weights.select(F.col("b_q").alias("q"), F.col("b_r").alias("r"), F.col("q").alias("b_q"), F.col("r").alias("b_r"), "w")


def isochrones(costs: DataFrame, minutes: tuple[int, ...] = ISOCHRONES) -> DataFrame:
    """Add band: the first number of minutes that a cost in seconds doesn't exceed; 0 seconds and more than all are in none."""
    return costs.withColumn("band", F.expr(f"CASE WHEN cost <= 0 THEN NULL {' '.join(f'WHEN cost <= {60 * x} THEN {x}' for x in minutes)} END").cast("int"))


def ring_of(radius: Column, i: Column) -> tuple[Column, Column]:
    """Offsets (dq, dr) of the i-th cell of the ring of a radius: from the fifth direction's corner on, six sides of ``radius`` steps."""
    side, step = F.floor(i / F.greatest(radius, F.lit(1))).cast("int"), F.pmod(i, F.greatest(radius, F.lit(1)))
    corners = [(-1, 1)]
    for dq, dr in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1)):
        corners.append((corners[-1][0] + dq, corners[-1][1] + dr))
    at = lambda k, values: F.element_at(F.array(*(F.lit(v[k]) for v in values)), side + 1)
    dirs = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
    return (at(0, corners) * radius + at(0, dirs) * step).cast("int"), (at(1, corners) * radius + at(1, dirs) * step).cast("int")


def cube_round(q: Column, r: Column) -> tuple[Column, Column]:
    """The cell that holds fractional axial coordinates: all three rounded half up, the one with the largest error set by the others."""
    y = -q - r
    up = lambda x: F.floor(x + F.lit(0.5)).cast("long")
    rq, ry, rr = up(q), up(y), up(r)
    dq, dy, dr = F.abs(rq - q), F.abs(ry - y), F.abs(rr - r)
    return F.when((dq > dy) & (dq > dr), -ry - rr).otherwise(rq).cast("int"), F.when(~((dq > dy) & (dq > dr)) & (dy <= dr), -rq - ry).otherwise(rr).cast("int")


def _together(lines: DataFrame) -> DataFrame:
    """Rows of lines (q, r, _n and others) with i from 0 to _n, SO_MANY lines that start near each other in turns of STEPS steps.

    Line after line, numbers that count up to thousands hardly compress; the same steps of lines beside each other repeat, so that a written table takes a fraction.
    """
    rest = [c for c in lines.columns if c not in ("r", "q")]
    # a total order: whoever numbers the rows again finds the same lines together
    near = lines.repartitionByRange(4 * lines.sparkSession.sparkContext.defaultParallelism, "r", "q").sortWithinPartitions("r", "q", *rest).withColumn("_b", F.floor(F.monotonically_increasing_id() / SO_MANY))
    x = spread(near, "_b").groupBy("_b").agg(F.collect_list(F.struct(*lines.columns)).alias("_l"), F.max("_n").alias("_m"))
    x = x.select("_l", F.explode(F.sequence(F.lit(0), F.floor(F.col("_m") / STEPS).cast("int"))).alias("_s")).withColumn("_s", F.col("_s") * STEPS)
    # a step of its own for each turn: what one row of a step makes is held in memory until all of it is there
    x = x.select("_s", F.inline(F.filter("_l", lambda line: line["_n"] >= F.col("_s"))))
    return x.withColumn("i", F.explode(F.sequence(F.col("_s"), F.least(F.col("_n"), F.col("_s") + (STEPS - 1))))).drop("_s")


def line_cells(pairs: DataFrame, together: bool = False) -> DataFrame:
    """The cells of the straight line from (q, r) to (q2, r2): adds i, lq, lr.  Ends are exact; between, points are nudged off cell rims.

    Pairs are few rows of many cells each, so they are dealt over the tasks first; ``together``, if the cells are written as they come, in turns of lines near each other.
    """
    n = ((F.abs(F.col("q") - F.col("q2")) + F.abs(F.col("r") - F.col("r2")) + F.abs(F.col("q") + F.col("r") - F.col("q2") - F.col("r2"))) / 2).cast("int")
    # column by column, so that each is computed once a row and not wherever the next ones mention it
    x = _together(pairs.withColumn("_n", n)) if together else spread(pairs).withColumn("_n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    x = x.withColumn("_t", F.col("i") / F.greatest(F.col("_n"), F.lit(1)))
    x = x.withColumns({"_q": F.col("q") + 1e-6 + (F.col("q2") - F.col("q")) * F.col("_t"), "_r": F.col("r") + 2e-6 + (F.col("r2") - F.col("r")) * F.col("_t")})
    lq, lr = cube_round(F.col("_q"), F.col("_r"))
    end = lambda a, b, mid: F.when(F.col("i") == 0, F.col(a)).when(F.col("i") == F.col("_n"), F.col(b)).otherwise(mid).cast("int")
    return x.withColumns({"lq": end("q", "q2", lq), "lr": end("r", "r2", lr)}).drop("_n", "_t", "_q", "_r")


#: Earth's radius with refraction, for the drop of a distant height.
SIGHT_RADIUS_M, EYE_M = 6_371_000.0 / (1 - 0.13), 1.7


def viewshed(cells: DataFrame, observers: DataFrame, rings: int) -> DataFrame:
    """o_q, o_r, q, r, screened, bare: whether an observer sees the cells up to ``rings`` away, past vegetation and over bare earth.

    Observers (q, r) are few; each looks along the line of cells to each target, whose heights come by a join on the cell.  A target is
    seen if its angle isn't below the largest between; cells outside the grid hide nothing.
    """
    offsets = [(a, b) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1) if (abs(a) + abs(b) + abs(a + b)) // 2 <= rings and (a or b)]
    o = observers.join(cells.select("q", "r", "elev"), ["q", "r"]).select("q", "r", F.col("elev").alias("o_elev"))
    pairs = o.withColumn("n", F.explode(F.array(*(F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in offsets)))).select("q", "r", "o_elev", (F.col("q") + F.col("n.dq")).alias("q2"), (F.col("r") + F.col("n.dr")).alias("r2"))
    steps = line_cells(pairs).filter("i > 0")
    ground = cells.select(F.col("q").alias("lq"), F.col("r").alias("lr"), F.col("elev").alias("z"), F.expr(m.screening_sql("veg")).alias("cover"))
    s = steps.join(ground.hint("merge"), ["lq", "lr"])
    (x, y), (ox, oy) = hex_center(F.col("lq"), F.col("lr"), SIZE_M), hex_center(F.col("q"), F.col("r"), SIZE_M)
    s = s.withColumn("d", F.sqrt(F.pow(x - ox, 2) + F.pow(y - oy, 2)))
    angle = lambda h: F.atan2(F.col("z") + h - F.col("d") * F.col("d") / (2 * SIGHT_RADIUS_M) - F.col("o_elev") - EYE_M, F.col("d"))
    at_end = (F.col("lq") == F.col("q2")) & (F.col("lr") == F.col("r2"))
    g = s.groupBy("q", "r", "q2", "r2").agg(F.max(F.when(at_end, angle(F.lit(EYE_M)))).alias("t"), F.max(F.when(~at_end, angle(F.lit(0.0)))).alias("b"), F.max(F.when(~at_end, angle(F.col("cover")))).alias("s")).filter("t IS NOT NULL")
    return g.select(F.col("q").alias("o_q"), F.col("r").alias("o_r"), F.col("q2").alias("q"), F.col("r2").alias("r"), F.expr("coalesce(round(t - s, 12) >= 0, true)").alias("screened"), F.expr("coalesce(round(t - b, 12) >= 0, true)").alias("bare"))


def concealment(cells: DataFrame, seen: DataFrame) -> DataFrame:
    """q, r, dead_ground (seen by no observer past vegetation), covered (by vegetation of 2 m or more), concealed (either)."""
    s = seen.filter("screened").select("q", "r").distinct().withColumn("seen", F.lit(True))
    x = cells.select("q", "r", F.expr(f"{m.screening_sql('veg')} >= {m.CONCEALING_M}e0").alias("covered")).join(s.hint("merge"), ["q", "r"], "left")
    return x.select("q", "r", F.col("seen").isNull().alias("dead_ground"), "covered", (F.col("seen").isNull() | F.col("covered")).alias("concealed"))
