"""Overlaps of hexagons of two grids, by clipping convex polygons in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import hex_center

# Fixed value: the share of a cell that must be covered.
MEMBER_SHARE = 0.15


def hexagon(x: Column, y: Column, size: float) -> Column:
    """Corners of a pointy-top hexagon, counter-clockwise."""
    turn = F.sequence(F.lit(0), F.lit(5))
    return F.transform(turn, lambda k: F.struct((x + size * F.cos(F.radians((60 * k - 30).cast("double")))).alias("x"), (y + size * F.sin(F.radians((60 * k - 30).cast("double")))).alias("y")))


def clip(polygon: Column, by: Column) -> Column:
    """The part of a polygon within a convex one (counter-clockwise): cut by one side after the other; empty where nothing is left."""
    sides = F.transform(by, lambda p, i: F.struct(p.alias("a"), F.get(by, (i + 1) % F.size(by)).alias("b")))
    side_of = lambda e, p: (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def cut(rest: Column, e: Column) -> Column:
        signed = F.transform(rest, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side_of(e, p).alias("d")))

        def step(s: Column) -> Column:
            # each corner that is inside stays; where the way to the next crosses the line, the crossing is added
            def at(p: Column, i: Column) -> Column:
                n = F.get(s, (i + 1) % F.size(s))
                t = p["d"] / (p["d"] - n["d"])
                crossing = F.when((p["d"] < 0) != (n["d"] < 0), F.array(point(p["x"] + (n["x"] - p["x"]) * t, p["y"] + (n["y"] - p["y"]) * t))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
                return F.concat(F.when(p["d"] >= 0, F.array(point(p["x"], p["y"]))).otherwise(F.array().cast("array<struct<x:double,y:double>>")), crossing)

            return F.flatten(F.transform(s, at))

        # as an array's only element, the signed corners are made once
        return F.transform(F.array(signed), step)[0]

    return F.aggregate(sides, polygon, cut)


def area(polygon: Column) -> Column:
    """Of a counter-clockwise polygon, relative to its first corner; 0 for fewer than three corners."""
    first = F.get(polygon, F.lit(0))
    cross = F.transform(polygon, lambda p, i: F.transform(F.array(F.get(polygon, (i + 1) % F.size(polygon))), lambda n: (p["x"] - first["x"]) * (n["y"] - first["y"]) - (n["x"] - first["x"]) * (p["y"] - first["y"]))[0])
    return F.when(F.size(polygon) < 3, 0.0).otherwise(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c) / 2)


def covered(cells: DataFrame, painted: DataFrame, cell_size: float, painted_size: float) -> DataFrame:
    """q, r, overlap: the share of each cell's hexagon that the painted hexagons (distinct q, r of the other grid) cover, 1 at most.

    Painted hexagons of one grid don't overlap, so shares add up.  Both meet on squares as wide as both hexagons; a painted one goes to all
    squares that a cell touching it may be centred in, so each pair is met once.
    """
    reach = cell_size + painted_size
    square = lambda v: F.floor(v / (2 * reach)).cast("int")
    x, y = hex_center(F.col("q"), F.col("r"), painted_size)
    p = painted.select(x.alias("px"), y.alias("py"))
    for v, c in (("px", "sx"), ("py", "sy")):
        p = p.withColumn(c, F.explode(F.sequence(square(F.col(v) - reach), square(F.col(v) + reach))))
    x, y = hex_center(F.col("q"), F.col("r"), cell_size)
    c = cells.select("q", "r", x.alias("x"), y.alias("y")).withColumn("sx", square(F.col("x"))).withColumn("sy", square(F.col("y")))
    near = c.join(p, ["sx", "sy"]).filter(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) < reach * reach)
    part = near.withColumn("_own", hexagon(F.col("x"), F.col("y"), cell_size)).withColumn("_by", hexagon(F.col("px"), F.col("py"), painted_size)).withColumn("_part", clip(F.col("_own"), F.col("_by")))
    part = part.groupBy("q", "r").agg(F.sum(area(F.col("_part"))).alias("_a"))
    whole = 3 * 3**0.5 / 2 * cell_size**2
    return cells.select("q", "r").join(part, ["q", "r"], "left").select("q", "r", F.least(F.lit(1.0), F.coalesce(F.col("_a") / whole, F.lit(0.0))).alias("overlap"))
