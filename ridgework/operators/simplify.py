"""Simplification of lines: all open ranges are split in one round, so rounds are as many as splits nest.

A line of up to MAX_VERTICES goes through its rounds where it lies after one shuffle; the open ranges of longer ones are spread over tasks and written each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE
from ..sources.shared import dropped, written
from .linear import MAX_VERTICES

# Fixed value: metres that a vertex may lie off the simplified line.
TOLERANCE_M = 12.0


def off_line_m(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """Metres, to a micrometre, from a point to the line between two (structs of lat, lng), planar at the first one's latitude."""
    k = METRES_PER_DEGREE * F.cos(F.radians(a["lat"]))
    bx, by, px, py = (b["lng"] - a["lng"]) * k, (b["lat"] - a["lat"]) * METRES_PER_DEGREE, (lng - a["lng"]) * k, (lat - a["lat"]) * METRES_PER_DEGREE
    length = bx * bx + by * by
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(px * bx + py * by, length))))
    return F.round(F.sqrt(F.pow(px - t * bx, 2) + F.pow(py - t * by, 2)), 6)


def stays(lat: np.ndarray, lng: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Which vertices of one line, in its order, stay: the rule of ``simplify``, with the distances of ``off_line_m``."""
    found = np.zeros(len(lat), bool)
    found[[0, -1]] = True
    a, b = np.array([0]), np.array([len(lat) - 1])
    while len(a := a[keep := b - a > 1]):
        b = b[keep]
        size = b - a - 1
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(a)), size)
        i, k = np.arange(len(of)) + (a + 1 - first)[of], (METRES_PER_DEGREE * np.cos(np.radians(lat[a])))[of]
        y, x = lat[a][of], lng[a][of]
        bx, by, px, py = (lng[b][of] - x) * k, (lat[b][of] - y) * METRES_PER_DEGREE, (lng[i] - x) * k, (lat[i] - y) * METRES_PER_DEGREE
        length = bx * bx + by * by
        t = np.clip((px * bx + py * by) / np.where(length == 0, 1.0, length), 0.0, 1.0)
        t[length == 0] = 0.0
        d = np.nan_to_num(np.round(np.sqrt((px - t * bx) ** 2 + (py - t * by) ** 2), 6), nan=-1.0)  # no place, no distance
        top = np.maximum.reduceat(d, first)
        hit = np.flatnonzero(d == top[of])
        w = i[hit[np.unique(of[hit], return_index=True)[1]]]  # of equally far ones the first
        a, b, w = (x[top > tolerance_m] for x in (a, b, w))
        found[w] = True
        a, b = np.concatenate([a, w]), np.concatenate([w, b])
    return found


def simplify(vertices: DataFrame, tolerance_m: float = TOLERANCE_M, most: int = MAX_VERTICES) -> DataFrame:
    """line, i, lat, lng of the vertices that stay of (line, i, lat, lng), i distinct in a line.

    Both ends stay; of the vertices between two that stay the farthest off their line stays too if it is more than ``tolerance_m`` off (of equally far ones the first), and so on
    on both sides of it.  Lines of up to ``most`` vertices are simplified by line, longer ones by ``in_rounds``.
    """

    def kept(line: pa.Table) -> pa.Table:
        line = line.sort_by("i")
        return line.filter(pa.array(stays(line["lat"].to_numpy(), line["lng"].to_numpy(), tolerance_m)))

    rows = vertices.select("line", "i", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    long = written(rows.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("line"), "long")
    if long.isEmpty():
        dropped(long)
        return rows.groupBy("line").applyInArrow(kept, rows.schema)
    same = rows["line"].eqNullSafe(long["line"])
    return rows.join(long, same, "left_anti").groupBy("line").applyInArrow(kept, rows.schema).unionByName(in_rounds(rows.join(long, same, "left_semi"), tolerance_m))


def in_rounds(vertices: DataFrame, tolerance_m: float) -> DataFrame:
    """``simplify`` for lines too long for a task.

    A round finds the farthest vertex of each open range by an aggregate that combines before the shuffle; ranges
    without one are closed.  What is open is written each round, so it shrinks and lineage stays short.
    """
    at = lambda p="": F.struct(F.col(f"{p}lat").alias("lat"), F.col(f"{p}lng").alias("lng"))
    ends = vertices.groupBy("line").agg(F.min(F.struct("i", "lat", "lng")).alias("lo"), F.max(F.struct("i", "lat", "lng")).alias("hi"))
    kept = [written(ends.select("line", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("v")).select("line", "v.*"), "kept")]
    open_ = written(vertices.select("line", "i", "lat", "lng").join(ends, "line").filter("i > lo.i AND i < hi.i"), "ranges")
    while True:
        d = off_line_m(F.col("lat"), F.col("lng"), F.col("lo"), F.col("hi"))
        worst = open_.groupBy("line", F.col("lo.i").alias("_lo")).agg(F.max(F.struct(d.alias("d"), (-F.col("i")).alias("k"), at().alias("at"))).alias("w")).filter(F.col("w.d") > tolerance_m)
        worst = written(worst.select("line", "_lo", F.struct((-F.col("w.k")).alias("i"), F.col("w.at.lat").alias("lat"), F.col("w.at.lng").alias("lng")).alias("w")), "kept")
        if worst.isEmpty():
            dropped(worst)
            dropped(open_)
            break
        kept.append(worst.select("line", "w.*"))
        split = open_.withColumn("_lo", F.col("lo.i")).join(worst, ["line", "_lo"]).filter("i <> w.i")
        after = written(split.select("line", "i", "lat", "lng", F.when(F.col("i") > F.col("w.i"), F.col("w")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("i") < F.col("w.i"), F.col("w")).otherwise(F.col("hi")).alias("hi")), "ranges")
        dropped(open_)
        open_ = after
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return found.select("line", "i", "lat", "lng")
