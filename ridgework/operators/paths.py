"""Least paths over accumulated costs: predecessors, penalties, paths by chains within tiles and pointer doubling over them, what results say of the grid's rim."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, spread, written

# Fixed value: the share of a box's span that counts as its rim.
RIM = 0.1
#: Costs that differ by less come from equally good predecessors.
SAME_COST = 1e-3
#: Cells along a side of a tile in which paths are walked by one task, and of a chain at most.
PATH_TILE, CHAIN = 512, 512


def penalised(weights: DataFrame, penalties: DataFrame) -> DataFrame:
    """weights (q, r, b_q, b_r, w) times the factors of penalties (q, r, b_q, b_r, factor; both directions of an edge on their own, several multiply); an infinite factor leaves no way."""
    p = penalties.groupBy("q", "r", "b_q", "b_r").agg(F.product("factor").alias("factor"))
    w = F.col("w") * F.coalesce("factor", F.lit(1.0))
    return weights.join(p.hint("merge"), ["q", "r", "b_q", "b_r"], "left").select("q", "r", "b_q", "b_r", F.when(w < float("inf"), w).alias("w"))


def predecessors(weights: DataFrame, costs: DataFrame) -> DataFrame:
    """q, r, p_q, p_r: the cell before each reached cell on a least path to it; sources have none.

    It is found from the costs: the near end of an edge whose cost and weight add up to the cell's; of several the least (q, r).  Weights are above
    SAME_COST, so a predecessor's cost is less and ways never run in rings.
    """
    near = costs.select("q", "r", F.col("cost").alias("_a"))
    far = costs.select(F.col("q").alias("b_q"), F.col("r").alias("b_r"), F.col("cost").alias("_b"))
    e = weights.filter("w IS NOT NULL").join(near.hint("merge"), ["q", "r"]).join(far.hint("merge"), ["b_q", "b_r"]).filter(F.abs(F.col("_a") + F.col("w") - F.col("_b")) < SAME_COST)
    return e.groupBy("b_q", "b_r").agg(F.min(F.struct("q", "r")).alias("p")).select(F.col("b_q").alias("q"), F.col("b_r").alias("r"), F.col("p.q").alias("p_q"), F.col("p.r").alias("p_r"))


def _chains(before: DataFrame, targets: DataFrame, tile: int, most: int) -> DataFrame:
    """q, r, p_q, p_r (null: no more), n, cells: where a path that comes to (q, r) leads within the tile, n cells (``most`` and one at most), and where it goes on.

    Paths come into tiles at targets and at the predecessors of other tiles' cells; longer ways are cut where all that meet there are cut.  A tile is one task's group
    of tile * tile cells at most; cells are their numbers in it.
    """
    at = lambda q, r: (F.floor(F.col(q) / tile).cast("int"), F.floor(F.col(r) / tile).cast("int"))
    tiled = lambda df: df.withColumns(dict(zip(("tile_q", "tile_r"), at("q", "r"))))
    before = tiled(before.select("q", "r", "p_q", "p_r"))
    p_q, p_r = at("p_q", "p_r")
    entered = before.filter((F.col("tile_q") != p_q) | (F.col("tile_r") != p_r)).select(F.col("p_q").alias("q"), F.col("p_r").alias("r"))
    # under names of their own: grouped beside each other, columns that both sides have from one table are mistaken
    comes = tiled(targets.select("q", "r").unionByName(entered).distinct()).withColumnsRenamed({"q": "s_q", "r": "s_r"})

    def walked(key: tuple, of_tile: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if not len(starts):
            return pd.DataFrame({"q": [], "r": [], "p_q": [], "p_r": [], "ends": [], "n": [], "cells": []}).astype({"q": "int32", "r": "int32", "p_q": "int32", "p_r": "int32", "ends": "bool", "n": "int64", "cells": "object"})
        if not len(of_tile):  # sources alone
            of_tile = starts[["s_q", "s_r", "s_q", "s_r"]].iloc[:0].set_axis(["q", "r", "p_q", "p_r"], axis=1)
        q0, r0 = int(key[0]) * tile, int(key[1]) * tile
        place = lambda df, q, r: ((df[q].to_numpy(np.int64) - q0) * tile + df[r].to_numpy(np.int64) - r0).astype(np.int32)
        cell, to = place(of_tile, "q", "r"), of_tile[["p_q", "p_r"]].to_numpy(np.int64).reshape(-1, 2)
        stays = (to[:, 0] // tile == key[0]) & (to[:, 1] // tile == key[1])
        ahead, leaves = np.full(tile * tile, -1, np.int32), np.full(tile * tile, -1, np.int32)
        ahead[cell[stays]] = place(of_tile[stays], "p_q", "p_r")
        leaves[cell[~stays]] = np.flatnonzero(~stays)
        # steps to the last cell within the tile
        steps, far = (ahead >= 0).astype(np.int32), ahead.copy()
        while (more := np.flatnonzero(far >= 0)).size:
            steps[more], far[more] = steps[more] + steps[far[more]], far[far[more]]
        known, new, rows = np.zeros(tile * tile, bool), np.unique(place(starts, "s_q", "s_r")), []
        while len(new):
            known[new] = True
            cut = []
            for some in np.array_split(new, -(-len(new) // 4096)):
                length = np.where(steps[some] <= most, steps[some] + 1, (steps[some] - 1) % most + 1)
                grid = np.full((len(some), length.max()), -1, np.int32)
                now = some
                for i in range(length.max()):
                    grid[:, i] = now
                    now = np.where(now >= 0, ahead[now], -1)
                last = grid[np.arange(len(some)), length - 1]
                goes, out = ahead[last], leaves[last]
                on = np.where((goes >= 0)[:, None], np.stack([goes // tile + q0, goes % tile + r0], 1), to[out] if len(to) else 0)
                rows.append(pd.DataFrame({
                    "q": (some // tile + q0).astype(np.int32), "r": (some % tile + r0).astype(np.int32), "p_q": on[:, 0].astype(np.int32), "p_r": on[:, 1].astype(np.int32), "ends": (goes < 0) & (out < 0),
                    "n": length.astype(np.int64), "cells": [g[:k] for g, k in zip(grid, length.tolist())],
                }))
                cut.append(goes[goes >= 0])
            new = np.unique(np.concatenate(cut))
            new = new[~known[new]]
        return pd.concat(rows)

    found = before.groupBy("tile_q", "tile_r").cogroup(comes.groupBy("tile_q", "tile_r")).applyInPandas(walked, "q int, r int, p_q int, p_r int, ends boolean, n long, cells array<int>")
    on = lambda c: F.when(~F.col("ends"), F.col(c)).alias(c)
    return found.select("q", "r", on("p_q"), on("p_r"), "n", "cells")


def paths(before: DataFrame, targets: DataFrame, tile: int = PATH_TILE, most: int = CHAIN) -> DataFrame:
    """t_q, t_r, step, q, r: the cells of the path to each reached target (q, r), steps counted from its source.

    before: as from ``predecessors``.  Paths are chains of cells within tiles, shared by all paths that come through.  Jumps of 1, 2, 4 ... chains are made from each other; then,
    from the longest to the shortest, every chain that a path holds adds the chain a jump before it, so a path of n chains takes about 2 log n joins and no walk.  A path's
    cells come out of its chains last, after the last shuffle: what is written and shuffled grows with the chains of paths, not with their cells.
    """
    chains = written(_chains(before, targets, tile, most), "chains")
    jumps = [written(chains.drop("cells"), "jumps")]  # n: cells of all chains that are jumped, in the last table of all to the source
    while not (last := jumps[-1]).filter("p_q IS NOT NULL").isEmpty():
        again = last.select(F.col("q").alias("p_q"), F.col("r").alias("p_r"), F.col("p_q").alias("f_q"), F.col("p_r").alias("f_r"), F.col("n").alias("m"))
        more = last.join(again.hint("merge"), ["p_q", "p_r"], "left")
        jumps.append(written(more.select("q", "r", F.col("f_q").alias("p_q"), F.col("f_r").alias("p_r"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "jumps"))
    held = written(targets.select(F.col("q").alias("t_q"), F.col("r").alias("t_r"), "q", "r").distinct(), "paths")
    for jump in reversed(jumps[:-1]):
        ways = jump.filter("p_q IS NOT NULL").select("q", "r", "p_q", "p_r")
        far = held.join(ways.hint("merge"), ["q", "r"]).select("t_q", "t_r", F.col("p_q").alias("q"), F.col("p_r").alias("r"))
        more = written(held.unionByName(far), "paths")
        dropped(held)
        held = more
    for j in jumps[:-1]:
        dropped(j)
    # few rows of many cells each
    ends = spread(chains.select("q", "r", "cells"), "q", "r").join(spread(jumps[-1].select("q", "r", F.col("n").alias("_n")), "q", "r").hint("merge"), ["q", "r"])
    own = spread(held, "q", "r").join(ends.hint("merge"), ["q", "r"])
    own = own.select("t_q", "t_r", "_n", F.floor(F.col("q") / tile).alias("_q"), F.floor(F.col("r") / tile).alias("_r"), F.posexplode("cells").alias("_i", "_c"))
    return own.select("t_q", "t_r", (F.col("_n") - 1 - F.col("_i")).alias("step"), (F.col("_q") * tile + F.floor(F.col("_c") / tile)).cast("int").alias("q"), (F.col("_r") * tile + F.col("_c") % tile).cast("int").alias("r"))


def assembled(cells: DataFrame, costs: DataFrame, classes: DataFrame) -> DataFrame:
    """q, r, seconds (null: not reached), mobility, x, y of every cell, reached or not."""
    return cells.select("q", "r", "x", "y").join(costs.select("q", "r", F.col("cost").alias("seconds")).hint("merge"), ["q", "r"], "left").join(classes.hint("merge"), ["q", "r"], "left").select("q", "r", "seconds", "mobility", "x", "y")


def touched_rims(results: DataFrame) -> DataFrame:
    """One row: which rims of the box of all cells (x, y) some reached cell (seconds) lies on."""
    box = results.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row
    r = results.filter("seconds IS NOT NULL").crossJoin(F.broadcast(box))
    wide, high = (F.col("x1") - F.col("x0")) * RIM, (F.col("y1") - F.col("y0")) * RIM
    on = {"north": F.col("y") >= F.col("y1") - high, "south": F.col("y") <= F.col("y0") + high, "east": F.col("x") >= F.col("x1") - wide, "west": F.col("x") <= F.col("x0") + wide}
    return r.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in on.items()))
