"""Rings from fragments, and their holes.

Fragments meet at their ends.  At each point ends are paired, so a way along fragments is a linked list over (fragment, direction).  Relations of up to
MOST_FRAGMENTS are walked within the tasks that they are dealt to, after one shuffle; the lists of larger ones are followed by pointer doubling, in about
twice the logarithm of the longest ring's number of fragments of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..sources.shared import dropped, written
from .spatial import INSIDE_SQL, cell

#: Decimals of degrees within which two ends are one point.
DECIMALS = 7
#: Fragments of a relation up to which one task walks it.
MOST_FRAGMENTS = 50_000
COORDS = "array<struct<lat:double,lng:double>>"


def point_key(p: Column) -> Column:
    return F.struct(F.round(p["lat"], DECIMALS).alias("lat"), F.round(p["lng"], DECIMALS).alias("lng"))


def is_closed(coords: Column) -> Column:
    return (F.size(coords) >= 4) & (point_key(coords[0]) == point_key(F.element_at(coords, -1)))


def _doubled(links: DataFrame, value: str, combine) -> DataFrame:
    """Follow ``nxt`` to the end, or round and round: ``value`` of (id, nxt, value) becomes what ``combine`` makes of it and of those behind.

    After k rounds 2 ** k of them are in; rounds end when no value and no open end changes any more.
    """
    links = written(links, "ring-links")
    while True:
        far = links.select(F.col("id").alias("nxt"), F.col("nxt").alias("_nxt"), F.col(value).alias("_v"))
        found = links.join(far, "nxt", "left")
        now = F.when(F.col("_v").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("_v")))
        ended = F.col("nxt").isNotNull() & F.col("_nxt").isNull()
        found = written(found.select("id", F.col("_nxt").alias("nxt"), now.alias(value), ((now != F.col(value)) | ended).alias("_changed")), "ring-links")
        dropped(links)
        links = found.drop("_changed")
        if found.filter("_changed").isEmpty():
            return links


def stitch(fragments: DataFrame) -> DataFrame:
    """relation, first, closed, coords: fragments (relation, ord, coords; ord distinct in a relation) joined end to end.

    A way begins with its fragment of the least ord, ``first``, in the direction that has; fragments of fewer than two points are left out.  What is joined but never
    closes is one open way, of all that hangs together; nothing is closed that isn't.  Where more than two ends share a point, they are paired by ord.
    """
    f = written(fragments.filter("size(coords) >= 2").select("relation", "ord", "coords").withColumn("_closed", is_closed(F.col("coords"))), "fragments")
    whole = f.filter("_closed").select("relation", F.col("ord").alias("first"), F.lit(True).alias("closed"), "coords")
    parts = f.filter("NOT _closed")
    large = parts.groupBy("relation").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MOST_FRAGMENTS).select("relation")
    if large.isEmpty():
        rows = _walked(parts)
    else:
        large = written(large, "large-relations")
        rows = _walked(parts.join(large, "relation", "left_anti")).unionByName(_followed(parts.join(large, "relation", "left_semi")))
    rows = rows.withColumn("coords", F.when(F.col("dir") == 0, F.col("coords")).otherwise(F.reverse("coords")))
    ways = rows.groupBy("relation", "first").agg(F.bool_and("closed").alias("closed"), F.sort_array(F.collect_list(F.struct("k", "coords"))).alias("p"))  # the points of one way
    ways = ways.select("relation", "first", "closed", F.flatten(F.transform("p", lambda x, i: F.when(i == 0, x["coords"]).otherwise(F.slice(x["coords"], 2, F.greatest(F.size(x["coords"]) - 1, F.lit(0)))))).alias("coords"))
    return whole.unionByName(ways.select("relation", "first", F.col("closed") & is_closed(F.col("coords")), "coords").toDF("relation", "first", "closed", "coords"))


def _ways(starts: list, ends: list) -> tuple[list[int], list[int], list[bool], list[int]]:
    """Of one relation's fragments, by their ends' points and in the order of ord: the first fragment of each one's way, its direction in it, whether the way closes, its place."""
    n, waiting, mate = len(starts), {}, {}
    for i, pair in enumerate(zip(starts, ends)):
        for end in (0, 1):
            other = waiting.pop(pair[end], None)
            if other is None:
                waiting[pair[end]] = (i, end)
            else:
                mate[i, end], mate[other] = other, (i, end)
    first, dirs, closed, place = [-1] * n, [0] * n, [False] * n, [0] * n
    for i in range(n):
        if first[i] >= 0:
            continue
        way, at = [(i, 0)], mate.get((i, 1))
        while at is not None and at[0] != i:
            way.append(at)  # entered by its end 0, it is walked forwards
            at = mate.get((at[0], 1 - at[1]))
        ring, before = at is not None, []
        at = None if ring else mate.get((i, 0))
        while at is not None:
            before.append((at[0], 1 - at[1]))
            at = mate.get((at[0], 1 - at[1]))
        for k, (j, d) in enumerate(before[::-1] + way):
            first[j], dirs[j], closed[j], place[j] = i, d, ring, k
    return first, dirs, closed, place


def _walked(parts: DataFrame) -> DataFrame:
    """relation, ord, coords, first, dir, closed, k (place in the way) of fragments that aren't closed; a relation's are walked by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the relation that the last batch may have cut

        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            relations, starts, ends = (rows.column(c).to_pylist() for c in ("relation", "_start", "_end"))
            out, a = ([], [], [], []), 0
            for b in range(1, len(relations) + 1):
                if b == len(relations) or relations[b] != relations[a]:
                    first, *others = _ways(starts[a:b], ends[a:b])
                    for to, values in zip(out, ([a + i for i in first], *others)):
                        to += values
                    a = b
            first = rows.column("ord").take(pa.array(out[0], pa.int64()))
            columns = [rows.column("relation"), rows.column("ord"), rows.column("coords"), first, pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int64())]
            yield from pa.Table.from_arrays(columns, ["relation", "ord", "coords", "first", "dir", "closed", "k"]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            relation = batch.column("relation")
            same = pc.fill_null(pc.equal(relation, relation[-1]), False).to_pylist()
            cut = len(same) - next((i for i, x in enumerate(reversed(same)) if not x), len(same))
            held.append(batch.slice(0, cut))
            if cut or held[0].num_rows and held[0].column("relation")[0] != relation[-1]:
                yield from found(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from found(pa.Table.from_batches(held))

    of = {x.name: x.dataType for x in parts.schema}
    schema = StructType([StructField(c, of[c]) for c in ("relation", "ord", "coords")] + [StructField("first", of["ord"]), StructField("dir", IntegerType()), StructField("closed", BooleanType()), StructField("k", LongType())])
    text = lambda p: F.concat_ws(" ", *(F.coalesce((F.round(p[c], DECIMALS) + 0.0).cast("string"), F.lit("-")) for c in ("lat", "lng")))
    rows = parts.filter("relation IS NOT NULL AND ord IS NOT NULL").select("relation", "ord", "coords", text(F.col("coords")[0]).alias("_start"), text(F.element_at("coords", -1)).alias("_end"))
    return rows.repartition("relation").sortWithinPartitions("relation", "ord").mapInArrow(run, schema)


def _followed(parts: DataFrame) -> DataFrame:
    """The same by pointer doubling, for relations that are too large for a task."""
    ends = parts.select("relation", "ord", F.explode(F.array(F.struct(F.lit(0).alias("end"), point_key(F.col("coords")[0]).alias("key")), F.struct(F.lit(1).alias("end"), point_key(F.element_at("coords", -1)).alias("key")))).alias("e")).select("relation", "ord", "e.*")
    at = Window.partitionBy("relation", "key").orderBy("ord", "end")
    node = lambda o, d: F.struct("relation", F.col(o).alias("ord"), d.alias("dir"))
    ends = ends.withColumn("_n", F.row_number().over(at)).withColumn("_lead", F.lead(F.struct("ord", "end")).over(at)).withColumn("_lag", F.lag(F.struct("ord", "end")).over(at))
    ends = ends.withColumn("_with", F.when(F.col("_n") % 2 == 1, F.col("_lead")).otherwise(F.col("_lag")))
    # a fragment walked forwards (0) is left by its end 1; the next is entered by the end that is paired with it
    links = ends.select(node("ord", 1 - F.col("end")).alias("id"), F.when(F.col("_with").isNotNull(), F.struct("relation", F.col("_with.ord").alias("ord"), F.col("_with.end").alias("dir"))).alias("nxt"))
    links = written(links, "ring-ends")
    least = _doubled(links.withColumn("least", F.struct("id.ord", "id.dir")), "least", F.least)
    back = least.select(F.struct("id.relation", "id.ord", (1 - F.col("id.dir")).alias("dir")).alias("id"), F.col("least").alias("behind"))
    seen = least.join(back, "id").withColumn("first", F.least("least.ord", "behind.ord"))
    # of a way's two directions that which walks its first fragment forwards
    ahead = (F.col("least.ord") == F.col("first")) & (F.col("least.dir") == 0)
    kept = seen.filter(ahead | ((F.col("behind.ord") == F.col("first")) & (F.col("behind.dir") == 1)))
    kept = written(kept.select("id", "first", F.col("nxt").isNotNull().alias("closed")), "ring-ways")
    path = links.join(kept, "id").select("id", F.when(~F.col("closed") | (F.col("nxt.ord") != F.col("first")), F.col("nxt")).alias("nxt"), F.lit(1).cast("long").alias("left"))
    left = _doubled(path, "left", lambda a, b: a + b)  # how many fragments are left, this one included
    rows = left.join(kept, "id").select("id.relation", "id.ord", "id.dir", "first", "closed", (-F.col("left")).alias("k"))
    return rows.join(parts.select("relation", "ord", "coords"), ["relation", "ord"]).select("relation", "ord", "coords", "first", "dir", "closed", "k")


def ring_edges(coords: Column) -> Column:
    """x1, y1, x2, y2 of a ring's sides."""
    return F.transform(F.slice(coords, 1, F.size(coords) - 1), lambda a, i: F.struct(a["lng"].alias("x1"), a["lat"].alias("y1"), coords[i + 1]["lng"].alias("x2"), coords[i + 1]["lat"].alias("y2")))


def with_holes(outer: DataFrame, inner: DataFrame, size: float) -> DataFrame:
    """relation, first, closed, coords, holes: closed inner rings go to every closed outer ring of their relation that holds their first point.

    Rings meet on cells of ``size`` degrees of the outer's box; open inner rings are no holes, open outer rings have none (null).
    """
    o = outer.filter("closed").select("relation", "first", ring_edges(F.col("coords")).alias("edges"))
    box = {"x0": "array_min(transform(edges, e -> e.x1))", "x1": "array_max(transform(edges, e -> e.x1))", "y0": "array_min(transform(edges, e -> e.y1))", "y1": "array_max(transform(edges, e -> e.y1))"}
    o = o.select("*", *(F.expr(e).alias(f"_{k}") for k, e in box.items()))
    o = o.withColumn("cx", F.explode(F.sequence(cell(F.col("_x0"), size), cell(F.col("_x1"), size)))).withColumn("cy", F.explode(F.sequence(cell(F.col("_y0"), size), cell(F.col("_y1"), size))))
    h = inner.filter("closed").select("relation", F.col("first").alias("hole"), "coords", F.col("coords")[0]["lat"].alias("lat"), F.col("coords")[0]["lng"].alias("lng"))
    h = h.withColumn("cx", cell(F.col("lng"), size)).withColumn("cy", cell(F.col("lat"), size))
    hit = h.join(o, ["relation", "cx", "cy"]).filter("lng BETWEEN _x0 AND _x1 AND lat BETWEEN _y0 AND _y1").filter(F.expr(INSIDE_SQL))
    holes = hit.groupBy("relation", "first").agg(F.sort_array(F.collect_list(F.struct("hole", "coords"))).alias("_h"))  # the holes of one ring
    return outer.join(holes.select("relation", "first", F.transform("_h", lambda x: x["coords"]).alias("holes"), F.lit(True).alias("closed")), ["relation", "first", "closed"], "left").select("relation", "first", "closed", "coords", "holes")


def ring_area(coords: Column) -> Column:
    """Signed square degrees, by the shoelace formula from the first point."""
    x, y = lambda p: p["lng"] - coords[0]["lng"], lambda p: p["lat"] - coords[0]["lat"]
    sides = F.transform(coords, lambda p, i: F.when(i == 0, F.lit(0.0)).otherwise(x(F.get(coords, i - 1)) * y(p) - x(p) * y(F.get(coords, i - 1))))
    return F.aggregate(sides, F.lit(0.0), lambda a, s: a + s) / 2
