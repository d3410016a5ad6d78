"""The queries of the engine, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as t
from . import corridors, equipment, feeds, files, insights, lines, paths, rings, spatial, terrain, text, vegetation  # noqa: F401  register their queries
from .registry import QUERIES, SQL, query  # noqa: F401

_PAINT = "(SELECT event_id AS seq, event_type <> 'error' AS painted, CAST(user_id % 40 AS INTEGER) AS q, CAST(event_id % 25 AS INTEGER) AS r FROM events)"


@query(f"SELECT q, r, seq FROM (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY seq DESC) AS rn FROM {_PAINT}) WHERE rn = 1 AND painted")
def painted_area(spark, sf):
    """Cells whose last stroke paints: the last write of each cell, by an aggregate that combines before the shuffle."""
    e = t.derived(spark, sf, "events", {"seq": "event_id", "painted": "event_type <> 'error'", "q": "CAST(user_id % 40 AS INTEGER)", "r": "CAST(event_id % 25 AS INTEGER)"})
    return e.groupBy("q", "r").agg(F.max(F.struct("seq", "painted")).alias("last")).filter("last.painted").select("q", "r", "last.seq")
