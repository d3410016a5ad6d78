"""Polled incident feeds: repeated polls dropped, the latest version of each incident, what each source gave; on streams and on batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def versions(polls: DataFrame, late: str = "1 day") -> DataFrame:
    """Each version (id, updated) of an incident once, however often it was polled.

    polls: source, polled (time), id, updated (time), level, title.  On a stream a version is remembered until the watermark on ``updated`` has passed it, and what is older
    than the watermark is left out, so state doesn't grow with the stream's age.
    """
    if polls.isStreaming:
        return polls.withWatermark("updated", late).dropDuplicatesWithinWatermark(["id", "updated"])
    return polls.dropDuplicates(["id", "updated"])


def latest(polls: DataFrame, late: str = "1 day") -> DataFrame:
    """id, source, updated, level, title, versions: of each incident the version last updated; of equally late ones the greatest level, then title.

    On a stream (mode update) a row follows whenever an incident changes, so the last row of an id holds.  Versions that come late or shuffled change nothing but the count.
    """
    best = F.max(F.struct("updated", "level", "title"))
    return versions(polls, late).groupBy("id", "source").agg(best.alias("v"), F.count(F.lit(1)).alias("versions")).select("id", "source", "v.updated", "v.level", "v.title", "versions")


def given(polls: DataFrame, late: str = "1 day") -> DataFrame:
    """source, polled, incidents, newest: what each poll of a source gave.  On a stream (mode append) a poll follows when the watermark on ``polled`` has passed it."""
    p = polls.withWatermark("polled", late) if polls.isStreaming else polls
    return p.groupBy("source", "polled").agg(F.count(F.lit(1)).alias("incidents"), F.max("updated").alias("newest"))
