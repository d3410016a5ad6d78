"""Grounding of texts: numeric claims, citations, retrieval by tokens; encoding of plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import gis_files

# What counts as a number with its unit, and as a citation; words that say nothing.
NUMBER = r"(\$)?(-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\s*(hours?|hrs?|km/h|km|ha|minutes?|mins?|m|h|%|°)?"
CITATION = r"(?i)\[\[doc:([a-z0-9-]+)\]\]"
STOP_WORDS = "the a an and or of in on for to is are this that with it be was at by as from has have will what how".split()
TAG_SCORE = 3


def claims(texts: DataFrame) -> DataFrame:
    """id, place, raw, value, unit: the numbers that texts state, each value and unit once, where it comes first.

    Bare whole numbers below ten are no claims.  Null texts state nothing.
    """
    part = lambda m, g: F.regexp_extract(m, NUMBER, g)
    rows = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("at", "m"))
    rows = rows.select("id", "at", part("m", 1).alias("dollar"), part("m", 2).alias("num"), part("m", 3).alias("word"))
    rows = rows.withColumn("value", F.regexp_replace("num", ",", "").cast("double")).withColumn("unit", F.when(F.col("dollar") != "", "$").when(F.col("word") != "", F.lower("word")))
    rows = rows.filter(F.col("unit").isNotNull() | F.contains("num", F.lit(".")) | (F.abs("value") >= 10))
    rows = rows.withColumn("raw", F.trim(F.concat("dollar", "num", F.when(F.col("word") != "", F.concat(F.lit(" "), "word")).otherwise(""))))
    first = rows.groupBy("id", "value", "unit").agg(F.min(F.struct("at", "raw")).alias("f"))
    return first.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("f.at")) - 1).alias("place"), "f.raw", "value", "unit")


def citations(texts: DataFrame) -> DataFrame:
    """id, place, citation: distinct cited ids in the order in which they come first."""
    return texts.select("id", F.posexplode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(CITATION), F.lit(1)), F.lower))).alias("place", "citation"))


def payload_numbers(json: Column) -> Column:
    """All numbers of a JSON text, at any depth: what is left of it without its strings."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), F.lit(0)).cast("array<double>"))


def unmatched(claimed: DataFrame, payloads: DataFrame) -> DataFrame:
    """id, raw of claims that no number of their payload (id, numbers) supports: itself, rounded to whole or tenths, or within one part in a hundred."""
    ok = (
        "exists(numbers, p -> abs(p - value) < 1e-9 OR abs(floor(p + 0.5e0) - value) < 1e-9 OR abs(floor(p * 10 + 0.5e0) / 10 - value) < 1e-9 "
        "OR (CASE WHEN p <> 0 THEN abs(p - value) / abs(p) ELSE abs(value) END) < 0.01e0)"
    )
    return claimed.join(payloads, "id").filter(F.expr(f"NOT {ok}")).select("id", "place", "raw")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """id, rank, chunk, score: the k best chunks (ord, text, tags) of each query (id, text); only those that score.

    A chunk scores one for each of its tokens that the query has, and three for each such tag.  Counts by token meet in a join on it.
    """
    body = chunks.select("ord", F.explode(tokens(F.col("text"))).alias("t")).groupBy("ord", "t").agg(F.count(F.lit(1)).alias("w"))
    tags = chunks.select("ord", F.explode("tags").alias("t")).groupBy("ord", F.lower("t").alias("t")).agg((F.count(F.lit(1)) * TAG_SCORE).alias("w"))
    asked = queries.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    score = asked.join(body.unionByName(tags), "t").groupBy("id", "ord").agg(F.sum("w").alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "ord"))
    return score.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", F.col("ord").alias("chunk"), "score")


def number_text(x: Column) -> Column:
    """A double as its shortest text, whole ones without a point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def encode_plans(vertices: DataFrame, width: Column) -> DataFrame:
    """plan, encoded: a plan's vertices with five decimals and its width as JSON in URL-safe base 64 without padding."""
    r = lambda c: number_text(F.floor(F.col(c) * 1e5 + 0.5) / 1e5)
    pts = vertices.select("plan", "seq", F.concat(F.lit("["), r("lat"), F.lit(","), r("lng"), F.lit("]")).alias("p"))
    one = pts.groupBy("plan").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda x: x["p"]), ",").alias("c"))  # a plan's vertices are bounded
    json = F.concat(F.lit('{"v":1,"c":['), "c", F.lit("]"), F.when(width > 0, F.concat(F.lit(',"w":'), number_text(width))).otherwise(""), F.lit("}"))
    return one.select("plan", F.rtrim(F.translate(F.base64(json.cast("binary")), "+/\r\n", "-_"), F.lit("=")).alias("encoded"))


def decode_plans(plans: DataFrame) -> DataFrame:
    """plan, coords (lat, lng), width of encoded plans: pairs within bounds; null coords if fewer than two are left or the text is none; widths in (0, 1000]."""
    padded = F.rpad(F.translate("encoded", "-_", "+/"), (F.ceil(F.length("encoded") / 4) * 4).cast("int"), F.lit("="))
    json = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "c array<array<double>>, w double")
    d = plans.select("plan", json.alias("j"))
    good = F.filter("j.c", lambda p: (F.size(p) == 2) & p[0].between(-90, 90) & p[1].between(-180, 180))
    d = d.withColumn("coords", F.transform(good, lambda p: F.struct(p[0].alias("lat"), p[1].alias("lng"))))
    return d.select("plan", F.when(F.size("coords") >= 2, F.col("coords")).alias("coords"), F.when((F.col("j.w") > 0) & (F.col("j.w") <= 1000), F.col("j.w")).alias("width"))


def gpx(vertices: DataFrame) -> DataFrame:
    """plan, gpx: a track of each plan as GPX."""
    pts = vertices.select("plan", "seq", F.concat(F.lit('<trkpt lat="'), number_text(F.col("lat")), F.lit('" lon="'), number_text(F.col("lng")), F.lit('"></trkpt>')).alias("p"))
    one = pts.groupBy("plan").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda x: x["p"]), "\n").alias("p"))
    return one.select("plan", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1"><trk><name>plan '), F.col("plan").cast("string"), F.lit("</name><trkseg>"), "p", F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def gpx_points(texts: DataFrame) -> DataFrame:
    """plan, place, lat, lng of the points of the tracks and routes of GPX texts, those of two points at least, whatever the order of their attributes; damaged texts go as far as they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans, sizes, lines = [], [], []
            for plan, text in zip(batch.column("plan").to_pylist(), batch.column("gpx").to_pylist()):
                try:
                    found = [rings[0] for _, _, rings in gis_files.gpx(text or "")]
                except gis_files.BadFile:
                    continue
                plans.append(plan)
                sizes.append(sum(map(len, found)))
                lines += found
            n = np.array(sizes, np.int64)
            flat, ends = gis_files.flat_points(lines), np.cumsum(n)
            plan = pa.array(plans, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            place = (np.arange(len(flat)) - np.repeat(ends - n, n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([plan, pa.array(place), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["plan", "place", "lat", "lng"])

    return texts.select(F.col("plan").cast("long").alias("plan"), "gpx").mapInArrow(run, "plan long, place int, lat double, lng double")
