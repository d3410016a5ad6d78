"""Exact deduplication by a content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts by (first characters, 64-bit hash, salt),
Spark's external sort places equal texts next to each other, and a window that runs over
neighbours compares the whole texts and keeps one row of each run.

A text of very many copies would fill one range.  A first count over 64-bit hashes finds texts
with more than 1 / (4 * partitions) of the rows; there are fewer than 4 * partitions such, so the
table of them may be broadcast.  Their rows get a salt that splits them into runs of about that
size.  Each run is deduplicated like any other; the heads of the salted runs, a few rows a hot
text, are then resolved by comparing their whole texts, and the result is joined back by run.
Only sampled keys of bounded length, never whole texts, reach the driver as splitters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, WS, discard, materialize, numbered, partitions, row_key, rows_with_keys, table

#: Characters of the normalised text that take part in the range splitters.
PREFIX = 32
#: A text with fewer copies is never salted.
LEAST_HOT = 64


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")


def content_groups(docs: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per row of ``docs``.

    Texts are equal if they are identical without ASCII white space; null counts as empty.  Of equal
    texts the one with the most code points, then the smallest doc_id (null last) stays; of rows that
    tie in both, one.  ``kept`` marks that row; ``keep_id`` is its doc_id.  Extra columns don't matter, but ROW is returned.
    """
    spark, key = docs.sparkSession, row_key(docs)
    n = n_partitions or partitions(spark)
    base = docs.select("doc_id", *key, F.length(F.coalesce("text", F.lit(""))).alias("_len"), normalised(F.col("text")).alias("_norm"))
    hashes = docs.select(F.xxhash64(normalised(F.col("text"))).alias("_h")).groupBy("_h").agg(F.count("*").alias("_c"))
    hashes = materialize(hashes.filter(F.col("_c") >= LEAST_HOT), "content-counts")
    total = docs.count()
    least = max(LEAST_HOT, total / (4 * n))
    # fewer than 4 * partitions rows, as each stands for more than 1 / (4 * partitions) of all
    hot = hashes.filter(F.col("_c") > least).select("_h", F.ceil(F.col("_c") / F.lit(least)).alias("_k"))
    rows = base.withColumn("_h", F.xxhash64("_norm")).join(F.broadcast(hot), "_h", "left")
    rows = rows.withColumn("_salt", F.when(F.col("_k").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("_k"))).cast("int")).drop("_k")
    rows = rows.withColumn("_p", F.substring("_norm", 1, PREFIX)).repartitionByRange(n, "_p", "_h", "_salt")
    # the ranges already hold a run's rows together, so the window adds a sort and no exchange
    run = Window.partitionBy("_p", "_h", "_salt", "_norm")
    first = run.orderBy(F.col("_len").desc(), F.col("doc_id").asc_nulls_last())
    runs = rows.select(
        "doc_id", *key, "_len", "_h", "_salt",
        F.first("doc_id").over(first).alias("_head"), F.first("_len").over(first).alias("_head_len"),
        F.count(F.lit(1)).over(run).alias("_n"), F.row_number().over(first).alias("_rn"), "_norm",
    )
    runs = runs.select("doc_id", *key, "_salt", "_head", "_head_len", "_n", "_rn", F.sha2("_norm", 256).alias("text_sha256"), F.when((F.col("_salt") >= 0) & (F.col("_rn") == 1), F.col("_norm")).alias("_text"))
    runs = materialize(runs, "content-runs")
    discard(hashes)
    plain = runs.filter("_salt < 0").select("doc_id", F.col("_head").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_rn") == 1).alias("kept"), "text_sha256", *key)
    heads = runs.filter("_salt >= 0 AND _rn = 1")  # at most 8 * partitions rows
    of = Window.partitionBy("text_sha256", "_text")
    best = of.orderBy(F.col("_head_len").desc(), F.col("_head").asc_nulls_last(), "_salt")
    heads = heads.select("text_sha256", "_salt", F.first("_head").over(best).alias("keep_id"), F.sum("_n").over(of).alias("group_size"), (F.row_number().over(best) == 1).alias("_wins"))
    salted = runs.filter("_salt >= 0").join(F.broadcast(heads), ["text_sha256", "_salt"]).select("doc_id", "keep_id", "group_size", (F.col("_wins") & (F.col("_rn") == 1)).alias("kept"), "text_sha256", *key)
    return plain.unionByName(salted)


def keep_distinct(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``content_groups`` drops, also where doc_ids are null or repeated."""
    rows = numbered(docs, "content-docs")
    groups = content_groups(rows)
    kept = materialize(groups.filter("kept").select(ROW), "content-kept")
    discard(groups)
    return rows_with_keys(rows, kept).select(*docs.columns)


def op5_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"))


#: One row of each group stays; ``{documents}`` is the table.
SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY len DESC, doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""
