"""Benchmark decontamination by word windows, in DataFrame operations only.

The windows of all benchmark items are hashed into a table of (hash, length, words) that is broadcast while it has
at most BROADCAST_WINDOWS rows; a larger one is cut by hash into parts of that size and the corpus is scanned once a part.
A document's words stay in its row: hashes of runs of 1, 2, 4 and 8 words are made from each other, a window's
hash from those its length is the sum of.  The windows of a row are exploded into the broadcast join, which compares the words
themselves, so only true hits leave the scan and are shuffled, by document.  Hits of a document are merged into spans of words.
Documents that hit the same windows share the list of items, which is made once for each such set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, discard, materialize, numbered, table

WINDOW = 10
#: Windows that are broadcast at once: some 150 bytes each.
BROADCAST_WINDOWS = 500_000
#: Lists of items up to this number are broadcast, some 150 bytes each; beyond it both sides are shuffled.
BROADCAST_SETS = 100_000
#: Characters of words; the rest of the ASCII range separates.  Those that a word is made of once A-Z are lower case.
WORD, RAW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<first:int,end:int>>"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))  # without other letters, lower() does the same faster
    return F.coalesce(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _powers(lengths: list[int]) -> list[int]:
    """1, 2, 4 ... up to the longest window."""
    return [1 << i for i in range(max(lengths, default=0).bit_length())]


def with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add _h1, _h2, _h4 ...: the hash of as many words from each word of ``_w`` on; past the end their values are never used."""
    double = lambda half, step: F.transform(half, lambda h, i: F.xxhash64(h, F.get(half, i + step)))
    for p in _powers(lengths):
        df = df.withColumn(f"_h{p}", F.transform("_w", lambda w: F.xxhash64(w)) if p == 1 else double(F.col(f"_h{p // 2}"), p // 2))
    return df


def window_hash(at: Column, length: int) -> Column:
    """From the hashes of runs that ``length`` is the sum of, the longest first."""
    parts = []
    for p in _powers([length])[::-1]:
        if length & p:
            parts.append(F.get(F.col(f"_h{p}"), at))
            at = at + p
    return parts[0] if len(parts) == 1 else F.xxhash64(*parts)


def windows_at(lengths: list[int]) -> Column:
    """All (at, n, hash) of windows of these lengths in a row of ``with_hashes``, and one entry of length 0."""
    size = F.size("_w")

    def of(n: int) -> Column:
        entry = lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), window_hash(i, n).alias("hash"))
        return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), entry)).otherwise(F.array().cast("array<struct<at:int,n:int,hash:bigint>>"))

    return F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("hash"))), *map(of, lengths))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, list[int]]:
    """(written table hash, n, gram: a row per distinct window and one of length 0; written table gram, item; the lengths that occur, ``window`` at most).

    An item's windows are its runs of ``window`` words; an item of fewer words is one window, one without words has none.
    Items with the same item_id are one; those without an item_id are left out.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("_w")).filter("item IS NOT NULL AND size(_w) > 0")
    grams = items.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(_w) - {window}, 0)), i -> slice(_w, i + 1, {window}))")).alias("_w"))
    items = materialize(grams.select("item", F.array_join("_w", " ").alias("gram"), F.size("_w").alias("n")).distinct(), "decon-items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # ``window`` of them at most
    distinct = with_hashes(items.select("gram", "n").distinct().withColumn("_w", F.split("gram", " ")), lengths)
    own = reduce(lambda acc, n: F.when(F.col("n") == n, window_hash(F.lit(0), n)).otherwise(acc), lengths, F.lit(None).cast("long"))
    always = benchmark.sparkSession.createDataFrame([(0, 0, "")], "hash long, n int, gram string")
    return materialize(distinct.select(own.alias("hash"), "n", "gram").unionByName(always), "decon-windows"), items, lengths


def _hits(rows: DataFrame, windows: DataFrame, lengths: list[int], most: int) -> DataFrame:
    """ROW, doc_id, n_words, at, end, gram: every occurrence of a window in a row (ROW, doc_id, text), and one of length 0 for each row, so that one scan sees all."""
    scan = with_hashes(rows.select(ROW, "doc_id", words_of(F.col("text")).alias("_w")), lengths).select(ROW, "doc_id", "_w", F.explode(windows_at(lengths)).alias("x"))
    parts, found = -(-windows.count() // most), []
    for part in range(parts):
        some = windows if parts == 1 else windows.filter(F.pmod(F.xxhash64("hash"), F.lit(parts)) == part)
        same = (F.col("x.hash") == F.col("hash")) & (F.col("x.n") == F.col("n")) & (F.array_join(F.slice("_w", F.col("x.at") + 1, F.col("x.n")), " ") == F.col("gram"))
        found.append(scan.join(F.broadcast(some), same).select(ROW, "doc_id", F.size("_w").alias("n_words"), F.col("x.at").alias("at"), (F.col("x.at") + F.col("n")).alias("end"), "gram"))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """ROW, doc_id, n_words, n_hit, n_items, items_sha256, spans (words [first, end) from 0, merged): a row per row of ``docs``.

    ``docs`` needs ROW, a distinct key, doc_id and text.  Documents without words, or with a null text, hit nothing.
    """
    windows, items, lengths = benchmark_windows(benchmark, window)
    hits = _hits(docs, windows, lengths, most)
    # one shuffle by document: what follows keeps its partitioning
    by = Window.partitionBy(ROW).orderBy("at", "end")
    hits = hits.withColumn("_new", (F.col("at") > F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    hits = hits.withColumn("_span", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = hits.groupBy(ROW, "_span").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.min("at").alias("first"), F.max("end").alias("end"), F.collect_set("gram").alias("grams"))
    # of one document, which was one row before; the window of length 0 goes
    merged = F.filter(F.sort_array(F.collect_list(F.struct("first", "end"))), lambda s: s["end"] > s["first"])
    found = spans.groupBy(ROW).agg(F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list("grams")), lambda g: g != ""))).alias("grams"))
    found = materialize(found.withColumn("_set", F.when(F.size("grams") > 0, F.sha2(F.array_join("grams", "\n"), 256))), "decon-found")
    # copies of a passage give the same set of windows: its items are listed once
    sets = found.filter("_set IS NOT NULL").groupBy("_set").agg(F.first("grams").alias("grams")).select("_set", F.explode("grams").alias("gram"))
    lists = sets.join(items.select("gram", "item"), "gram").groupBy("_set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = materialize(lists.select("_set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "decon-lists")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    found = found.select(ROW, "doc_id", "n_words", n_hit.alias("n_hit"), "spans", "_set")
    dirty = found.filter("_set IS NOT NULL").join(F.broadcast(lists) if lists.count() <= BROADCAST_SETS else lists, "_set").drop("_set")
    clean = found.filter("_set IS NULL").drop("_set").withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    discard(windows, items)
    return clean.unionByName(dirty)


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: a row per row of ``docs``.

    Null texts have no words.  Rows with the same doc_id, or without one, are documents of their own.  Extra columns don't matter.
    """
    rows = numbered(docs.select("doc_id", "text"), "decon-docs")
    found = contamination(rows, benchmark, window, most).withColumn("contaminated", F.col("n_hit") > 0)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` and the separators before each of them."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)" + RAW_WORD.replace("[^", "[").replace("+", "*") + RAW_WORD), F.lit(0))
    kept = F.filter(tokens, lambda t, i: ~F.exists(spans, lambda s: (i >= s["first"]) & (i < s["end"])))
    rest = F.substring(text, F.aggregate(tokens, F.lit(1), lambda acc, t: acc + F.length(t)), F.length(text))
    return F.concat(F.array_join(kept, ""), rest)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, whole_from: float = 1.0, window: int = WINDOW) -> DataFrame:
    """``docs`` with benchmark passages taken out: the words of hit windows are cut from the text; a document goes whole if
    at least ``whole_from`` of its words are hit (0: every contaminated document goes; above 1: none).

    Clean rows, null texts among them, stay as they are.  n_chars, if there, follows the text.
    """
    rows = numbered(docs, "decon-docs")
    found = contamination(rows, benchmark, window).filter("n_hit > 0").select(ROW, F.col("spans").alias("__spans"), (F.col("n_hit") >= F.lit(whole_from) * F.col("n_words")).alias("__whole"))
    rows = rows.join(found.hint("merge"), ROW, "left").filter("NOT coalesce(__whole, false)")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(without_spans(F.col("text"), F.col("__spans")))
    out = {"text": text} | ({"n_chars": F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


#: The same by listing all windows of documents and items.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}'), []) AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark),
     g AS (SELECT DISTINCT item, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS gram, least(len(w), {WINDOW}) AS n FROM (SELECT item, w, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS i FROM b WHERE len(w) > 0 AND item IS NOT NULL)),
     s AS (SELECT k, i, n, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM (SELECT k, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM g))),
     h AS (SELECT DISTINCT k, i, n, item FROM s JOIN g USING (gram, n)),
     p AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
     t AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (k) LEFT JOIN t USING (k)
"""
