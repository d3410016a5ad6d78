"""Mixing sources to target weights, in DataFrame operations only.

A source's documents are laid end to end as one stream of words (documents in the order of a hash
of their id), which is cut into blocks of fixed length.  The mix is cut into output shards of a fixed number of slots, and each shard draws how
many of its slots go to which source.  Of what a source may expect of a shard the whole slots are certain; those that are left of the shard are drawn
multinomially, with what is left of the sources' expectations as probabilities.  So counts over sources are random in every shard and always add up to it, and their
sums over shards come near the targets.  A source's slots are numbered by prefix sums over the shards.
Slot j takes block perm(j mod blocks), where perm is a keyed pseudorandom permutation of the source's block
indices (``common.permuted``); slots and blocks meet in a join on (source, block index).  Slots beyond the cap times a source's blocks stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, WS, before_in_order, discard, materialize, numbered, partitions, permuted, row_key, running_start, table

BLOCK_WORDS = 32
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
SEED = 17
#: Slots of an output shard.
SHARD_SLOTS = 16384
#: Parts of a slot in which expectations are compared, and bins in which draws find their source.
UNIT, BINS = 1 << 32, 1 << 12
#: Slots that one row of the plan expands to.
CHUNK = 4096
#: Sources up to this number are broadcast; beyond it, a shuffle join.
FEW_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters that aren't ASCII white space."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{WS}]+", "x")
    return F.length(F.regexp_replace(marked, f"[{WS}]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add weight and target to a table of sources (source, source_size), one row each.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all
    sizes; a target stops at ``cap`` times the size and the excess goes to the others by weight until
    none is above.  That is water filling: with sources by ascending cap / weight, source i is capped
    if it would be above its cap when all before it are.
    """
    s = before_in_order(sizes, [F.col("source").asc_nulls_last()], {"_i": F.lit(1)}, "mix-turns")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_i", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    s = before_in_order(s, ["_ratio", "_i"], {"_caps": F.col("_cap"), "_w": F.col("weight")}, "mix-caps")
    total = s.agg(F.sum("source_size").alias("_sizes"), F.sum("weight").alias("_weights"))  # one row
    s = s.crossJoin(F.broadcast(total)).withColumn("_level", (F.lit(share) * F.col("_sizes") - F.col("_caps")) / (F.col("_weights") - F.col("_w")))
    s = s.withColumn("_capped", F.col("weight") * F.col("_level") > F.col("_cap"))
    level = s.agg(F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_i", "_level")))["_level"].alias("_at"))  # one row
    s = s.crossJoin(F.broadcast(level))
    return s.select("source", "source_size", "weight", F.when(F.col("_capped") | F.col("_at").isNull(), F.col("_cap")).otherwise(F.col("weight") * F.col("_at")).alias("target"))


def lay_out(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Written table doc_id, _src, _null, size, start (and ROW if ``docs`` has it): each document's place in its source's word stream."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_null"), n_words(F.col("text")).alias("size"), *row_key(docs))
    rows = materialize(rows, "mix-sizes")
    layout = materialize(running_start(rows, ["_src", "_null"], ["doc_id", "size"], F.col("size"), "start"), "mix-layout")
    discard(rows)
    return layout


def _each(df: DataFrame, n: Column, out: str, *keys: str) -> DataFrame:
    """``df`` once for each ``out`` of 0..n-1, made in chunks by many tasks; the few rows of ``df`` differ in ``keys``."""
    chunks = df.withColumn("_n", n).filter("_n > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK).cast("long")))).repartition(4 * partitions(df.sparkSession), *keys, "_c")
    return chunks.withColumn(out, F.explode(F.sequence(F.col("_c") * CHUNK, F.least((F.col("_c") + 1) * CHUNK, F.col("_n")) - 1))).drop("_c", "_n")


def deal(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Written table _src, _null, shard, drawn: how many slots of each output shard go to each source, where any do.

    plan: _src, _null, slots (a double: what the source may expect of the whole mix).  Shards have ``shard_slots`` slots, the last one what is left; there are two
    kinds of them, and a source expects the same of every shard of a kind.  Draws fall on the sources' fractions laid end to end; both meet on bins of that line.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("slots")).first()[0] or 0.0  # one row
    n = round(total)
    kinds = [(0, shard_slots, n // shard_slots, 0), (1, n % shard_slots, int(n % shard_slots > 0), n // shard_slots)]
    kinds = [k for k in kinds if k[1] and k[2]]
    kind = spark.createDataFrame(kinds, "kind int, size long, shards long, first long")  # two rows
    e = plan.crossJoin(F.broadcast(kind)).withColumn("_e", F.col("size") * F.col("slots") / F.lit(total or 1.0))
    e = e.withColumn("whole", F.floor("_e").cast("long")).withColumn("units", F.floor((F.col("_e") - F.floor("_e")) * UNIT).cast("long")).drop("_e", "slots")
    e = materialize(running_start(e, ["kind"], ["_src", "_null"], F.col("units"), "start"), "mix-expected")
    line = e.groupBy("kind", "size", "shards", "first").agg(F.sum("whole").alias("whole"), F.sum("units").alias("units"))  # two rows
    certain = _each(e.filter("whole > 0").select("_src", "_null", "kind", "shards", "first", "whole"), F.col("shards"), "shard", "_src", "_null", "kind").select("_src", "_null", (F.col("first") + F.col("shard")).alias("shard"), F.col("whole").alias("drawn"))
    width = F.greatest(F.ceil(F.col("units") / BINS), F.lit(1)).cast("long")
    draws = _each(line.filter("units > 0").withColumn("left", F.col("size") - F.col("whole")).withColumn("width", width), F.col("shards") * F.col("left"), "d", "kind")
    draws = draws.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "first", "d"), F.col("units")))
    draws = draws.select("kind", (F.col("first") + F.floor(F.col("d") / F.col("left"))).cast("long").alias("shard"), "u", F.floor(F.col("u") / F.col("width")).cast("long").alias("bin"))
    on = e.filter("units > 0").join(F.broadcast(line.select("kind", width.alias("width"))), "kind").select("_src", "_null", "kind", "start", (F.col("start") + F.col("units")).alias("end"), "width")
    on = on.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")).cast("long"), F.floor((F.col("end") - 1) / F.col("width")).cast("long")))).drop("width")
    # the hint: neither side need be small
    drawn = draws.join(on.hint("merge"), ["kind", "bin"]).filter("u >= start AND u < end").groupBy("_src", "_null", "shard").agg(F.count(F.lit(1)).alias("drawn"))
    dealt = materialize(certain.unionByName(drawn).groupBy("_src", "_null", "shard").agg(F.sum("drawn").alias("drawn")), "mix-dealt")
    discard(e)
    return dealt


def draw(layout: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sources with their targets, slots of the mix: _src, _null, shard, slot, epoch, block)."""
    sizes = layout.groupBy("_src", "_null").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes.withColumn("source", F.when(~F.col("_null"), F.col("_src"))), weights, share, cap)
    sources = sources.withColumn("_src", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    sources = materialize(sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block))), "mix-sources")
    # words a slot takes on average; the last block of a source may be shorter
    mean = F.col("source_size") / F.greatest(F.col("blocks"), F.lit(1))
    plan = sources.filter("source_size > 0 AND target > 0").select("_src", "_null", "blocks", (F.col("target") / mean).alias("slots"))
    dealt = deal(plan.select("_src", "_null", "slots"), shard_slots, seed)
    numbers = materialize(running_start(dealt, ["_src", "_null"], ["shard"], F.col("drawn"), "first"), "mix-numbers")
    discard(dealt)
    few = F.broadcast(plan.select("_src", "_null", "blocks")) if sources.count() <= FEW_SOURCES else plan.select("_src", "_null", "blocks")
    slots = _each(numbers.join(few, ["_src", "_null"]), F.col("drawn"), "slot", "_src", "_null", "shard").withColumn("slot", F.col("first") + F.col("slot")).filter(F.col("slot") < F.floor(F.lit(cap)) * F.col("blocks"))
    prf = lambda r, half: F.xxhash64(F.lit(seed), F.lit(r), "_src", "_null", half)
    slots = slots.select(
        "_src", "_null", "shard", "slot",
        F.floor(F.col("slot") / F.col("blocks")).cast("int").alias("epoch"), permuted(F.pmod("slot", "blocks"), F.col("blocks"), prf).alias("block"),
    )
    return sources, slots


def spans(layout: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and block that it has words in: doc_id, _src, _null, size, start, block, words."""
    end = F.col("start") + F.col("size")
    rows = layout.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    return rows.withColumn("words", F.least(end, (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block))


def mix_counts(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row per row of ``docs``.

    Null text has size 0 and is taken 0 times; null is a source of its own, the last.  A source whose
    documents have no words has target 0.  Rows that are equal in doc_id, source and size share what
    they are taken alike.  Reruns agree: places, draws and permutations are functions of the rows and the seed.
    """
    layout = lay_out(docs, block)
    sources, slots = draw(layout, weights, share, cap, block, shard_slots, seed)
    times = slots.groupBy("_src", "_null", "block").agg(F.count(F.lit(1)).alias("times"))
    # the hint: the planner takes a table that grows out of the few rows of sources for a small one
    taken = spans(layout, block).join(times.hint("merge"), ["_src", "_null", "block"], "left").groupBy("doc_id", "_src", "_null", "size", "start")
    taken = taken.agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    rows = taken.unionByName(layout.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    few = sources.count() <= FEW_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, ["_src", "_null"]).select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix_shards(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """What each output shard holds, to be written by shard: shard, slot, source, doc_id, first (word of the document), words.

    A slot is a block of its source, so it may hold the end of one document and the start of the next, a row each.
    """
    layout = lay_out(docs, block)
    _, slots = draw(layout, weights, share, cap, block, shard_slots, seed)
    rows = spans(layout, block).join(slots.hint("merge"), ["_src", "_null", "block"])
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    return rows.select("shard", "slot", F.when(~F.col("_null"), F.col("_src")).alias("source"), "doc_id", first.alias("first"), "words")


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row per document and epoch in which some of its blocks are drawn, with the columns of ``docs``.

    Its text holds the words of those blocks; a document whose blocks are all drawn keeps its text as it is.
    n_chars, if there, follows the text.  Rows with a null doc_id, or with the same one, are documents of their own.
    """
    numbered_docs = numbered(docs, "mix-docs")
    layout = lay_out(numbered_docs, block)
    _, slots = draw(layout, weights, share, cap, block, shard_slots, seed)
    drawn = spans(layout, block).join(slots.select("_src", "_null", "block", "epoch").hint("merge"), ["_src", "_null", "block"])
    drawn = drawn.groupBy(ROW, "epoch", F.col("start").alias("_start"), F.col("size").alias("_size")).agg(F.sum("words").alias("_taken"), F.sort_array(F.collect_set("block")).alias("_blocks")).drop("epoch")
    rows = numbered_docs.join(drawn, ROW)
    words = F.split(F.regexp_replace("text", f"^[{WS}]+", ""), f"[{WS}]+")
    size, to = F.lit(block), F.col("_start") + F.col("_size")
    of_block = lambda w, b: F.slice(w, F.greatest(b * size - F.col("_start"), F.lit(0)).cast("int") + 1, (F.least((b + 1) * size, to) - F.greatest(b * size, F.col("_start"))).cast("int"))
    # the words are an element of an array, so that they are split once and not for each block
    part = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("_blocks", lambda b: of_block(w, b))), " "))[0]
    text = F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(part)
    out = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).drop("source")
