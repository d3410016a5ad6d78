"""From raw documents to packed training sequences: score, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; between stages the rows are written as Parquet and read again.  All stages but the last
return the columns of ``documents``.  The mix may hold a document twice, each time with the blocks of
words drawn in that epoch, so the packed pieces may repeat a doc_id.  Stages decide on rows, not on
doc_ids: rows with a null doc_id, or with the same one, are documents of their own in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgework.llm import exact_dedup, mixing, ngram_join, packing, quality
from ridgework.llm.common import discard, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, doesn't reject."""
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_distinct(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight, as documents."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", keep_distinct),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the classifier nor the draws of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:  # the table of the stage before has been read
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
