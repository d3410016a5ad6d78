"""Catalogue entities: versioned writes, inserts, sparse patches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that a patch may set.
FIELDS = {"rate": "double", "max_slope": "double", "active": "boolean"}


def updated(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """id, seq, status, version (after it) of updates (id, seq, expected or null) against entities (id, version, standard), in order of seq per entity.

    404 without such an entity, 409 on a standard one or if the expected version isn't the current one; else 200 and the next version.
    Updates are dealt by entity and sorted; a task walks them with the version of one entity, so no entity's updates are held at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, version = object(), None
        for f in frames:
            status, after = [], []
            for key, there, standard, start, expected in zip(f["id"], f["there"], f["standard"], f["version"], f["expected"]):
                if key != of:
                    of, version = key, int(start) if there else None
                good = there and not standard and (pd.isna(expected) or expected == version)
                version = version + 1 if good else version
                status.append(200 if good else 409 if there else 404)
                after.append(version)
            yield pd.DataFrame({"id": f["id"], "seq": f["seq"], "status": status, "version": pd.array(after, "Int64")})

    known = entities.select("id", F.col("version").cast("long").alias("version"), F.coalesce("standard", F.lit(False)).alias("standard"), F.lit(True).alias("there"))
    rows = updates.select("id", "seq", F.col("expected").cast("long").alias("expected")).join(known, "id", "left").withColumns({"there": F.coalesce("there", F.lit(False)), "standard": F.coalesce("standard", F.lit(False)), "version": F.coalesce("version", F.lit(0).cast("long"))})
    return rows.repartition("id").sortWithinPartitions("id", "seq").mapInPandas(run, f"id {dict(updates.dtypes)['id']}, seq {dict(updates.dtypes)['seq']}, status int, version long")


def inserted(entities: DataFrame, inserts: DataFrame) -> DataFrame:
    """id, seq, status: 201 for the first insert of an id that no entity has, 409 for all others."""
    first = inserts.groupBy("id").agg(F.min("seq").alias("_first")).join(entities.select("id", F.lit(True).alias("_there")), "id", "left")
    return inserts.join(first, "id").select("id", "seq", F.when(F.col("_there").isNull() & (F.col("seq") == F.col("_first")), 201).otherwise(409).alias("status"))


def patched(entities: DataFrame, patches: DataFrame) -> DataFrame:
    """Entities with the fields that their patch (id, fields as JSON text) sets; other keys are ignored, a text that is no object sets nothing."""
    j = entities.join(patches, "id", "left").withColumn("_keys", F.coalesce(F.json_object_keys("fields"), F.array().cast("array<string>")))
    return j.select("id", *(F.when(F.array_contains("_keys", c), F.get_json_object("fields", f"$.{c}").try_cast(t)).otherwise(F.col(c)).alias(c) for c, t in FIELDS.items()))


def differing(base: DataFrame, edited: DataFrame) -> DataFrame:
    """id, fields: names of the fields in which an edited entity differs from its base, in their order."""
    e = edited.select("id", *(F.col(c).alias(f"_{c}") for c in FIELDS))
    return base.join(e, "id").select("id", F.array_join(F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in FIELDS))), ",").alias("fields"))
