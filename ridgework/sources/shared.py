"""Tables written in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task of ``dealt`` gets; of light ones up to MOST_ROWS, where that keeps tasks at MERGED: up to so many a shuffle's writers hold no rows to sort.
ROWS_A_TASK, MOST_ROWS, MERGED = 100_000, 2_000_000, 200


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder below ``spark.checkpoint.dir`` that nobody has used; a temporary folder is set only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ridgework-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ridgework/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and read back in a fresh folder: cuts lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a small table that make much work, dealt to a few tasks a core (by columns, or evenly); partitions of a given number stay as many."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def dealt(df: DataFrame, *by: str, light: bool = False) -> DataFrame:
    """Rows dealt by columns to as many tasks as hold some ROWS_A_TASK each, so that what a task sorts or groups doesn't grow with the input.

    The rows are counted first: give a table as it is read, of which that takes no column.  With ``light`` rows make no more rows in their task.
    """
    rows = df.count()
    n = -(-rows // ROWS_A_TASK)
    if light:
        n = max(min(n, MERGED), -(-rows // MOST_ROWS))
    return df.repartition(max(1, n), *by)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` has made, when all that follows from it is written itself."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/ridgework/" in folder:  # only what ``written`` has named
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
