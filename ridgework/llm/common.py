"""What the operators of this subpackage share: the shared folder, written tables and skew-safe running sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a regular expression class without brackets.
WS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where it is unset and all runs on one machine (tests) a temporary folder is made and kept in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ridgework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/ridgework/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written, when all that was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/ridgework/" in folder:  # only what fresh_path has named
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of texts that go to a Python worker at once, unless the session says otherwise.
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory, as a worker that waits for its next task counts as its executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of few bytes: ten thousand rows, Spark's default, are many megabytes of texts on both sides of the pipe.

    A worker gives freed memory back at the end of each task.
    """

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


#: Key of a row within one stage of the pipeline, where doc_id may be null or repeated.
ROW = "__row_key"
#: Keys up to this number (16 MB) are broadcast; beyond it both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ROW, a distinct key that all later reads see alike.

    It is the doc_id where those are distinct and not null; else the rows are numbered and written once.
    """
    again = docs.select(F.col("doc_id").cast("long").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR d IS NULL")
    if again.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def rows_with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose ROW is in the written table ``keys``."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge"), ROW, "left_semi").drop(ROW)


def row_key(df: DataFrame) -> list[str]:
    """[ROW] if ``df`` carries it, else nothing."""
    return [ROW] if ROW in df.columns else []


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_start(df: DataFrame, keys: list[str], order: list[str], value, out: str, buckets: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before, as a long.

    The order within a key is by a hash bucket of ``order``, then ``order`` itself; it is fixed
    by the rows alone.  A key's rows are spread over ``buckets`` hash buckets, each summed on its
    own; the totals of the buckets (at most ``buckets`` rows a key) give the offsets.  So no key,
    however hot, has its rows in one task.  ``keys`` must not be null; rows that tie in all of
    ``order`` follow each other in any order.
    """
    spark = df.sparkSession
    n = buckets or 2 * partitions(spark)
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int")).withColumn("_v", value)
    totals = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return df.join(offsets, [*keys, "_b"]).withColumn(out, (F.col(out) + F.col("_o")).cast("long")).drop("_b", "_v", "_o")


def before_in_order(df: DataFrame, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """Written table with, for each of ``sums``, the sum of its column over all rows that come before in ``order``, which tells all rows apart.

    Rows are range-partitioned by ``order``; the totals of the ranges, a row each, give the offsets, so no task orders everything.
    """
    df = materialize(df.withColumns({f"_v_{c}": v for c, v in sums.items()}).repartitionByRange(partitions(df.sparkSession), *order).withColumn("_p", F.spark_partition_id()), name)
    totals = df.groupBy("_p").agg(*(F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums))
    earlier, inside = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", *(F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums))  # a row a range: broadcast
    df = df.withColumns({c: F.coalesce(F.sum(f"_v_{c}").over(inside), F.lit(0)) for c in sums}).join(F.broadcast(offsets), "_p")
    return df.withColumns({c: F.col(c) + F.col(f"_o_{c}") for c in sums}).drop("_p", *(f"_v_{c}" for c in sums), *(f"_o_{c}" for c in sums))


ROUNDS, WALKS = 4, 24


def quotient(x: Column, by: Column) -> Column:
    """x div by of longs, exact as long as the quotient is below 2 ** 52."""
    return F.round((x - F.pmod(x, by)) / by).try_cast("long")


def permuted(j: Column, n: Column, prf, bind=lambda x, f: f(x)) -> Column:
    """A keyed permutation of 0..n-1 (n up to 10 ** 18): a Feistel network over pairs below (a, b), a = ceil(sqrt n), a * b >= n.

    prf(round, half) gives a pseudorandom long of a half.  A result outside 0..n-1 is walked on.  Fewer
    than a + b results are outside and a walk visits each once at most; one longer than WALKS has odds of about
    (a * b / n - 1) ** WALKS, which only counts for n so small that no walk is that long.
    bind(x, f) is f of x; inside lambdas, where Spark evaluates a column as often as it occurs, give one that evaluates x once.
    """

    def network(n: Column, a: Column, b: Column) -> Column:
        def rounds(left: Column, right: Column, r: int) -> Column:
            if r == ROUNDS:
                return left * b + right
            if r % 2 == 0:
                return bind(F.pmod(left + F.pmod(prf(r, right), a), a), lambda x: rounds(x, right, r + 1))
            return bind(F.pmod(right + F.pmod(prf(r, left), b), b), lambda x: rounds(left, x, r + 1))

        step = lambda x: bind(quotient(x, b), lambda left: bind(F.pmod(x, b), lambda right: rounds(left, right, 0)))
        walk = lambda once: F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once, lambda x, _: F.when(x < n, x).otherwise(step(x)))
        return bind(bind(j, step), lambda once: F.when(once < n, once).otherwise(walk(once)))

    size = lambda n: bind(F.ceil(F.sqrt(n.cast("double"))).try_cast("long"), lambda a: bind(quotient(n + a - 1, a), lambda b: network(n, a, b)))
    return bind(n, size)
