"""Where intermediate tables go, and order statistics that no single task has to hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whether a query's shuffle files go when it ends, from Spark 4.1 on; earlier ones delete them when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables of at most this many bytes may be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a folder of this process, which only a local session can use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_hyperweft_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark._hyperweft_dir = tempfile.mkdtemp(prefix="hyperweft-")
    return base.rstrip("/")


def new_path(spark, tag: str) -> str:
    """A new path for a table of this application."""
    return f"{shared_dir(spark)}/hyperweft/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def discard(spark) -> None:
    """Delete all intermediate tables of this application; results that read them must have been written before."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/hyperweft/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. What was shuffled for it is deleted then, as only it needed that."""
    path, conf = new_path(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, hot: int = 500, row_bytes: int = 64) -> DataFrame:
    """Inner join with right, a written table of one row a key whose column `weight` counts the rows that left has of it.

    Keys of more than `hot` rows are joined where left's rows are, by a broadcast, so that no task gathers them. There are few
    of them: the bound on `hot` rises until they fit the broadcast limit. All other keys are shuffled.
    """
    while (n := right.filter(F.col(weight) > hot).count()) * row_bytes > BROADCAST_BYTES:
        hot *= 4
    if not n:
        return left.join(right, on)
    heavy = right.filter(F.col(weight) > hot)
    rest = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.filter(F.col(weight) <= hot), on)
    return left.join(F.broadcast(heavy), on).unionByName(rest)


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    return cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "dealt")


def running_sum(df: DataFrame, order: list[Column], value: Column, out: str, unique: bool = True) -> DataFrame:
    """Add `out`, the sum of value over all rows up to and including this one (with its ties, unless unique).

    Rows are dealt by ranges of the order; only one sum for each range meets in one place.
    """
    dealt = _dealt(df.withColumn("__value", value), order)
    sums = dealt.groupBy("__part").agg(F.sum("__value").alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, 0) if unique else within.rangeBetween(Window.unboundedPreceding, 0)
    out_rows = dealt.join(F.broadcast(sums), "__part")  # as many rows as shuffle partitions
    return out_rows.withColumn(out, F.sum("__value").over(within) + F.col("__before")).drop("__part", "__value", "__before")


def numbered(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Add row numbers from 1 in the given total order."""
    return running_sum(df, order, F.lit(1), out).withColumn(out, F.col(out).cast("long"))


def mean_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Add the rank of value with ties averaged, within groups `by` or overall: ranks are made of the counts of distinct values."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    if by:
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__upto", F.sum("__n").over(w))
    else:
        counts = running_sum(counts, [F.col(value)], F.col("__n"), "__upto")
    counts = counts.select(*by, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return df.join(counts, [*by, value])


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df may be broadcast."""
    return df.count() * row_bytes <= limit
