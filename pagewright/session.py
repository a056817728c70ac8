"""Session, table and partitioning helpers shared by every operator."""

from __future__ import annotations

import math
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bytes of estimated input that one Python-heavy task should see.
BYTES_PER_TASK = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the sources of a plan, by Catalyst's statistics; no job is run. Sources of unknown size (RDDs) count by their partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    return known if len(sizes) == sum(x < 1 << 60 for x in sizes) else known + df.rdd.getNumPartitions() * BYTES_PER_TASK


def scan_tasks(df: DataFrame) -> int | None:
    """Tasks that would share the work of a plan of narrow steps over files; null if the plan shuffles, as its tasks are not known before it runs.

    A file counts for one task for each 128 MB at most, as a row group is not divided.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return None
    files = len(df.inputFiles())
    return min(df._jdf.rdd().getNumPartitions(), max(files, estimated_bytes(df) >> 27)) if files else None


def spread(df: DataFrame, *keys: str | Column, per_task: int = BYTES_PER_TASK, least: int | None = None) -> DataFrame:
    """Rows over enough tasks for Python-heavy work; shuffled only where the scan alone has fewer tasks than two a core.

    A parquet file with one large row group is read by one task; hashing on an
    id spreads its rows evenly, and does so the same way when a task is rerun.
    The number of partitions follows the estimated size of the input. A scan of
    many files or row groups stays as it is, and no text crosses the network.
    """
    low = least or 2 * parallelism(df.sparkSession)
    tasks = scan_tasks(df)
    if tasks is not None and tasks >= low:
        return df
    return df.repartition(max(low, math.ceil(estimated_bytes(df) / per_task)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by spark.checkpoint.dir; set here only where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = f"file://{os.environ.get('TMPDIR', '/tmp')}/pagewright-{uuid.uuid4().hex}"
    sc.setCheckpointDir(folder)
    return folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: written once, it survives the loss of any executor, and later steps read only the columns they need.

    The files go when the driver's JVM ends; the shuffles of the write go with it, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(name)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(name)


# Hot keys that a salted join treats apart, at most: a key is hot only if it has a larger share of the rows than one in so many.
MOST_HOT = 10_000


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], row_id: str, how: str = "inner", hot_rows: int = 200_000, counts: DataFrame | None = None) -> DataFrame:
    """Equi-join of a side with hot keys to a side with one row a key. No job runs while the plan is built.

    A key is hot if a pre-aggregated count gives it more than ``hot_rows`` rows
    and more than one in MOST_HOT of all rows; so there are fewer than MOST_HOT
    hot keys at any size, and their list is broadcast. Each hot key is split over
    ceil(rows / hot_rows) salts on the large side and repeated as often on the
    other; all further keys keep salt 0. No row is lost. ``counts`` gives
    (keys, _n) where they are known already.
    """
    counts = counts if counts is not None else many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))  # one row
    hot = counts.crossJoin(total).filter((F.col("_n") > hot_rows) & (F.col("_n") * MOST_HOT > F.col("_all")))
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    left = many.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(row_id), F.col("_salts")).cast("int"))).drop("_salts")
    right = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, by: str, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the number of each row within its group, from 1, without bringing a group into one task.

    Rows are sorted by ranges over the whole cluster and kept; the rows of a
    group in the ranges before one are the offset of its own numbers.
    """
    ranged = df.repartitionByRange(F.col(by).asc_nulls_first(), *order).sortWithinPartitions(F.col(by).asc_nulls_first(), *order)
    # the low bits of the id count the rows of a partition
    marked = cut_lineage(ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = marked.groupBy(F.col(by).alias("_g"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range and group that begins in it
    offset = parts.select("_g", "_q", (before - F.col("_first") + 1).alias("_o"))
    joined = marked.join(offset, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn(name, (F.col("_i") + F.col("_o")).cast("int")).drop("_p", "_i", "_g", "_q", "_o")
