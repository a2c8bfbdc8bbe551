"""Tables in the folder that driver and executors share, and exact ranks without a task that holds a group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Only a local-mode session may lack the setting; it then gets a folder of its own, kept in the setting.
    """
    found = spark.conf.get(SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='atlasmill-')}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # the table stands, so its shuffle files may go
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Deletes the table behind a stashed frame, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of so many rows at most are sent to all tasks, whatever the session's own limit.
SMALL = 100_000


def small(table: DataFrame) -> DataFrame:
    """A stashed table, marked to be sent to the rows it is joined with if it is small, so that these stay where they are."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, group: str, order: list[Column], label: str, rank: str = "_rank") -> DataFrame:
    """Adds each row's place (from 0) in its group under a total order, with no task that holds a whole group.

    Rows are range-partitioned on the order, which must start with the group, and written once with
    a row counter. Each range contributes one row per group it holds to a prefix sum, so a hot group
    is split over as many tasks as its rows need. Null groups are one group.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    table = stash(placed.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright(F.col("_at"), 33)
    runs = table.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = small(stash(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), f"{label}-runs"))
    joined = table.join(runs, (part == F.col("_part")) & table[group].eqNullSafe(F.col("_group")))
    return joined.withColumn(rank, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_group", "_first", "_n", "_before")


def cume_dist(df: DataFrame, group: str, value: str, label: str = "cume") -> DataFrame:
    """Adds share: how much of a row's group has its value or a smaller one. Null values are left out."""
    placed = ranked(df.where(F.col(value).isNotNull()), group, [F.col(group).asc_nulls_last(), F.col(value).asc()], label)
    last = placed.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg((F.max("_rank") + 1).alias("_upto"))
    size = last.groupBy(F.col("_g").alias("_h")).agg(F.max("_upto").alias("_n"))
    out = placed.join(last, placed[group].eqNullSafe(F.col("_g")) & (placed[value] == F.col("_v"))).join(size, F.col("_g").eqNullSafe(F.col("_h")))
    return out.withColumn("share", F.col("_upto") / F.col("_n")).drop("_rank", "_g", "_v", "_upto", "_h", "_n")
