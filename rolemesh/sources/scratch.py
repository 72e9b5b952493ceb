"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is set only where that is unset and the master is local."""
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rolemesh-")
        spark.conf.set(key, found)
    return found


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written once: what is used several times is worked out once, and a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rolemesh/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """df with `place`: its number from 1 among the rows of equal `by`, in the given order, which should tell them apart.

    Rows are sorted by ranges and numbered where they lie, so that no task orders all rows of a group; a row for each range and group meets to add up what goes before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(df.repartitionByRange(n, by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return rows.join(bases, F.col(by).eqNullSafe(F.col("_by")) & (part == F.col("_part"))).withColumn("place", F.col("_base") + F.col("_at") - F.col("_first") + 1).drop("_at", "_by", "_part", "_n", "_first", "_base")
