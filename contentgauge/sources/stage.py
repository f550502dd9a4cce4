"""Tables written between two steps: in the folder that the session names for checkpoints, which driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder in spark.checkpoint.dir; a temporary one only where a local session names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="contentgauge-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    """The path and its store, whichever Spark can write to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df as a table of files, so that what is not the same on a retry (partition numbers) is fixed; the files go when the application ends."""
    path = shared_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    at, store = _store(df.sparkSession, path)
    store.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a file or folder."""
    at, store = _store(spark, path)
    store.delete(at, True)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """df with the place of each row among those of its key, from 1 up; no key is sorted in one task.

    Ranges of key and order are numbered on their own, and counts of the ranges before (a row for each key and range)
    are added. Rows that order leaves equal are numbered in any order.
    """
    ranged = written(df.withColumn("_order", F.struct(*order)).repartitionByRange(*keys, "_order").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_in"), before.alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_order")))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_range") == F.col("_in")]
    joined = own.join(offsets.hint("shuffle_hash"), same)
    return joined.withColumn(name, F.col("_before") + F.col("_own")).drop("_order", "_range", "_own", "_in", "_before", *[f"_key_{k}" for k in keys])
