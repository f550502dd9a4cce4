"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (ids, flags) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files of a query go when it ends, as a written table no longer needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that names none, as in tests, gets a temporary one; on a cluster its executors could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or _own_dir()


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="contentgauge-")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Cuts the lineage at files that every executor can read, so the loss of an executor costs no earlier stage,
    and gives the planner the true size of what a Python function or explode made.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_ids(df: DataFrame, ids: DataFrame, on: list[str], how: str = "left_semi", n_rows: int | None = None) -> DataFrame:
    """Joins df with a narrow table: broadcast up to BROADCAST_ROWS counted rows, else a shuffle join."""
    n = ids.count() if n_rows is None else n_rows
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("shuffle_hash"), on, how)


#: A key with at least so small a part of all rows is hot; there are at most so many such keys.
HOT_KEYS = 500


def join_hot(rows: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Joins rows with side, which has one row for each key, and held, the number of rows with that key.

    The hot keys' rows of side, at most HOT_KEYS, are broadcast, so that no task gets all rows of a common key; the
    others meet in a shuffle join. side is read twice, so it should be a written table. held does not come along.
    """
    total = side.agg(F.sum("held")).first()[0] or 0
    hot = F.broadcast(side.filter(F.col("held") * HOT_KEYS >= total).drop("held"))
    rest = rows.join(hot.select(on), on, "left_anti").join(side.drop("held").hint("shuffle_hash"), on, how)
    return rows.join(hot, on).unionByName(rest)
