"""Intermediate tables that several parts of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that are broadcast at most; more are joined as Spark sees fit.
SMALL = 10_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows at most, broadcast if these are few."""
    return F.broadcast(df) if rows <= SMALL else df


#: Rows that a task is dealt where it sorts or collects them all.
TASK_ROWS = 250_000


def deal(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by ``key`` over so many tasks that each gets about ``rows``, however few shuffle partitions are set.

    Joins and groups by ``key`` keep the deal. ``df`` is counted, so it should be cheap to read.
    """
    return df.repartition(_tasks(df, rows), key)


def _tasks(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def deal_join(df: DataFrame, other: DataFrame, key: str, by: str, rows: int = TASK_ROWS) -> DataFrame:
    """The inner join by ``key``, ``df`` dealt as in :func:`deal`, for an ``other`` of few rows per key.

    A key with more than ``rows`` rows of ``df`` is dealt over several tasks by the hash of ``by``, a column that tells
    its rows apart, and its rows of ``other`` go to each of them. ``df`` is read twice before.
    """
    hot = cut(df.groupBy(key).agg(F.ceil(F.count("*") / rows).alias("_parts")).where("_parts > 1"))
    hot, parts = small(hot, hot.count()), F.coalesce("_parts", F.lit(1))
    left = df.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    right = other.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.repartition(_tasks(df, rows), key, "_part").hint("merge").join(right, [key, "_part"]).drop("_part")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the folder in ``spark.checkpoint.dir``, which all executors share.

    Only where none is set and the master is local (tests) is a local folder made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
