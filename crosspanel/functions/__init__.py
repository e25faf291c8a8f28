"""Column expressions shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPS = 1e-12
WINDOWS = (5, 10, 20, 30, 60)


def over_time(d: int | None = None):
    """Rows of one instrument by date; with ``d`` the last d rows up to the current one."""
    w = Window.partitionBy("instrument").orderBy("date")
    return w.rowsBetween(-(d - 1), 0) if d else w


def on_day(*order: Column | str):
    """Rows of one date, ordered if asked."""
    w = Window.partitionBy("date")
    return w.orderBy(*order) if order else w


def divide(a: Column, b: Column) -> Column:
    """a / b, NULL for b = 0."""
    return F.try_divide(a, b)


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL (greatest and least would skip it)."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def r6(x: Column, digits: int = 6) -> Column:
    """Six digits, without a negative zero: what results are compared by."""
    return F.round(x, digits) + F.lit(0.0)


def day(x: Column | str = "date") -> Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


def first_rank(score: str, *within: str, descending: bool = False) -> Column:
    """Ordinal rank from 1; ties by instrument."""
    by = F.col(score).desc() if descending else F.col(score)
    return F.row_number().over(Window.partitionBy(*within).orderBy(by, "instrument"))


def average_rank(score: str, *within: str) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*within).orderBy(score)) + (F.count(F.lit(1)).over(Window.partitionBy(*within, score)) - 1) / 2


def finished(small: DataFrame, *kept: DataFrame) -> DataFrame:
    """``small`` (a summary of a few rows) worked out now, so that what was persisted for it is released."""
    rows, schema = small.collect(), small.schema
    for df in kept:
        df.unpersist()
    return small.sparkSession.createDataFrame(rows, schema)


def unique_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with at most one row per ``keys``: a repeated key is an error when the rows are read."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), *(F.first(c).alias(c) for c in rest))
    checked = F.when(F.col("n_") > 1, F.raise_error(F.concat_ws(" ", F.lit("repeated key"), *(F.col(k).cast("string") for k in keys))).cast("long")).otherwise(F.col("n_"))
    return one.withColumn("n_", checked).where("n_ = 1").select(*df.columns)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to all shuffle partitions: groups are work for processors, so their partitions are not to be
    coalesced by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What an action shuffles in here is deleted when the action is over, not when the driver happens to collect its garbage:
    for plans that run once and write what they make."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set and all runs in one process one is made; on a cluster a folder of
    one machine would not do, so that is an error."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="crosspanel-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")
