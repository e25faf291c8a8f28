"""A panel stored once: files by year, buckets by instrument, rows by date within.

A fold reads its years only, and windows, joins and groupings by instrument find the rows where they need them: no
exchange. A table is built once per session and input; the name holds the input's path, files and their times, so changed
input gives another table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shared_folder, shuffles_freed
from .files import exists


def store_panel(panel: DataFrame, table: str, buckets: int | None = None, path: str | None = None) -> None:
    """Write ``panel`` (instrument, date, ...) as the table ``table``: a file per year and bucket that has rows."""
    spark = panel.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = panel.withColumn("year", F.year("date")).repartition(n, "instrument")
    where = path or f"{shared_folder(spark)}/{table}-{uuid.uuid4().hex}"
    rows.write.format("parquet").mode("overwrite").option("path", where).partitionBy("year").bucketBy(n, "instrument").sortBy("instrument", "date").saveAsTable(table)


def load_years(spark: SparkSession, table: str, first: int | None = None, last: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of a stored panel from year ``first`` to ``last``; other years' files are not opened."""
    df = spark.table(table)
    if first is not None:
        df = df.where(F.col("year") >= first)
    if last is not None:
        df = df.where(F.col("year") <= last)
    return df.select(*columns) if columns is not None else df.drop("year")


def input_mark(spark: SparkSession, path: str) -> int:
    """A number that stands for the path, the names, sizes and times of its files; only their status is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.listStatus(where)
    files = sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in status)
    return zlib.crc32("\n".join([path, *files]).encode())


_built: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, source: str, name: str, build: Callable[[], DataFrame]) -> str:
    """The name of the table ``name`` made by ``build`` from ``source`` of ``sf_dir``: written on first use in a session, and
    again if its files are gone."""
    table = f"crosspanel_{name}_{input_mark(spark, f'{sf_dir}/{source}.parquet'):08x}"
    known = (spark.sparkContext.applicationId, table)
    if known not in _built or not exists(spark, _built[known]):
        path = f"{shared_folder(spark)}/{table}-{uuid.uuid4().hex}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        with shuffles_freed(spark):
            store_panel(build(), table, path=path)
        _built[known] = path
    return table


_made: dict[tuple[str, str], object] = {}


def made_once(spark: SparkSession, sf_dir: str, source: str, name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes of ``source`` of ``sf_dir`` and keeps in files of its own (its ``path``): once in a session, and again
    if they are gone."""
    known = (spark.sparkContext.applicationId, f"{name}_{input_mark(spark, f'{sf_dir}/{source}.parquet'):08x}")
    if known not in _made or not exists(spark, _made[known].path):
        _made[known] = build()
    return _made[known]


_small: dict[tuple[str, str], DataFrame] = {}


def small_of(spark: SparkSession, table: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` makes of the stored ``table``, a table of the calendar's size: collected once for each time the table is
    written."""
    path = _built[spark.sparkContext.applicationId, table]
    known = (path, build.__qualname__)
    if known not in _small:
        with shuffles_freed(spark):
            df = build(spark.table(table))
            _small[known] = spark.createDataFrame(df.collect(), df.schema)
    return _small[known]
