"""A model over the out-of-fold predictions of two others: its folds, and the proof that no label reaches across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with day: the dense number of its date among the dates of ``rows``."""
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    days = rows.select("date").distinct().withColumn("day", F.row_number().over(one).cast("long"))  # one row per day
    return rows.join(F.broadcast(days), "date")


def folds(dates: DataFrame, purge: int = 5, share: float = 0.8) -> DataFrame:
    """(test_year, fit_end, val_start, val_end, test_start, test_end) in dense day numbers, for every year but the first.

    The year before the test year validates and what lies before it is fitted on; where that is nothing, the year before
    is cut at ``share`` of its days. The last ``purge`` days of both are left out.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    day = dates.select("date").distinct().withColumn("d", F.row_number().over(one).cast("long"))  # one row per day
    years = day.groupBy(F.year("date").cast("long").alias("test_year")).agg(F.min("d").alias("test_start"), F.max("d").alias("test_end"))
    before = Window.partitionBy(F.lit(0)).orderBy("test_year")  # one row per year
    f = years.withColumns({"first_": F.lag("test_start").over(before), "last_": F.lag("test_end").over(before)}).where("last_ IS NOT NULL")
    f = f.withColumn("cut_", F.when(F.col("first_") > 1, F.col("first_") - 1).otherwise(F.floor(F.col("last_") * share)))
    return f.select("test_year", (F.col("cut_") - purge).alias("fit_end"), (F.col("cut_") + 1).alias("val_start"), (F.col("last_") - purge).alias("val_end"), "test_start", "test_end")


def label_reach(days: DataFrame, rows: int) -> DataFrame:
    """(day, reach): the last day whose price the label of ``day`` (date, day) uses, ``rows`` days on."""
    return days.select("day", (F.col("day") + rows).alias("reach"))


def check_purge(reach: DataFrame, fold_rows: list) -> None:
    """An error that names the fold if the label of a fit day reaches into its validation or test days, or that of a
    validation day into its test days. Days and folds meet in a join, the answer is one row per fold at most."""
    spark = reach.sparkSession
    parts = [(int(f["test_year"]), p, int(a), int(b), int(c)) for f in fold_rows for p, a, b, c in (("fit", 1, f["fit_end"], f["val_start"]), ("validation", f["val_start"], f["val_end"], f["test_start"]))]
    if not parts:
        return
    bounds = spark.createDataFrame(parts, "test_year long, part string, first long, last long, next long")
    bad = reach.join(F.broadcast(bounds), F.col("day").between(F.col("first"), F.col("last"))).where("reach >= next")  # two rows per fold
    found = bad.groupBy("test_year", "part").agg(F.min("day").alias("day")).orderBy("test_year", "part").first()
    if found is not None:
        raise ValueError(f"fold {found['test_year']}: the label of {found['part']} day {found['day']} reaches into the next part")
