"""Cross-sectional normalisation by day."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import EPS, clip, divide, on_day, spread

MAD_SCALE = 1.4826


def robust_z(df: DataFrame, columns: dict[str, str], fill: float | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD + 1e-12), clipped to +-3, for each column -> new name.

    Both medians are aggregates over the whole of a day, so one shuffle by date serves all columns and the input is read
    once. A day is a cross-section; its rows are worked through once per median.
    """
    names = list(columns)
    df = df.withColumns({f"m_{i}": F.median(c).over(on_day()) for i, c in enumerate(names)})
    df = df.withColumns({f"d_{i}": F.median(F.abs(F.col(c) - F.col(f"m_{i}"))).over(on_day()) for i, c in enumerate(names)})
    z = {columns[c]: clip((F.col(c) - F.col(f"m_{i}")) / (MAD_SCALE * F.col(f"d_{i}") + EPS), -3.0, 3.0) for i, c in enumerate(names)}
    if fill is not None:
        z = {k: F.coalesce(v, F.lit(fill)) for k, v in z.items()}
    return df.withColumns(z).drop(*(f"{p}_{i}" for p in "md" for i in range(len(names))))


def robust_z_all(df: DataFrame, names: list[str], fill: float = 0.0) -> DataFrame:
    """``robust_z`` of many columns in place: one grouping by date, each day a block of numpy columns.

    A day's names are a cross-section, so a group does not grow with the history. Missing values become ``fill``.
    """

    def per(table: pa.Table) -> pa.Table:
        for n in names:
            x = table[n].to_numpy().astype(float)
            known = ~np.isnan(x)
            if known.any():
                off = x - np.median(x[known])
                x = np.clip(off / (MAD_SCALE * np.median(np.abs(off[known])) + EPS), -3.0, 3.0)
            table = table.set_column(table.schema.get_field_index(n), table.schema.field(n), pa.array(np.where(known, x, fill)))
        return table

    return spread(df, "date").groupBy("date").applyInArrow(per, df.schema)


def day_medians(df: DataFrame, column: str) -> DataFrame:
    """(date, m, d): the median of a column's known values by day and the median distance from it. A day's values are one
    group, and nothing else of the rows is shuffled."""

    def per(table: pa.Table) -> pa.Table:
        x = table[column].to_numpy()
        m = np.median(x)
        return pa.table({"date": table["date"].slice(0, 1), "m": pa.array([m]), "d": pa.array([np.median(np.abs(x - m))])})

    known = df.where(F.col(column).isNotNull()).select("date", F.col(column).cast("double").alias(column))
    return spread(known, "date").groupBy("date").applyInArrow(per, "date date, m double, d double")


def with_day_z(df: DataFrame, column: str, name: str, medians: DataFrame) -> DataFrame:
    """``df`` with the ``robust_z`` of a column from its ``day_medians`` (a row per day, sent to all tasks)."""
    z = clip((F.col(column) - F.col("m")) / (MAD_SCALE * F.col("d") + EPS), -3.0, 3.0)
    return df.join(F.broadcast(medians), "date", "left").withColumn(name, z).drop("m", "d")


def standard(df: DataFrame, column: str, name: str) -> DataFrame:
    """(x - mean) / population deviation of the day; 0 where all values are equal."""
    w = on_day()
    sd = F.stddev_pop(column).over(w)
    z = F.when(sd > EPS, divide(F.col(column) - F.avg(column).over(w), sd)).when(F.col(column).isNotNull(), 0.0)
    return df.withColumn(name, z)
