"""Portfolios of a prediction table without recursion: hysteresis by gaps and islands, turnover by overlaps.

Every function takes ``keys``: columns such as a variant or a permutation that are worked on side by side in one plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import divide, first_rank, spread

COSTS = (0, 5, 10, 20)
#: The grids that are searched: spans and exit bands of the long-short and of the long-only portfolios.
SPANS, EXITS = (1, 2, 3, 5, 10, 20), (0.1, 0.2, 0.3, 0.4)
LONG_SPANS, LONG_EXITS = (1, 3, 5, 10), (0.1, 0.2, 0.3)
DAYS = 252


def _smooth(x: np.ndarray, span: int, block: int = 128) -> np.ndarray:
    """y[0] = x[0], y[t] = a x[t] + (1 - a) y[t - 1], in blocks: each is one product with the recursion's powers."""
    if span <= 1 or not len(x):
        return x
    a = 2.0 / (span + 1)
    lag = np.arange(block)[:, None] - np.arange(block)
    weight = np.where(lag >= 0, a * (1 - a) ** np.maximum(lag, 0), 0.0)
    out, before = np.empty(len(x)), x[0]
    for at in range(0, len(x), block):
        n = min(block, len(x) - at)
        out[at : at + n] = weight[:n, :n] @ x[at : at + n] + before * (1 - a) ** np.arange(1, n + 1)
        before = out[at + n - 1]
    return out


def smoothed(preds: DataFrame, spans: tuple[int, ...], column: str = "pred") -> DataFrame:
    """``preds`` once per span, with the column span: exponential means of each instrument's stored rows (alpha =
    2 / (span + 1), first value as it is). One grouping by instrument serves all spans."""

    def per(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        x, at = table[column].to_numpy().astype(float), table.schema.get_field_index(column)
        each = [table.set_column(at, table.schema.field(at), pa.array(_smooth(x, s))).append_column("span", pa.array(np.full(len(x), s))) for s in spans]
        return pa.concat_tables(each)

    return spread(preds, "instrument").groupBy("instrument").applyInArrow(per, T.StructType([*preds.schema.fields, T.StructField("span", T.LongType())]))


def ema(preds: DataFrame, span: int, column: str = "pred") -> DataFrame:
    """The exponential mean of one span; see ``smoothed``."""
    return preds if span <= 1 else smoothed(preds, (span,), column).drop("span")


def dense_days(preds: DataFrame, least: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of days with at least ``least`` names, with day_idx dense over those days."""
    w = Window.partitionBy(*keys, "date")
    big = preds.withColumn("names", F.count(F.lit(1)).over(w)).where(F.col("names") >= least)
    # one row per key and day is ranked, not the panel
    days = big.select(*keys, "date").distinct()
    order = Window.partitionBy(*keys, F.lit(0)).orderBy("date")
    return big.join(days.withColumn("day_idx", F.row_number().over(order).cast("long")), [*keys, "date"])


def hysteresis(ranked: DataFrame, enter: float = 0.1, leave: float | str = 0.2, keys: tuple[str, ...] = (), sides: tuple[str, ...] = ("long", "short")) -> DataFrame:
    """Held rows (keys, date, day_idx, instrument, side, label_raw): entered in the best ``enter`` share, kept while in
    the best ``leave`` share on consecutive days. ``leave`` may name a column."""
    pct = first_rank("pred", *keys, "date") / F.col("names")
    df = ranked.withColumn("pct", pct)
    q = F.col(leave) if isinstance(leave, str) else F.lit(leave)
    parts = F.array(*(F.struct(F.lit(s).alias("side"), (F.col("pct") if s == "long" else 1 - F.col("pct")).alias("x")) for s in sides))
    df = df.withColumn("s_", F.explode(parts)).select("*", "s_.side", "s_.x").where(F.col("x") >= 1 - q)
    own = Window.partitionBy(*keys, "side", "instrument").orderBy("day_idx")
    df = df.withColumn("island", F.col("day_idx") - F.row_number().over(own))
    run = Window.partitionBy(*keys, "side", "instrument", "island").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("held", F.max(F.col("x") >= 1 - enter).over(run)).where("held").select(*keys, "date", "day_idx", "instrument", "side", "label_raw")


def legs(held: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, day_idx, date, side, n, r, moved): size, mean return and sum of weight changes (NULL on the first day)."""
    own = Window.partitionBy(*keys, "side", "instrument").orderBy("day_idx")
    stayed = held.withColumn("stayed", (F.lag("day_idx").over(own) == F.col("day_idx") - 1).cast("long"))
    day = stayed.groupBy(*keys, "side", "day_idx", "date").agg(F.count(F.lit(1)).alias("n"), F.avg("label_raw").alias("r"), F.sum(F.coalesce("stayed", F.lit(0))).alias("m"))
    before = Window.partitionBy(*keys, "side").orderBy("day_idx")
    old = F.lag("n").over(before)
    moved = F.col("m") * F.abs(1 / F.col("n") - 1 / old) + (F.col("n") - F.col("m")) / F.col("n") + (old - F.col("m")) / old
    return day.withColumn("moved", moved)


def long_short(held: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, day_idx, gross, turnover) for days with both legs; turnover is half of all weight changes."""
    side = legs(held, keys).groupBy(*keys, "date", "day_idx").pivot("side", ["long", "short"]).agg(F.first("r").alias("r"), F.first("moved").alias("moved"))
    return side.where("long_r IS NOT NULL AND short_r IS NOT NULL").select(*keys, "date", "day_idx", (F.col("long_r") - F.col("short_r")).alias("gross"), ((F.col("long_moved") + F.col("short_moved")) / 2).alias("turnover"))


def long_only(ranked: DataFrame, held: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, day_idx, gross, turnover): long leg against the equal-weighted universe."""
    universe = ranked.groupBy(*keys, "date").agg(F.avg("label_raw").alias("u"))
    one = legs(held.where("side = 'long'"), keys).join(universe, [*keys, "date"])
    return one.select(*keys, "date", "day_idx", (F.col("r") - F.col("u")).alias("gross"), (F.col("moved") / 2).alias("turnover"))


def cost_curve(series: DataFrame, keys: tuple[str, ...] = (), costs: tuple[int, ...] = COSTS) -> DataFrame:
    """Per cost in bps: days, gross and net mean in bps, mean turnover without the first day, yearly information ratio."""
    each = series.withColumn("cost", F.explode(F.array(*(F.lit(c).cast("long") for c in costs))))
    net = F.col("gross") * 1e4 - F.col("cost") * F.coalesce("turnover", F.lit(0.0))
    out = each.withColumn("net", net).groupBy(*keys, "cost").agg(F.count(F.lit(1)).alias("days"), (F.avg("gross") * 1e4).alias("gross_bps"), F.avg("turnover").alias("turnover"), F.avg("net").alias("net_bps"), F.stddev_samp("net").alias("sd"))
    return out.withColumn("ir", divide(F.col("net_bps"), F.when(F.col("sd") > 0, F.col("sd"))) * (DAYS**0.5)).drop("sd")


def deciles_held(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The top and bottom decile of each day as held rows."""
    from .metrics import with_decile

    df = with_decile(ranked, n).where(F.col("decile").isin(0, n - 1))
    return df.select("date", "day_idx", "instrument", F.when(F.col("decile") == n - 1, "long").otherwise("short").alias("side"), "label_raw")


def variants(preds: DataFrame, spans: tuple[int, ...] = SPANS, exits: tuple[float, ...] = EXITS) -> DataFrame:
    """Ranked rows of every smoothing and exit band side by side; all spans have the same days and names."""
    ranked = dense_days(smoothed(preds, spans), keys=("span",))
    return ranked.withColumn("q_exit", F.explode(F.array(*(F.lit(q) for q in exits))))


def with_equal_days(curve: DataFrame) -> DataFrame:
    """``curve`` of all variants; variants with different numbers of days cannot be compared and are an error."""
    days = curve.agg(F.min("days").alias("least_"), F.max("days").alias("most_"))
    bad = F.raise_error(F.concat_ws(" ", F.lit("variants differ in days:"), F.col("least_").cast("string"), F.col("most_").cast("string"))).cast("long")
    checked = F.when(F.col("least_") == F.col("most_"), F.col("days")).otherwise(bad)
    return curve.crossJoin(F.broadcast(days)).withColumn("days", checked).drop("least_", "most_")  # one row on the right
