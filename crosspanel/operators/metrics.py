"""Daily rank correlations, deciles and their summaries for a prediction table (instrument, date, pred, label_raw)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EPS, first_rank

MIN_NAMES = 5


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; NULL for a constant side."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > EPS) & (sy > EPS), F.covar_pop(x, y) / (sx * sy))


def daily_ic(preds: DataFrame, keys: tuple[str, ...] = ("date",), label: str = "label_raw") -> DataFrame:
    """(keys, n, ic, rank_ic) for days of at least five names; ranks are ordinal, ties by instrument."""
    ranked = preds.where(F.col("pred").isNotNull() & F.col(label).isNotNull()).withColumns({"rp_": first_rank("pred", *keys), "rl_": first_rank(label, *keys)})
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("pred", label).alias("ic"), pearson("rp_", "rl_").alias("rank_ic")).where(F.col("n") >= MIN_NAMES)


def ic_summary(daily: DataFrame, keys: tuple[str, ...] = (), column: str = "rank_ic") -> DataFrame:
    """Days, mean, deviation, information ratio, t value and share of positive days; days without a value count not."""
    x = F.col(column)
    agg = daily.where(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("days"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg((x > 0).cast("double")).alias("positive"))
    return agg.withColumn("icir", F.try_divide("mean", "sd")).withColumn("t", F.col("icir") * F.sqrt("days"))


#: The cap of each market where none is asked for.
CAPS = {"us": 0.8, "cn": 0.0}


def market_of(name: str) -> str:
    """The market that a file's name tells: cn if it has _cn, else us."""
    return "cn" if "_cn" in name.rsplit("/", 1)[-1] else "us"


def apply_cap(preds: DataFrame, market: str = "us", cap: float | None = None) -> DataFrame:
    """Rows of at most ``cap`` absolute return (the market's where None); 0 or less keeps all."""
    most = CAPS[market] if cap is None else cap
    return preds.where(F.abs("label_raw") <= most) if most > 0 else preds


def decile_table(preds: DataFrame, n: int = 10) -> DataFrame:
    """(date, d0 ... d9): each day's mean return by decile; a decile without rows is NULL and keeps its column."""
    daily = with_decile(preds, n).groupBy("date").pivot("decile", list(range(n))).agg(F.avg("label_raw"))
    return daily.select("date", *(F.col(str(k)).alias(f"d{k}") for k in range(n)))


def with_decile(preds: DataFrame, n: int = 10, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """decile 0 (lowest) to n - 1: floor((ordinal rank - 1) * n / names)."""
    bucket = F.floor((first_rank("pred", *keys) - 1) * n / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return preds.withColumn("decile", F.least(bucket, F.lit(n - 1)).cast("long"))


def decile_returns(preds: DataFrame, n: int = 10) -> DataFrame:
    """(decile, days, bps): mean over days of each day's mean return."""
    daily = with_decile(preds, n).groupBy("date", "decile").agg(F.avg("label_raw").alias("r"))
    return daily.groupBy("decile").agg(F.count(F.lit(1)).alias("days"), (F.avg("r") * 1e4).alias("bps"))


def monotonicity(deciles: DataFrame) -> DataFrame:
    """Rank correlation of the decile's number and its mean return, and top minus bottom."""
    ranked = deciles.withColumn("all_", F.lit(0)).withColumn("rk", first_rank_of("bps"))
    return ranked.agg(pearson("decile", "rk").alias("spearman"), (F.max_by("bps", "decile") - F.min_by("bps", "decile")).alias("spread_bps"))


def first_rank_of(column: str) -> Column:
    """Ordinal rank over a table of a few rows (deciles)."""
    return F.row_number().over(Window.partitionBy("all_").orderBy(column, "decile"))


def period_breakdown(daily: DataFrame, least_days: int = 20) -> DataFrame:
    """Summaries of rank_ic by year and by quarter with at least ``least_days`` days, in one aggregation."""
    year = F.concat(F.lit("Y"), F.year("date").cast("string"))
    quarter = F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string"))
    each = daily.withColumn("period", F.explode(F.array(year, quarter)))
    return ic_summary(each, ("period",)).where(F.col("days") >= least_days)
