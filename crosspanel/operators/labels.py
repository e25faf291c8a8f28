"""Tradability flags and forward-return labels: price x gate x horizon, always on the complete row grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import divide, over_time, unique_by
from .normalize import robust_z

CAP = 0.8


def with_flags(bars: DataFrame) -> DataFrame:
    """can_buy and can_sell from the raw close's change against the board's limit; a missing change is neither."""
    i = F.col("instrument").cast("long")
    limit = F.when(i % 10 == 3, 4.8).when(i % 3 == 0, 19.8).otherwise(9.8)
    change = 100 * (divide(F.col("raw_close"), F.lag("raw_close").over(over_time())) - 1)
    df = bars.withColumn("pct_change", change).withColumn("limit", limit)
    return df.withColumn("can_buy", F.coalesce(F.col("pct_change") < F.col("limit"), F.lit(False))).withColumn("can_sell", F.coalesce(F.col("pct_change") > -F.col("limit"), F.lit(False)))


#: Boards by the first characters of a code, their daily limits in per cent, and the day from which the growth board has
#: the wider one (fixed values).
BOARDS = {"star": ("688", "689"), "growth": ("300", "301")}
LIMITS = {"special": 4.8, "wide": 19.8, "main": 9.8}
GROWTH_FROM = "2020-08-24"


def board_of(code: Column) -> Column:
    head = F.substring(code, 1, 3)
    return F.when(head.isin(*BOARDS["star"]), "star").when(head.isin(*BOARDS["growth"]), "growth").otherwise("main")


def limit_of(board: Column, date: Column, special: Column, growth_from: str = GROWTH_FROM) -> Column:
    """The limit of a row: special treatment first, then the board, the growth board from ``growth_from`` on."""
    wide = (board == "star") | ((board == "growth") & (date >= F.lit(growth_from).cast("date")))
    return F.when(F.coalesce(special, F.lit(False)), LIMITS["special"]).when(wide, LIMITS["wide"]).otherwise(LIMITS["main"])


def tradable(change: Column, limit: Column) -> tuple[Column, Column]:
    """(can_buy, can_sell); a missing change is neither."""
    return F.coalesce(change < limit, F.lit(False)), F.coalesce(change > -limit, F.lit(False))


def with_external_label(panel: DataFrame, external: DataFrame, columns: tuple[str, ...] = ("label", "label_raw")) -> DataFrame:
    """``panel`` with its labels replaced by those of ``external`` (instrument, date, columns), rows without one gone.

    The old labels go first and the filter comes last: rows that only the other label has must not be lost.
    """
    new = unique_by(external.select("instrument", "date", *columns), "instrument", "date")
    return panel.drop(*columns).join(new, ["instrument", "date"], "left").where(F.col(columns[-1]).isNotNull())


def with_joined_flags(panel: DataFrame, flags: DataFrame) -> DataFrame:
    """``panel`` with can_buy and can_sell of ``flags`` (one row per instrument and date); rows without one can neither."""
    own = unique_by(flags.select("instrument", "date", "can_buy", "can_sell"), "instrument", "date")
    out = panel.drop("can_buy", "can_sell").join(own, ["instrument", "date"], "left")
    return out.fillna(False, subset=["can_buy", "can_sell"])


def coverage(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(n, covered): rows of ``left``, and the share of them that ``right`` has ``column`` for."""
    have = left.select("instrument", "date").join(right.select("instrument", "date", F.col(column).alias("x_")), ["instrument", "date"], "left")
    return have.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x_").isNotNull().cast("double")).alias("covered"))


def price(kind: str) -> Column:
    """close, hlc3 (adjusted) or vwap (amount per volume, adjusted)."""
    return {"close": F.col("close"), "hlc3": F.col("vwap"), "vwap": divide(F.col("amount"), F.col("volume")) * F.col("factor")}[kind]


def ahead(flag: str, k: int) -> Column:
    return F.coalesce(F.lead(flag, k).over(over_time()), F.lit(False))


def gate(kind: str) -> Column:
    """full: bought at t+1 and sold at t+2; entry: bought at t+1; none."""
    return {"full": ahead("can_buy", 1) & ahead("can_sell", 2), "entry": ahead("can_buy", 1), "none": F.lit(True)}[kind]


def raw_labels(flagged: DataFrame, kind: str = "vwap", gated: str = "entry", horizon: int = 1, cap: float = CAP) -> DataFrame:
    """The panel with label_raw, p(t + 1 + horizon) / p(t + 1) - 1 on stored rows; NULL where gated or capped."""
    w = over_time()
    df = flagged.withColumn("p_", price(kind))
    rtn = divide(F.lead("p_", 1 + horizon).over(w), F.lead("p_", 1).over(w)) - 1
    df = df.withColumn("rtn_", rtn).withColumn("ok_", gate(gated))
    raw = F.when(F.col("ok_") & (F.abs("rtn_") <= cap), F.col("rtn_")) if cap > 0 else F.when(F.col("ok_"), F.col("rtn_"))
    return df.withColumn("label_raw", raw).drop("p_", "rtn_", "ok_")


def labels(flagged: DataFrame, kind: str = "vwap", gated: str = "entry", horizon: int = 1, cap: float = CAP) -> DataFrame:
    """The panel with label_raw of ``raw_labels`` and label, its robust z of the day.

    Gated or capped returns are NULL and take no part in the day's medians.
    """
    return robust_z(raw_labels(flagged, kind, gated, horizon, cap), {"label_raw": "label"})


def diagnostics(flagged: DataFrame) -> DataFrame:
    """lim_up_t1, lim_dn_t2, lim_up_t2 and oneword_t1 (high equals low) of the coming rows."""
    w = over_time()
    return flagged.withColumns(
        {
            "lim_up_t1": ~ahead("can_buy", 1),
            "lim_dn_t2": ~ahead("can_sell", 2),
            "lim_up_t2": ~ahead("can_buy", 2),
            "oneword_t1": F.coalesce(F.lead(F.col("high") == F.col("low"), 1).over(w), F.lit(False)),
        }
    )


def segments(df: DataFrame, valid_from: str, test_from: str) -> DataFrame:
    return df.withColumn("segment", F.when(F.col("date") < F.lit(valid_from).cast("date"), "train").when(F.col("date") < F.lit(test_from).cast("date"), "valid").otherwise("test"))


def verify(left: DataFrame, right: DataFrame, column: str = "label_raw") -> DataFrame:
    """One row: rows on either side, rows whose missingness differs, largest absolute difference."""
    both = left.select("instrument", "date", F.col(column).alias("a"), F.lit(1).alias("l")).join(right.select("instrument", "date", F.col(column).alias("b"), F.lit(1).alias("r")), ["instrument", "date"], "full")
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("n_missing_differs"), F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("max_difference"))
