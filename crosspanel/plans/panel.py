"""Queries over bars and features, and the common tables of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import WINDOWS, day, r6
from ..operators import features as feat

BARS_SQL = """
bars AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS instrument, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume, sum(px * l_quantity) AS amount
  FROM (SELECT *, (92.5 + 15.0 * l_extendedprice / 105000.0) * CASE WHEN l_suppkey = 7 AND l_shipdate >= TIMESTAMP '1998-06-01' THEN 100.0 ELSE 1.0 END AS px,
      row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem)
  GROUP BY ALL),
adj AS (
  SELECT *, (high + low + close) / 3 AS vwap FROM (
    SELECT instrument, date, open * f AS open, high * f AS high, low * f AS low, close * f AS close, close AS raw_close, volume, amount, f AS factor
    FROM (SELECT *, 1 + 0.01 * (year(date) - 1995) AS f FROM bars)))"""
PREP_SQL = """
prep0 AS (
  SELECT *, close - lag(close) OVER i AS dc, volume - lag(volume) OVER i AS dv, close / nullif(lag(close) OVER i, 0) AS ret, volume / nullif(lag(volume) OVER i, 0) AS vr,
    CAST(row_number() OVER i AS DOUBLE) AS rn FROM adj WINDOW i AS (PARTITION BY instrument ORDER BY date)),
prep AS (
  SELECT *, CASE WHEN dc > 0 THEN dc WHEN dc IS NOT NULL THEN 0 END AS up, CASE WHEN dc < 0 THEN -dc WHEN dc IS NOT NULL THEN 0 END AS dn,
    CASE WHEN dv > 0 THEN dv WHEN dv IS NOT NULL THEN 0 END AS vup, CASE WHEN dv < 0 THEN -dv WHEN dv IS NOT NULL THEN 0 END AS vdn,
    ln(volume + 1) AS lv, ln(vr + 1) AS lvr, abs(ret - 1) * volume AS wv FROM prep0)"""


def rolling_sql(name: str, d: int) -> str:
    w = f"OVER w{d}"

    def whole(e: str, x: str) -> str:
        return f"(CASE WHEN count({x}) {w} = {d} THEN {e} END)"

    def corr(x: str, y: str) -> str:
        return f"(CASE WHEN count({x} + {y}) {w} = {d} AND stddev_pop({x}) {w} > 1e-9 AND stddev_pop({y}) {w} > 1e-9 THEN covar_pop({x}, {y}) {w} / (stddev_pop({x}) {w} * stddev_pop({y}) {w}) END)"

    def place(x: str, pick: str) -> str:
        return whole(f"(list_position(list({x}) {w}, {pick}({x}) {w}) - 1)", x)

    def cnt(test: str) -> str:
        return f"(CASE WHEN count(*) {w} = {d} THEN avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) {w} END)"

    up, dn, vup, vdn = (whole(f"sum({x}) {w}", x) for x in ("up", "dn", "vup", "vdn"))
    return {
        "ROC": f"lag(close, {d}) OVER i / close",
        "MA": f"{whole(f'avg(close) {w}', 'close')} / close",
        "STD": f"{whole(f'stddev_samp(close) {w}', 'close')} / close",
        "BETA": f"{whole(f'regr_slope(close, rn) {w}', 'close')} / close",
        "RSQR": whole(f"CASE WHEN var_pop(close) {w} <= 1e-12 THEN 0 ELSE regr_r2(close, rn) {w} END", "close"),
        "RESI": f"{whole(f'close - (regr_intercept(close, rn) {w} + regr_slope(close, rn) {w} * rn)', 'close')} / close",
        "MAX": f"{whole(f'max(high) {w}', 'high')} / close",
        "MIN": f"{whole(f'min(low) {w}', 'low')} / close",
        "QTLU": f"{whole(f'quantile_cont(close, 0.8) {w}', 'close')} / close",
        "QTLD": f"{whole(f'quantile_cont(close, 0.2) {w}', 'close')} / close",
        "RANK": whole(f"list_sum(list_transform(list(close) {w}, lambda x: CASE WHEN x < close THEN 1.0 WHEN x = close THEN 0.5 ELSE 0.0 END))", "close") + f" / {d} + 0.5 / {d}",
        "RSV": f"(close - {whole(f'min(low) {w}', 'low')}) / ({whole(f'max(high) {w}', 'high')} - {whole(f'min(low) {w}', 'low')} + 1e-12)",
        "IMAX": f"{place('high', 'max')} / {d}.0",
        "IMIN": f"{place('low', 'min')} / {d}.0",
        "IMXD": f"({place('high', 'max')} - {place('low', 'min')}) / {d}.0",
        "CORR": corr("close", "lv"),
        "CORD": corr("ret", "lvr"),
        "CNTP": cnt("dc > 0"),
        "CNTN": cnt("dc < 0"),
        "CNTD": f"{cnt('dc > 0')} - {cnt('dc < 0')}",
        "SUMP": f"{up} / ({up} + {dn} + 1e-12)",
        "SUMN": f"{dn} / ({up} + {dn} + 1e-12)",
        "SUMD": f"({up} - {dn}) / ({up} + {dn} + 1e-12)",
        "VMA": f"{whole(f'avg(volume) {w}', 'volume')} / (volume + 1e-12)",
        "VSTD": f"{whole(f'stddev_samp(volume) {w}', 'volume')} / (volume + 1e-12)",
        "WVMA": f"{whole(f'stddev_samp(wv) {w}', 'wv')} / ({whole(f'avg(wv) {w}', 'wv')} + 1e-12)",
        "VSUMP": f"{vup} / ({vup} + {vdn} + 1e-12)",
        "VSUMN": f"{vdn} / ({vup} + {vdn} + 1e-12)",
        "VSUMD": f"({vup} - {vdn}) / ({vup} + {vdn} + 1e-12)",
    }[name]


BAR_SQL = {
    "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / (high - low + 1e-12)",
    "KUP": "(high - greatest(open, close)) / open", "KUP2": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / (high - low + 1e-12)",
    "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
    "OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close", "VWAP0": "vwap / close",
}
FRAMES = "WINDOW i AS (PARTITION BY instrument ORDER BY date), " + ", ".join(f"w{d} AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)" for d in WINDOWS)
R6 = "round({}, 6) + 0.0"


def features_sql(names: list[str]) -> str:
    def one(n: str) -> str:
        return BAR_SQL[n] if n in BAR_SQL else next(rolling_sql(n[: -len(str(d))], d) for d in WINDOWS if n.endswith(str(d)) and n[: -len(str(d))] in feat.ROLLING)

    columns = ", ".join(f"{R6.format(one(n))} AS {n}" for n in names)
    return f"WITH {BARS_SQL}, {PREP_SQL} SELECT instrument, CAST(date AS VARCHAR) AS date, {columns} FROM prep {FRAMES}"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.adjusted(sources.weekly_bars(spark, sf_dir))


def _feature_query(names: list[str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = feat.features(panel(spark, sf_dir), names)
        return df.select("instrument", day().alias("date"), *(r6(F.col(n)).alias(n) for n in names))

    return query


def _each(*names: str) -> list[str]:
    return [f"{n}{d}" for d in WINDOWS for n in names]


GROUPS = {
    "kbar": feat.BAR,
    "price_ratio": feat.RATIO,
    "roc": _each("ROC"),
    "ma_std": _each("MA", "STD"),
    "beta_rsqr_resi": _each("BETA", "RSQR", "RESI"),
    "minmax_rsv": _each("MAX", "MIN", "RSV"),
    "quantile_roll": _each("QTLU", "QTLD"),
    "rank_roll": _each("RANK"),
    "argminmax": _each("IMAX", "IMIN", "IMXD"),
    "corr_cord": _each("CORR", "CORD"),
    "cnt": _each("CNTP", "CNTN", "CNTD"),
    "sum_updown": _each("SUMP", "SUMN", "SUMD"),
    "volume_roll": _each("VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD"),
    "features_158": feat.FEATURES,
}
PRICES = ["open", "high", "low", "close", "volume", "amount"]


def bars_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.weekly_bars(spark, sf_dir).select("instrument", day().alias("date"), *(r6(F.col(c)).alias(c) for c in PRICES))


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.daily_bars(spark, sf_dir).select("instrument", day().alias("date"), *(r6(F.col(c)).alias(c) for c in PRICES))


def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("instrument", day().alias("date"), *(r6(F.col(c), 9).alias(c) for c in [*PRICES[:5], "vwap", "raw_close", "factor"]))


_rounded = lambda cs: ", ".join(f"{R6.format(c)} AS {c}" for c in cs)
QUERIES = {"bars_w": bars_w, "bars_d": bars_d, "adjusted_bars": adjusted_bars} | {k: _feature_query(v) for k, v in GROUPS.items()}
ORACLE_SQL = {
    "bars_w": f"WITH {BARS_SQL} SELECT instrument, CAST(date AS VARCHAR) AS date, {_rounded(PRICES)} FROM bars",
    "bars_d": f"""WITH b AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS instrument, CAST(ts AS DATE) AS date, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
      min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount FROM events GROUP BY ALL)
      SELECT instrument, CAST(date AS VARCHAR) AS date, {_rounded(PRICES)} FROM b""",
    "adjusted_bars": f"WITH {BARS_SQL} SELECT instrument, CAST(date AS VARCHAR) AS date, {", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in [*PRICES[:5], "vwap", "raw_close", "factor"])} FROM adj",
} | {k: features_sql(v) for k, v in GROUPS.items()}
