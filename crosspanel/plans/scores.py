"""Queries over labels, predictions, metrics and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day, r6
from ..operators import features as feat
from ..operators import labels as lab
from ..operators import metrics, normalize, portfolio
from ..sources.store import load_years, small_of, stored
from .panel import BARS_SQL, PREP_SQL, R6, panel

FLAGS_SQL = """
flags AS (
  SELECT *, coalesce(pct < lim, false) AS can_buy, coalesce(pct > -lim, false) AS can_sell FROM (
    SELECT *, 100 * (raw_close / lag(raw_close) OVER (PARTITION BY instrument ORDER BY date) - 1) AS pct,
      CASE WHEN CAST(instrument AS BIGINT) % 10 = 3 THEN 4.8 WHEN CAST(instrument AS BIGINT) % 3 = 0 THEN 19.8 ELSE 9.8 END AS lim FROM adj))"""
PRICE_SQL = {"close": "close", "hlc3": "vwap", "vwap": "amount / volume * factor"}
GATE_SQL = {"full": "coalesce(lead(can_buy, 1) OVER i, false) AND coalesce(lead(can_sell, 2) OVER i, false)", "entry": "coalesce(lead(can_buy, 1) OVER i, false)", "none": "true"}


def labels_sql(kind: str, gated: str, horizon: int = 1) -> str:
    return f"""
rtn AS (SELECT *, lead({PRICE_SQL[kind]}, {1 + horizon}) OVER i / lead({PRICE_SQL[kind]}, 1) OVER i - 1 AS r, {GATE_SQL[gated]} AS ok FROM flags WINDOW i AS (PARTITION BY instrument ORDER BY date)),
raw AS (SELECT *, CASE WHEN ok AND abs(r) <= 0.8 THEN r END AS label_raw FROM rtn),
lab AS (SELECT *, CASE WHEN label_raw IS NOT NULL THEN greatest(-3.0, least(3.0, (label_raw - m) / (1.4826 * mad + 1e-12))) END AS label
  FROM (SELECT *, median(abs(label_raw - m)) OVER (PARTITION BY date) AS mad FROM (SELECT *, median(label_raw) OVER (PARTITION BY date) AS m FROM raw)))"""


def preds_sql(member: str = "ROC5", name: str = "preds") -> str:
    from .panel import FRAMES, rolling_sql

    d = next(d for d in (5, 10, 20, 30, 60) if member.endswith(str(d)) and member[: -len(str(d))] in feat.ROLLING)
    return f"""
{name}_f AS (SELECT instrument, date, {rolling_sql(member[: -len(str(d))], d)} AS pred FROM prep {FRAMES}),
{name} AS (SELECT f.instrument, f.date, f.pred, l.label_raw, l.label, CAST(year(f.date) AS BIGINT) AS test_year
  FROM {name}_f f JOIN lab l ON f.instrument = l.instrument AND f.date = l.date WHERE f.pred IS NOT NULL AND l.label_raw IS NOT NULL)"""


BASE_SQL = f"WITH RECURSIVE {BARS_SQL}, {PREP_SQL}, {FLAGS_SQL}, {labels_sql('vwap', 'entry')}"
IC_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred, instrument) AS rp, row_number() OVER (PARTITION BY date ORDER BY label_raw, instrument) AS rl FROM preds),
daily AS (SELECT date, count(*) AS n,
    CASE WHEN stddev_pop(pred) > 1e-12 AND stddev_pop(label_raw) > 1e-12 THEN covar_pop(pred, label_raw) / (stddev_pop(pred) * stddev_pop(label_raw)) END AS ic,
    CASE WHEN stddev_pop(rp) > 1e-12 AND stddev_pop(rl) > 1e-12 THEN covar_pop(rp, rl) / (stddev_pop(rp) * stddev_pop(rl)) END AS rank_ic
  FROM ranked GROUP BY date HAVING count(*) >= 5)"""
PREDS_SQL = f"{BASE_SQL}, {preds_sql()}"
DECILE_SQL = "dec AS (SELECT *, least(9, CAST(floor((rn - 1) * 10.0 / n) AS BIGINT)) AS decile FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred, instrument) AS rn, count(*) OVER (PARTITION BY date) AS n FROM preds))"
DENSE_SQL = "dense AS (SELECT *, CAST(dense_rank() OVER (ORDER BY date) AS BIGINT) AS day_idx FROM (SELECT *, count(*) OVER (PARTITION BY date) AS names FROM {0}) WHERE names >= 10)"
#: Held rows -> legs -> long-short series; the keys lead every partition.
LEGS_SQL = """
stay AS (SELECT *, CASE WHEN lag(day_idx) OVER (PARTITION BY {k} side, instrument ORDER BY day_idx) = day_idx - 1 THEN 1 ELSE 0 END AS st FROM held),
leg0 AS (SELECT {k} side, day_idx, date, count(*) AS n, avg(label_raw) AS r, sum(st) AS m FROM stay GROUP BY ALL),
leg1 AS (SELECT *, lag(n) OVER (PARTITION BY {k} side ORDER BY day_idx) AS o FROM leg0),
leg AS (SELECT *, m * abs(1.0 / n - 1.0 / o) + (n - m) / CAST(n AS DOUBLE) + (o - m) / CAST(o AS DOUBLE) AS moved FROM leg1)"""
SERIES_SQL = {
    "ls": "series AS (SELECT {k} a.date, a.day_idx, a.r - b.r AS gross, (a.moved + b.moved) / 2 AS turnover FROM leg a JOIN leg b USING ({k} date, day_idx) WHERE a.side = 'long' AND b.side = 'short')",
    "lo": "uni AS (SELECT {k} date, avg(label_raw) AS u FROM {src} GROUP BY ALL), series AS (SELECT {k} date, day_idx, r - u AS gross, moved / 2 AS turnover FROM leg JOIN uni USING ({k} date) WHERE side = 'long')",
}
CURVE_SQL = """
curve AS (SELECT {k} cost, count(*) AS days, avg(gross) * 1e4 AS gross_bps, avg(turnover) AS turnover, avg(net) AS net_bps, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS ir
  FROM (SELECT *, gross * 1e4 - cost * coalesce(turnover, 0) AS net FROM series, (SELECT CAST(unnest([0, 5, 10, 20]) AS BIGINT) AS cost)) GROUP BY ALL)"""
CURVE = ["gross_bps", "turnover", "net_bps", "ir"]


def held_sql(q: str, k: str = "", src: str = "dense", sides: tuple[str, ...] = ("long", "short")) -> str:
    side = " UNION ALL ".join(f"SELECT *, '{s}' AS side, {'pct' if s == 'long' else '1 - pct'} AS x FROM pct" for s in sides)
    return f"""
pct AS (SELECT *, row_number() OVER (PARTITION BY {k} date ORDER BY pred, instrument) / CAST(names AS DOUBLE) AS pct FROM {src}),
sided AS (SELECT * FROM ({side}) WHERE x >= 1 - {q}),
isl AS (SELECT *, day_idx - row_number() OVER (PARTITION BY {k} side, instrument ORDER BY day_idx) AS island FROM sided),
held AS (SELECT * FROM (SELECT *, max(CASE WHEN x >= 1 - 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} side, instrument, island ORDER BY day_idx ROWS UNBOUNDED PRECEDING) AS h FROM isl) WHERE h = 1)"""


def ema_sql(span: int, name: str, src: str = "preds") -> str:
    a = 2.0 / (span + 1)
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) AS k FROM {src}),
{name}_r AS (SELECT instrument, k, pred AS y FROM {name}_n WHERE k = 1 UNION ALL SELECT n.instrument, n.k, {a} * n.pred + {1 - a} * r.y FROM {name}_r r JOIN {name}_n n ON n.instrument = r.instrument AND n.k = r.k + 1),
{name} AS (SELECT n.instrument, n.date, r.y AS pred, n.label_raw, n.label, n.test_year FROM {name}_n n JOIN {name}_r r ON n.instrument = r.instrument AND n.k = r.k)"""


#: Features that the registered queries use as scores.
SCORES = ["ROC5", "RSV10", "STD20", "VMA10"]


def label_medians(rows: DataFrame) -> DataFrame:
    return normalize.day_medians(rows, "label_raw")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, date, scores, label_raw, label): entry-gated vwap labels, stored once per session and input. What is stored
    needs one shuffle, of the trades by instrument; the label follows from its medians by day."""

    def build() -> DataFrame:
        bars = panel(spark, sf_dir)
        keep = ["open", "high", "low", "close", "vwap", "raw_close", "volume", "amount", "factor"]
        return lab.raw_labels(lab.with_flags(feat.features(bars, SCORES, keep))).select("instrument", "date", *SCORES, "label_raw")

    table = stored(spark, sf_dir, "lineitem", "scored", build)
    rows = normalize.with_day_z(load_years(spark, table), "label_raw", "label", small_of(spark, table, label_medians))
    return rows.select("instrument", "date", *SCORES, "label_raw", "label")


def predictions(spark: SparkSession, sf_dir: str, member: str = "ROC5") -> DataFrame:
    """(instrument, date, pred, label_raw, label, test_year): one of ``SCORES`` as the score."""
    df = scored(spark, sf_dir).where(F.col(member).isNotNull() & F.col("label_raw").isNotNull())
    return df.select("instrument", "date", F.col(member).alias("pred"), "label_raw", "label", F.year("date").cast("long").alias("test_year"))


def _rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*(day(k).alias(k) if k == "date" else F.col(k) for k in keys), *(r6(F.col(v)).alias(v) for v in values))


def _r(values: list[str]) -> str:
    return ", ".join(f"{R6.format(v)} AS {v}" for v in values)


QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


D = "CAST(date AS VARCHAR) AS date"


@register("minimum_slice", f"{PREDS_SQL}, {IC_SQL} SELECT count(*) AS days, {_r(['mean', 'sd'])} FROM (SELECT avg(rank_ic) AS mean, stddev_samp(rank_ic) AS sd, count(rank_ic) AS c FROM daily), (SELECT date FROM daily WHERE rank_ic IS NOT NULL) GROUP BY mean, sd")
def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ic_summary(metrics.daily_ic(predictions(spark, sf_dir))), ["days"], ["mean", "sd"])


@register("robust_z", f"""WITH {BARS_SQL}, {PREP_SQL}, f AS (SELECT instrument, date, lag(close, 5) OVER (PARTITION BY instrument ORDER BY date) / close AS a, (close - open) / open AS b FROM prep),
  m AS (SELECT *, median(a) OVER d AS ma, median(b) OVER d AS mb FROM f WINDOW d AS (PARTITION BY date)), s AS (SELECT *, median(abs(a - ma)) OVER d AS da, median(abs(b - mb)) OVER d AS db FROM m WINDOW d AS (PARTITION BY date))
  SELECT instrument, {D}, round(coalesce(greatest(-3, least(3, (a - ma) / (1.4826 * da + 1e-12))), 0), 6) + 0.0 AS "ROC5", round(coalesce(greatest(-3, least(3, (b - mb) / (1.4826 * db + 1e-12))), 0), 6) + 0.0 AS "KMID" FROM s""".replace("greatest(-3, least(3, (a - ma) / (1.4826 * da + 1e-12)))", "CASE WHEN a IS NOT NULL THEN greatest(-3, least(3, (a - ma) / (1.4826 * da + 1e-12))) END"))
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["ROC5", "KMID"]
    return _rounded(normalize.robust_z(feat.features(panel(spark, sf_dir), names), {n: n for n in names}, fill=0.0), ["instrument", "date"], names)


@register("csnorm", f"{PREDS_SQL} SELECT instrument, {D}, {R6.format('CASE WHEN sd > 1e-12 THEN (pred - mu) / sd ELSE 0 END')} AS z FROM (SELECT *, avg(pred) OVER (PARTITION BY date) AS mu, stddev_pop(pred) OVER (PARTITION BY date) AS sd FROM preds)")
def csnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize.standard(predictions(spark, sf_dir), "pred", "z"), ["instrument", "date"], ["z"])


def _label_query(kind: str, gated: str, horizon: int = 1):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(lab.labels(lab.with_flags(panel(spark, sf_dir)), kind, gated, horizon), ["instrument", "date"], ["label_raw", "label"])

    return query


for _name, _args in {"label_close": ("close", "full"), "label_vwap_entry": ("vwap", "entry"), "label_vwap_full": ("vwap", "full"), "label_hlc3_none": ("hlc3", "none"), "label_horizon": ("vwap", "entry", 5)}.items():
    register(_name, f"WITH {BARS_SQL}, {FLAGS_SQL}, {labels_sql(*_args)} SELECT instrument, {D}, {_r(['label_raw', 'label'])} FROM lab")(_label_query(*_args))


def named_labels_sql(kind: str, gated: str, tag: str) -> str:
    """``labels_sql`` with its tables named after ``tag``."""
    part = labels_sql(kind, gated)
    for name in ("rtn", "raw", "lab"):
        part = part.replace(f"{name} AS (", f"{name}_{tag} AS (").replace(f"FROM {name})", f"FROM {name}_{tag})")
    return part


VERIFY = f"WITH {BARS_SQL}, {FLAGS_SQL}, {named_labels_sql('close', 'full', 'a')}, {named_labels_sql('hlc3', 'none', 'b')}, ab AS (SELECT a.label_raw AS a, b.label_raw AS b FROM lab_a a JOIN lab_b b ON a.instrument = b.instrument AND a.date = b.date)"


@register("label_verify", f"{VERIFY} SELECT count(*) AS n_left, count(*) AS n_right, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL)) AS n_missing_differs, {R6.format('max(abs(a - b))')} AS max_difference FROM ab")
def label_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two prices and gates held against each other: where only one is missing, and how far they differ."""
    flagged = lab.with_flags(panel(spark, sf_dir))
    one, two = lab.labels(flagged, "close", "full"), lab.labels(flagged, "hlc3", "none")
    return lab.verify(one, two).select("n_left", "n_right", "n_missing_differs", r6(F.col("max_difference")).alias("max_difference"))


LIMITS = ["lim_up_t1", "lim_dn_t2", "lim_up_t2", "oneword_t1"]


@register("limit_flags", f"""WITH {BARS_SQL}, {FLAGS_SQL} SELECT instrument, {D}, can_buy, can_sell, NOT coalesce(lead(can_buy, 1) OVER i, false) AS lim_up_t1, NOT coalesce(lead(can_sell, 2) OVER i, false) AS lim_dn_t2,
  NOT coalesce(lead(can_buy, 2) OVER i, false) AS lim_up_t2, coalesce(lead(high = low, 1) OVER i, false) AS oneword_t1 FROM flags WINDOW i AS (PARTITION BY instrument ORDER BY date)""")
def limit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.diagnostics(lab.with_flags(panel(spark, sf_dir))).select("instrument", day().alias("date"), "can_buy", "can_sell", *LIMITS)


@register("segments", f"WITH {BARS_SQL} SELECT CASE WHEN date < DATE '1999-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'valid' ELSE 'test' END AS segment, count(*) AS n, count(DISTINCT instrument) AS names FROM bars GROUP BY ALL")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.segments(panel(spark, sf_dir), "1999-01-01", "2000-01-01").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instrument").alias("names"))


@register("daily_ic", f"{PREDS_SQL}, {IC_SQL} SELECT {D}, n, {_r(['ic', 'rank_ic'])} FROM daily")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.daily_ic(predictions(spark, sf_dir)), ["date", "n"], ["ic", "rank_ic"])


SUMMARY = ["mean", "sd", "positive", "icir", "t"]
SUMMARY_SQL = "count(x) AS days, avg(x) AS mean, stddev_samp(x) AS sd, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS positive, avg(x) / nullif(stddev_samp(x), 0) AS icir, avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(x)) AS t"


@register("ic_summary", f"{PREDS_SQL}, {IC_SQL}, s AS (SELECT {SUMMARY_SQL} FROM (SELECT rank_ic AS x FROM daily WHERE rank_ic IS NOT NULL)) SELECT days, {_r(SUMMARY)} FROM s")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ic_summary(metrics.daily_ic(predictions(spark, sf_dir))), ["days"], SUMMARY)


@register("period_breakdown", f"{PREDS_SQL}, {IC_SQL}, e AS (SELECT rank_ic AS x, 'Y' || year(date) AS period FROM daily WHERE rank_ic IS NOT NULL UNION ALL SELECT rank_ic, year(date) || 'Q' || quarter(date) FROM daily WHERE rank_ic IS NOT NULL), s AS (SELECT period, {SUMMARY_SQL} FROM e GROUP BY period HAVING count(x) >= 20) SELECT period, days, {_r(SUMMARY)} FROM s")
def period_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.period_breakdown(metrics.daily_ic(predictions(spark, sf_dir))), ["period", "days"], SUMMARY)


@register("deciles", f"{PREDS_SQL}, {DECILE_SQL} SELECT decile, count(*) AS days, {R6.format('avg(r) * 1e4')} AS bps FROM (SELECT date, decile, avg(label_raw) AS r FROM dec GROUP BY ALL) GROUP BY decile")
def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.decile_returns(predictions(spark, sf_dir)), ["decile", "days"], ["bps"])


@register("monotonicity", f"{PREDS_SQL}, {DECILE_SQL}, b AS (SELECT decile, avg(r) * 1e4 AS bps FROM (SELECT date, decile, avg(label_raw) AS r FROM dec GROUP BY ALL) GROUP BY decile), k AS (SELECT *, row_number() OVER (ORDER BY bps, decile) AS rk FROM b) SELECT {R6.format('corr(decile, rk)')} AS spearman, {R6.format('arg_max(bps, decile) - arg_min(bps, decile)')} AS spread_bps FROM k")
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.monotonicity(metrics.decile_returns(predictions(spark, sf_dir))), [], ["spearman", "spread_bps"])


@register("cap_scan", f"{PREDS_SQL.replace('abs(r) <= 0.8', 'true')}, caps AS (SELECT CAST(unnest([0.0, 0.8, 0.5, 0.2, 0.05]) AS DOUBLE) AS cap), c AS (SELECT * FROM preds, caps WHERE cap <= 0 OR abs(label_raw) <= cap), r AS (SELECT *, row_number() OVER (PARTITION BY cap, date ORDER BY pred, instrument) AS rp, row_number() OVER (PARTITION BY cap, date ORDER BY label_raw, instrument) AS rl FROM c), d AS (SELECT cap, date, count(*) AS n, CASE WHEN stddev_pop(rp) > 1e-12 THEN covar_pop(rp, rl) / (stddev_pop(rp) * stddev_pop(rl)) END AS x FROM r GROUP BY ALL HAVING count(*) >= 5) SELECT cap, CAST(sum(n) AS BIGINT) AS n, {R6.format('avg(x)')} AS mean FROM d GROUP BY cap")
def cap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All caps in one plan: a row takes part in every cap that it passes."""
    df = lab.labels(lab.with_flags(feat.features(panel(spark, sf_dir), ["ROC5"], ["open", "high", "low", "close", "vwap", "raw_close", "volume", "amount", "factor"])), cap=0)
    df = df.where("ROC5 IS NOT NULL AND label_raw IS NOT NULL").select("instrument", "date", F.col("ROC5").alias("pred"), "label_raw")
    each = df.withColumn("cap", F.explode(F.array(*(F.lit(c) for c in (0.0, 0.8, 0.5, 0.2, 0.05))))).where("cap <= 0 OR abs(label_raw) <= cap")
    return _rounded(metrics.daily_ic(each, ("cap", "date")).groupBy("cap").agg(F.sum("n").alias("n"), F.avg("rank_ic").alias("mean")), ["cap", "n"], ["mean"])


PLAIN_HELD = "held AS (SELECT date, day_idx, instrument, CASE WHEN decile = 9 THEN 'long' ELSE 'short' END AS side, label_raw FROM (SELECT *, least(9, CAST(floor((row_number() OVER (PARTITION BY date ORDER BY pred, instrument) - 1) * 10.0 / names) AS BIGINT)) AS decile FROM dense) WHERE decile IN (0, 9))"


@register("portfolio_plain", f"{PREDS_SQL}, {DENSE_SQL.format('preds')}, {PLAIN_HELD}, {LEGS_SQL.format(k='')}, {SERIES_SQL['ls'].format(k='')}, {CURVE_SQL.format(k='')} SELECT cost, days, {_r(CURVE)} FROM curve")
def portfolio_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = portfolio.deciles_held(portfolio.dense_days(predictions(spark, sf_dir)))
    return _rounded(portfolio.cost_curve(portfolio.long_short(held)), ["cost", "days"], CURVE)


EMA5 = ema_sql(5, "ema5")


@register("ema", f"{PREDS_SQL}, {EMA5} SELECT instrument, {D}, {_r(['pred'])} FROM ema5")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(portfolio.ema(predictions(spark, sf_dir), 5), ["instrument", "date"], ["pred"])


HELD5 = f"{PREDS_SQL}, {EMA5}, {DENSE_SQL.format('ema5')}, {held_sql('0.2')}"


@register("hysteresis_ls", f"{HELD5}, {LEGS_SQL.format(k='')}, {SERIES_SQL['ls'].format(k='')} SELECT {D}, day_idx, {_r(['gross', 'turnover'])} FROM series")
def hysteresis_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = portfolio.dense_days(portfolio.ema(predictions(spark, sf_dir), 5))
    return _rounded(portfolio.long_short(portfolio.hysteresis(ranked, 0.1, 0.2)), ["date", "day_idx"], ["gross", "turnover"])


@register("long_only", f"{HELD5}, {LEGS_SQL.format(k='')}, {SERIES_SQL['lo'].format(k='', src='dense')} SELECT {D}, day_idx, {_r(['gross', 'turnover'])} FROM series")
def long_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = portfolio.dense_days(portfolio.ema(predictions(spark, sf_dir), 5))
    return _rounded(portfolio.long_only(ranked, portfolio.hysteresis(ranked, 0.1, 0.2, sides=("long",))), ["date", "day_idx"], ["gross", "turnover"])


@register("cost_curve", f"{HELD5}, {LEGS_SQL.format(k='')}, {SERIES_SQL['ls'].format(k='')}, {CURVE_SQL.format(k='')} SELECT cost, days, {_r(CURVE)} FROM curve")
def cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = portfolio.dense_days(portfolio.ema(predictions(spark, sf_dir), 5))
    return _rounded(portfolio.cost_curve(portfolio.long_short(portfolio.hysteresis(ranked, 0.1, 0.2))), ["cost", "days"], CURVE)


KEYS = ("span", "q_exit")
GRID_SPANS, GRID_EXITS = portfolio.SPANS, portfolio.EXITS


def grid_sql(spans: tuple[int, ...], exits: tuple[float, ...], sides: tuple[str, ...], kind: str) -> str:
    smooth = ", ".join(ema_sql(s, f"ema{s}") for s in spans if s > 1)
    dense = " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS span, * FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY date) AS BIGINT) AS day_idx FROM (SELECT *, count(*) OVER (PARTITION BY date) AS names FROM {'preds' if s == 1 else f'ema{s}'}) WHERE names >= 10)" for s in spans)
    return f"{PREDS_SQL}, {smooth}, grid AS (SELECT *, CAST(unnest({list(exits)}) AS DOUBLE) AS q_exit FROM ({dense})), {held_sql('q_exit', 'span, q_exit,', 'grid', sides)}, {LEGS_SQL.format(k='span, q_exit,')}, {SERIES_SQL[kind].format(k='span, q_exit,', src='grid')}"


GRID_SQL = grid_sql(GRID_SPANS, GRID_EXITS, ("long", "short"), "ls")


def grid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.long_short(portfolio.hysteresis(portfolio.variants(predictions(spark, sf_dir)), 0.1, "q_exit", KEYS), KEYS)


@register("variant_grid", f"{GRID_SQL}, {CURVE_SQL.format(k='span, q_exit,')} SELECT span, q_exit, cost, days, {_r(CURVE)} FROM curve")
def variant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 long-short variants; an error if they differ in days."""
    return _rounded(portfolio.with_equal_days(portfolio.cost_curve(grid_series(spark, sf_dir), KEYS)), [*KEYS, "cost", "days"], CURVE)


@register("variant_grid_lo", f"{grid_sql(portfolio.LONG_SPANS, portfolio.LONG_EXITS, ('long',), 'lo')}, {CURVE_SQL.format(k='span, q_exit,')} SELECT span, q_exit, cost, days, {_r(CURVE)} FROM curve")
def variant_grid_lo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 long-only variants, each against the equal-weighted universe."""
    ranked = portfolio.variants(predictions(spark, sf_dir), portfolio.LONG_SPANS, portfolio.LONG_EXITS)
    series = portfolio.long_only(ranked, portfolio.hysteresis(ranked, 0.1, "q_exit", KEYS, ("long",)), KEYS)
    return _rounded(portfolio.with_equal_days(portfolio.cost_curve(series, KEYS)), [*KEYS, "cost", "days"], CURVE)


@register("decile_pivot", f"{PREDS_SQL}, {DECILE_SQL} SELECT {D}, {', '.join(f'round(avg(label_raw) FILTER (WHERE decile = {k}), 6) + 0.0 AS d{k}' for k in range(10))} FROM dec GROUP BY date")
def decile_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's mean return by decile, one column per decile."""
    return _rounded(metrics.decile_table(predictions(spark, sf_dir)), ["date"], [f"d{k}" for k in range(10)])
