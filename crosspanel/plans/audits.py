"""Queries over exposure and limit audits, linear and boosted models, epoch rules, labels from outside, and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import day, r6
from ..operators import audit, features as feat, labels as lab, metrics, models, portfolio, spans
from ..sources.store import made_once
from .panel import BARS_SQL, FRAMES, PREP_SQL, R6, features_sql, panel, rolling_sql
from .scores import CURVE, D, DECILE_SQL, FLAGS_SQL, IC_SQL, PREDS_SQL, _r, _rounded, labels_sql, predictions, preds_sql
from .studies import BOTH_SQL, FOLD_ARGS, FOLD_SQL, MEMBERS, POOL_SQL, _avg_rank, _both, member_table

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- limits and labels

SPREADS = ["top", "raw", "entry", "exits", "spread_raw", "spread_entry", "spread_exits", "entry_cost"]


@register("limit_spreads", f"""{PREDS_SQL}, {DECILE_SQL}, fl AS (SELECT instrument, date, coalesce(lead(can_sell, 1) OVER i, false) AS so, coalesce(lead(can_buy, 2) OVER i, false) AS sc FROM flags WINDOW i AS (PARTITION BY instrument ORDER BY date)),
  dd AS (SELECT date, avg(label_raw) FILTER (WHERE decile = 9) AS t, avg(label_raw) FILTER (WHERE decile = 0) AS w, avg(label_raw) FILTER (WHERE decile = 0 AND so) AS e, avg(label_raw) FILTER (WHERE decile = 0 AND so AND sc) AS b FROM dec JOIN fl USING (instrument, date) GROUP BY date),
  m AS (SELECT avg(t) * 1e4 AS top, avg(w) * 1e4 AS raw, avg(e) * 1e4 AS entry, avg(b) * 1e4 AS exits FROM dd),
  s AS (SELECT *, top - raw AS spread_raw, top - entry AS spread_entry, top - exits AS spread_exits, raw - entry AS entry_cost FROM m) SELECT {_r(SPREADS)} FROM s""")
def limit_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the deciles with shorts as they come, without forbidden entries, and without failed exits as well."""
    flagged = lab.with_flags(panel(spark, sf_dir))
    flags = flagged.select("instrument", "date", lab.ahead("can_sell", 1).alias("short_open"), lab.ahead("can_buy", 2).alias("short_close"))
    return _rounded(audit.gated_spreads(predictions(spark, sf_dir), flags), [], SPREADS)


CODE_SQL = "CASE s_nationkey % 5 WHEN 0 THEN '600' WHEN 1 THEN '688' WHEN 2 THEN '300' WHEN 3 THEN '301' ELSE '000' END || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0')"


@register("tradability_limits", f"""WITH {BARS_SQL}, co AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS instrument, substr({CODE_SQL}, 1, 3) AS head, s_acctbal < 0 AS special FROM supplier),
  ch AS (SELECT instrument, date, 100 * (raw_close / lag(raw_close) OVER (PARTITION BY instrument ORDER BY date) - 1) AS pct FROM adj),
  li AS (SELECT ch.*, CASE WHEN head IN ('688', '689') THEN 'star' WHEN head IN ('300', '301') THEN 'growth' ELSE 'main' END AS board, special, CASE WHEN special THEN 4.8 WHEN head IN ('688', '689') OR (head IN ('300', '301') AND date >= DATE '1996-01-01') THEN 19.8 ELSE 9.8 END AS lim FROM ch JOIN co USING (instrument))
  SELECT board, special, CAST(lim AS DOUBLE) AS lim, count(*) AS n, count(*) FILTER (WHERE coalesce(pct < lim, false)) AS buyable, count(*) FILTER (WHERE coalesce(pct > -lim, false)) AS sellable FROM li GROUP BY ALL""")
def tradability_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits by board, date and special treatment: boards from suppliers' nations, special where they owe."""
    nation = F.col("s_nationkey") % 5
    head = F.when(nation == 0, "600").when(nation == 1, "688").when(nation == 2, "300").when(nation == 3, "301").otherwise("000")
    code = F.concat(head, F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"))
    names = sources.table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("instrument"), lab.board_of(code).alias("board"), (F.col("s_acctbal") < 0).alias("special"))
    rows = lab.with_flags(panel(spark, sf_dir)).select("instrument", "date", "pct_change").join(names, "instrument")
    rows = rows.withColumn("lim", lab.limit_of(F.col("board"), F.col("date"), F.col("special"), "1996-01-01"))
    can_buy, can_sell = lab.tradable(F.col("pct_change"), F.col("lim"))
    return rows.groupBy("board", "special", "lim").agg(F.count(F.lit(1)).alias("n"), F.count_if(can_buy).alias("buyable"), F.count_if(can_sell).alias("sellable"))


@register("flags_joined", f"WITH {BARS_SQL}, {FLAGS_SQL}, f AS (SELECT * FROM flags WHERE CAST(instrument AS BIGINT) % 4 <> 1) SELECT CAST(year(b.date) AS BIGINT) AS year, count(*) AS n, count(*) FILTER (WHERE coalesce(f.can_buy, false)) AS buyable, count(*) FILTER (WHERE coalesce(f.can_sell, false)) AS sellable FROM adj b LEFT JOIN f ON b.instrument = f.instrument AND b.date = f.date GROUP BY ALL")
def flags_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that another table holds for some instruments, joined; a repeated key would be an error."""
    bars = panel(spark, sf_dir)
    flags = lab.with_flags(bars).where(F.col("instrument").cast("long") % 4 != 1)
    out = lab.with_joined_flags(bars, flags)
    return out.groupBy(F.year("date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if("can_buy").alias("buyable"), F.count_if("can_sell").alias("sellable"))


EXTERNAL = f"WITH {BARS_SQL}, {PREP_SQL}, {FLAGS_SQL}, {labels_sql('hlc3', 'none')}, ext AS (SELECT instrument, date, label, label_raw FROM lab WHERE CAST(instrument AS BIGINT) % 7 <> 3), sc AS (SELECT instrument, date, {rolling_sql('ROC', 5)} AS pred FROM prep {FRAMES}), preds AS (SELECT s.instrument, s.date, s.pred, e.label_raw, e.label FROM sc s JOIN ext e ON s.instrument = e.instrument AND s.date = e.date WHERE e.label_raw IS NOT NULL)"


@register("external_label_ic", f"{EXTERNAL}, {IC_SQL.replace('FROM preds)', 'FROM preds WHERE pred IS NOT NULL)')} SELECT {D}, n, {_r(['ic', 'rank_ic'])} FROM daily")
def external_label_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations with labels that come from another table than the panel's own."""
    keep = ["open", "high", "low", "close", "vwap", "raw_close", "volume", "amount", "factor"]
    own = lab.labels(lab.with_flags(feat.features(panel(spark, sf_dir), ["ROC5"], keep)))
    external = lab.labels(lab.with_flags(panel(spark, sf_dir)), "hlc3", "none").where(F.col("instrument").cast("long") % 7 != 3)
    rows = lab.with_external_label(own, external).withColumn("pred", F.col("ROC5"))
    return _rounded(metrics.daily_ic(rows), ["date", "n"], ["ic", "rank_ic"])


@register("label_coverage", f"{EXTERNAL} SELECT (SELECT count(*) FROM adj) AS n, {R6.format('(SELECT count(*) FROM ext WHERE label_raw IS NOT NULL) / CAST((SELECT count(*) FROM adj) AS DOUBLE)')} AS covered")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the panel's rows a label from outside covers."""
    bars = panel(spark, sf_dir)
    external = lab.labels(lab.with_flags(bars), "hlc3", "none").where(F.col("instrument").cast("long") % 7 != 3)
    return _rounded(lab.coverage(bars, external, "label_raw"), ["n"], ["covered"])


@register("adjusted_by_factor", f"WITH {BARS_SQL}, ac AS (SELECT instrument, date, round(close, 3) AS adj_close FROM adj WHERE CAST(instrument AS BIGINT) % 5 <> 2) SELECT b.instrument, CAST(b.date AS VARCHAR) AS date, round(open * (adj_close / close), 6) + 0.0 AS open, round(high * (adj_close / close), 6) + 0.0 AS high, round(low * (adj_close / close), 6) + 0.0 AS low, round(adj_close, 6) + 0.0 AS close, round(adj_close / close, 6) + 0.0 AS factor FROM bars b JOIN ac ON b.instrument = ac.instrument AND b.date = ac.date")
def adjusted_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bars and adjusted closes of two tables, inner-joined on the day; the factor is their quotient."""
    other = panel(spark, sf_dir).where(F.col("instrument").cast("long") % 5 != 2).select("instrument", "date", F.round("close", 3).alias("adj_close"))
    out = sources.by_factor(sources.weekly_bars(spark, sf_dir).join(other, ["instrument", "date"]))
    return _rounded(out, ["instrument", "date"], ["open", "high", "low", "close", "factor"])


@register("market_caps", f"{PREDS_SQL.replace('abs(r) <= 0.8', 'true')} SELECT m AS market, count(*) AS n, {R6.format('max(abs(label_raw))')} AS largest FROM preds, (SELECT unnest(['us', 'cn']) AS m) WHERE m = 'cn' OR abs(label_raw) <= 0.8 GROUP BY m")
def market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each market's own cap leaves; the market comes from a file's name."""
    keep = ["open", "high", "low", "close", "vwap", "raw_close", "volume", "amount", "factor"]
    rows = lab.labels(lab.with_flags(feat.features(panel(spark, sf_dir), ["ROC5"], keep)), cap=0).where("ROC5 IS NOT NULL AND label_raw IS NOT NULL")
    each = [metrics.apply_cap(rows, metrics.market_of(f)).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("label_raw")).alias("largest")).select(F.lit(metrics.market_of(f)).alias("market"), "n", r6(F.col("largest")).alias("largest")) for f in ("preds/gbdt_us.parquet", "preds/gbdt_cn.parquet")]
    return each[0].unionByName(each[1])


# ---- exposure and pools

@register("reversal_years", f"{BOTH_SQL} SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS days, {_r(['beta', 'r2', 'spearman']).replace('round(beta', 'round(avg(beta)').replace('round(r2', 'round(avg(r2)').replace('round(spearman', 'round(avg(spearman)')} FROM expo GROUP BY year(date)")
def reversal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audit.yearly_exposure(audit.exposure(_both(spark, sf_dir))), ["year", "days"], ["beta", "r2", "spearman"])


@register("reversal_dropped", f"{BOTH_SQL}, ey AS (SELECT DISTINCT year(date) AS y FROM expo) SELECT DISTINCT CAST(year(date) AS BIGINT) AS year FROM both_ WHERE year(date) NOT IN (SELECT y FROM ey WHERE y > (SELECT min(y) FROM ey))")
def reversal_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that drop out because no earlier one gives a beta."""
    both = _both(spark, sf_dir)
    return audit.dropped_years(both, audit.exposure(both))


def _variants_sql() -> str:
    from .scores import CURVE_SQL, LEGS_SQL, SERIES_SQL, held_sql

    a = 2.0 / 6
    kinds = {"raw": "pz", "nested": "pz - eb.beta * fz", "leaky": "pz - ab * fz", "factor": "fz"}
    rows = " UNION ALL ".join(f"SELECT '{k}' AS kind, z.instrument, z.date, z.label_raw, {v} AS pred FROM z JOIN eb ON year(z.date) = y, (SELECT avg(beta) AS ab FROM expo) WHERE eb.beta IS NOT NULL" for k, v in kinds.items())
    return f"""{BOTH_SQL}, yb AS (SELECT year(date) AS y, sum(beta) AS s, count(beta) AS c FROM expo GROUP BY ALL), eb AS (SELECT y, sum(s) OVER b / sum(c) OVER b AS beta FROM yb WINDOW b AS (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
vr AS ({rows}), vn AS (SELECT *, row_number() OVER (PARTITION BY kind, instrument ORDER BY date) AS k FROM vr),
ve AS (SELECT kind, instrument, k, pred AS y FROM vn WHERE k = 1 UNION ALL SELECT n.kind, n.instrument, n.k, {a} * n.pred + {1 - a} * r.y FROM ve r JOIN vn n ON n.kind = r.kind AND n.instrument = r.instrument AND n.k = r.k + 1),
sm AS (SELECT n.kind, n.instrument, n.date, n.label_raw, r.y AS pred FROM vn n JOIN ve r ON n.kind = r.kind AND n.instrument = r.instrument AND n.k = r.k),
dense AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY kind ORDER BY date) AS BIGINT) AS day_idx FROM (SELECT *, count(*) OVER (PARTITION BY kind, date) AS names FROM sm) WHERE names >= 10),
{held_sql('0.1', 'kind,')}, {LEGS_SQL.format(k='kind,')}, {SERIES_SQL['ls'].format(k='kind,')}, {CURVE_SQL.format(k='kind,')} SELECT kind, cost, days, {_r(CURVE)} FROM curve"""


@register("reversal_variants", _variants_sql())
def reversal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same smoothed portfolio of the score, of what the factor leaves of it, and of the factor alone."""
    both = _both(spark, sf_dir)
    each = audit.reversal_variants(both, audit.exposure(both)).select("kind", F.concat_ws("|", "kind", "instrument").alias("instrument"), "date", "label_raw", "pred")
    smooth = portfolio.ema(each, 5).withColumn("instrument", F.element_at(F.split("instrument", r"\|"), 2))
    ranked = portfolio.dense_days(smooth, keys=("kind",))
    series = portfolio.long_short(portfolio.hysteresis(ranked, 0.1, 0.1, ("kind",)), ("kind",))
    return _rounded(portfolio.cost_curve(series, ("kind",)), ["kind", "cost", "days"], CURVE)


@register("pool_rows", f"{POOL_SQL}, k AS (SELECT instrument, date FROM p_ROC5 " + " ".join(f"UNION SELECT instrument, date FROM p_{m}" for m in MEMBERS[1:]) + f") SELECT (SELECT count(*) FROM k) AS n_union, (SELECT count(*) FROM wide) AS n_common, {R6.format('(SELECT count(*) FROM wide) / CAST((SELECT count(*) FROM k) AS DOUBLE)')} AS share")
def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audit.pool_rows(member_table(spark, sf_dir, MEMBERS), MEMBERS), ["n_union", "n_common"], ["share"])


_pairs = [(a, b) for i, a in enumerate(MEMBERS) for b in MEMBERS[i + 1 :]]


@register("pool_off_diagonal", f"{POOL_SQL}, rk AS (SELECT *, " + ", ".join(f"{_avg_rank(m)} AS r_{m}" for m in MEMBERS) + " FROM (SELECT *, count(*) OVER (PARTITION BY date) AS nn FROM wide) WHERE nn >= 20), " + "pd AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, date, corr(r_{a}, r_{b}) AS x FROM rk GROUP BY date" for a, b in _pairs) + f"), pp AS (SELECT a, b, avg(x) AS rho FROM pd GROUP BY a, b) SELECT count(*) AS pairs, {R6.format('avg(rho)')} AS mean, {R6.format('min(rho)')} AS low, {R6.format('max(rho)')} AS high FROM pp")
def pool_off_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = member_table(spark, sf_dir, MEMBERS).dropna(subset=MEMBERS)
    return _rounded(audit.off_diagonal(audit.pool_correlation(wide, MEMBERS)), ["pairs"], ["mean", "low", "high"])


@register("checked_pair", f"{POOL_SQL} SELECT count(*) AS n, {R6.format('avg(ROC5)')} AS a, {R6.format('avg(RSV10)')} AS b FROM wide")
def checked_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' rows, which must be the same; an error if they are not."""
    wide = member_table(spark, sf_dir, MEMBERS).dropna(subset=MEMBERS)
    one, two = (wide.select("date", "instrument", F.col(m).alias("pred")) for m in ("ROC5", "RSV10"))
    return audit.checked_pair(one, two).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("a")).alias("a"), r6(F.avg("b")).alias("b"))


# ---- models

@register("folds_purged", f"WITH {BARS_SQL}, {FOLD_SQL.replace('test_start - 3 - 20 + 1 - 3', 'test_start - 6 - 20 + 1 - 6').replace('test_start - 3 - 20 + 1', 'test_start - 6 - 20 + 1').replace('test_start - 3 AS', 'test_start - 6 AS')} SELECT test_year, fit_end, val_start, val_end, test_start, test_end, n_fit, n_val, n_test FROM folds")
def folds_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of the stacked model: five days are purged between fit, validation and test."""
    return models.folds(sources.weekly_bars(spark, sf_dir).select("date").distinct(), **(FOLD_ARGS | {"embargo": 5}))


def model_panel(spark: SparkSession, sf_dir: str) -> spans.Panel:
    """Bars and raw labels by instrument, kept once per session and input: what the learners' features are made from."""

    def build() -> spans.Panel:
        return spans.kept_panel(lab.raw_labels(lab.with_flags(panel(spark, sf_dir))))

    return made_once(spark, sf_dir, "lineitem", "histories", build)


def _fold_rows(spark: SparkSession, sf_dir: str) -> list:
    return [r.asDict() for r in models.folds(sources.weekly_bars(spark, sf_dir).select("date").distinct(), **FOLD_ARGS).orderBy("test_year").collect()]  # one row per year


def gram_sql() -> str:
    own = features_sql(feat.FEATURES)
    bars_prep = f"{BARS_SQL}, {PREP_SQL}"
    columns = own[own.rindex("SELECT instrument, CAST(date AS VARCHAR) AS date,") :].replace("CAST(date AS VARCHAR) AS date", "date").replace("round(", "(").replace(", 6) + 0.0 AS", ") AS")
    return f"""WITH {bars_prep}, {FLAGS_SQL}, {labels_sql('vwap', 'entry')}, ft AS ({columns}),
lg AS (SELECT * FROM ft UNPIVOT INCLUDE NULLS (x FOR name IN (COLUMNS(* EXCLUDE (instrument, date))))),
md AS (SELECT *, x - median(x) OVER (PARTITION BY date, name) AS off FROM lg),
zz AS (SELECT instrument, date, name, CASE WHEN off IS NULL THEN 0 ELSE greatest(-3.0, least(3.0, off / (1.4826 * median(abs(off)) OVER (PARTITION BY date, name) + 1e-12))) END AS x FROM md),
kp AS (SELECT instrument, date, label FROM lab WHERE label IS NOT NULL),
al AS (SELECT z.instrument, z.date, z.name, z.x FROM zz z JOIN kp ON z.instrument = kp.instrument AND z.date = kp.date UNION ALL SELECT instrument, date, 'label', label FROM kp)
SELECT a.name AS a, b.name AS b, round(sum(a.x * b.x) / count(*), 6) + 0.0 AS value FROM al a JOIN al b ON a.instrument = b.instrument AND a.date = b.date AND a.name <= b.name GROUP BY ALL"""


@register("ridge_normal_eq", gram_sql())
def ridge_normal_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean products of all 158 features and the label, every pair once."""
    names = [*feat.FEATURES, "label"]
    square = models.day_squares(model_panel(spark, sf_dir), feat.FEATURES, []).get(0)  # 160 x 160, whatever the rows
    pairs = [] if square is None else [(a, b, float(square[i + 1, j + 1] / square[0, 0])) for i, a in enumerate(names) for j, b in enumerate(names) if a <= b]
    return spark.createDataFrame(pairs, "a string, b string, value double").withColumn("value", r6(F.col("value")))


def _walk(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    daily = models.linear_days(model_panel(spark, sf_dir), feat.FEATURES, _fold_rows(spark, sf_dir), **how)
    year = daily.groupBy("test_year", "choice").agg(F.count(F.lit(1)).alias("days"), F.avg("rank_ic").alias("mean"))
    return _rounded(year, ["test_year", "choice", "days"], ["mean"])


@register("ridge_select", None)
def ridge_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge walk-forward on 158 features: mean daily rank correlation by test year, alpha by validation out of ten."""
    return _walk(spark, sf_dir)


@register("elastic_select", None)
def elastic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elastic net walk-forward on the same sums, half of the penalty absolute."""
    import numpy as np

    choices = (1e-4, 1e-3, 1e-2)
    return _walk(spark, sf_dir, weigh=lambda m, alphas: np.stack([models.elastic_weights(m, a, 0.5) for a in alphas], 1), choices=choices)


@register("segment_loss", f"{PREDS_SQL}, {FOLD_SQL}, f AS (SELECT * FROM folds ORDER BY test_year LIMIT 1), q AS (SELECT p.date, p.pred, p.label, CASE WHEN c.d <= f.fit_end THEN 'fit' WHEN c.d BETWEEN f.val_start AND f.val_end THEN 'val' WHEN c.d BETWEEN f.test_start AND f.test_end THEN 'test' END AS segment FROM preds p JOIN cal c ON p.date = c.date, f), dd AS (SELECT segment, date, CASE WHEN stddev_pop(pred) > 1e-12 AND stddev_pop(label) > 1e-12 THEN covar_pop(pred, label) / (stddev_pop(pred) * stddev_pop(label)) END AS ic, avg((pred - label) ^ 2) AS mse FROM q WHERE segment IS NOT NULL GROUP BY ALL) SELECT segment, count(*) AS days, {R6.format('avg(ic)')} AS soft_ic, {R6.format('avg(mse)')} AS mse FROM dd GROUP BY segment")
def segment_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of one score on the fit, validation and test days of the first fold."""
    from pyspark.sql import Window

    calendar = sources.weekly_bars(spark, sf_dir).select("date").distinct().withColumn("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).cast("long"))  # one row per day
    preds = predictions(spark, sf_dir).join(F.broadcast(calendar), "date")
    return _rounded(models.segment_losses(preds, _fold_rows(spark, sf_dir)), ["segment", "days"], ["soft_ic", "mse"])


# ---- validation curves: by year (fold) the mean rank correlation of each month (epoch)

CURVE_FROM = f"{PREDS_SQL}, {IC_SQL}, vc AS (SELECT fold, CAST(row_number() OVER (PARTITION BY fold ORDER BY m) AS BIGINT) AS epoch, val FROM (SELECT CAST(year(date) AS BIGINT) AS fold, month(date) AS m, avg(rank_ic) AS val FROM daily GROUP BY ALL))"
NOISE_SQL = "e0 AS (SELECT *, val - lag(val) OVER (PARTITION BY fold ORDER BY epoch) AS diff FROM vc), ns AS (SELECT *, CASE WHEN count(*) OVER f < 3 THEN stddev_pop(val) OVER f ELSE stddev_samp(diff) OVER f / sqrt(2) END AS sigma, max(val) OVER f AS top, count(*) OVER f AS points, arg_max(epoch, row(val, -epoch)) OVER f AS best, max(epoch) OVER f AS final, row_number() OVER (PARTITION BY fold ORDER BY val DESC, epoch) AS place FROM e0 WINDOW f AS (PARTITION BY fold))"


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    month = metrics.daily_ic(predictions(spark, sf_dir)).groupBy(F.year("date").cast("long").alias("fold"), F.month("date").alias("m")).agg(F.avg("rank_ic").alias("val"))
    return month.select("fold", F.row_number().over(Window.partitionBy("fold").orderBy("m")).cast("long").alias("epoch"), "val")


def _rules_sql() -> str:
    sets = {"argmax": "epoch = best"}
    for k in (3, 5, 10):
        sets |= {f"wavg_best_k{k}": f"epoch <= best AND epoch > best - {k}", f"wavg_run_k{k}": f"epoch > final - {k}", f"wavg_top_k{k}": f"place <= {k}"}
    parts = [f"SELECT fold, '{n}' AS rule, '{'wavg' if n.startswith('wavg') else 'single'}' AS mode, string_agg(CAST(epoch AS VARCHAR), ',' ORDER BY epoch) AS epochs FROM ns WHERE {c} GROUP BY fold" for n, c in sets.items()]
    parts += [f"SELECT fold, 'plateau_med_z{z:g}', 'single', CAST(CAST(floor(quantile_cont(CAST(epoch AS DOUBLE), 0.5)) AS BIGINT) AS VARCHAR) FROM ns WHERE val >= top - {z} * sigma GROUP BY fold" for z in (0.5, 1.0, 2.0)]
    return f"{CURVE_FROM}, {NOISE_SQL} {' UNION ALL '.join(parts)}"


@register("epoch_rules", _rules_sql())
def epoch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 13 rules and the epochs that each chooses."""
    return models.epoch_rules(_curve(spark, sf_dir)).select("fold", "rule", "mode", F.array_join(F.col("epochs").cast("array<string>"), ",").alias("epochs"))


SHAPE = ["sigma", "top", "middle", "peak_z"]


@register("epoch_curve", f"{CURVE_FROM}, {NOISE_SQL}, s AS (SELECT fold, any_value(points) AS points, any_value(best) AS argmax, any_value(sigma) AS sigma, any_value(top) AS top, median(val) AS middle FROM ns GROUP BY fold) SELECT fold, points, argmax, {_r(SHAPE[:3])}, {R6.format('CASE WHEN sigma > 0 THEN (top - middle) / sigma END')} AS peak_z FROM s")
def epoch_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.curve_shape(_curve(spark, sf_dir)), ["fold", "points", "argmax"], SHAPE)


@register("epoch_sma", f"""{CURVE_FROM}, sm AS (SELECT *, avg(val) OVER (PARTITION BY fold ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sma FROM vc),
  st AS (SELECT fold, epoch, sma AS best, 0 AS bad FROM sm WHERE epoch = 1 UNION ALL SELECT s.fold, s.epoch, CASE WHEN s.sma > st.best + 1e-5 THEN s.sma ELSE st.best END, CASE WHEN s.sma > st.best + 1e-5 THEN 0 ELSE st.bad + 1 END FROM st JOIN sm s ON s.fold = st.fold AND s.epoch = st.epoch + 1)
  SELECT s.fold, s.epoch, round(sma, 6) + 0.0 AS sma, round(max(sma) OVER (PARTITION BY s.fold ORDER BY s.epoch), 6) + 0.0 AS best, max(st.bad) OVER (PARTITION BY s.fold ORDER BY s.epoch) >= 3 AS stopped FROM sm s JOIN st ON s.fold = st.fold AND s.epoch = st.epoch""")
def epoch_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed curve and early stopping."""
    return _rounded(models.smoothed_stop(_curve(spark, sf_dir)), ["fold", "epoch", "stopped"], ["sma", "best"])


SEEDS_SQL = f"{PREDS_SQL}, {preds_sql('RSV10', 'preds2')}, uu AS (SELECT 'one' AS model, * FROM preds UNION ALL SELECT 'two', * FROM preds2), us AS (SELECT *, CAST(instrument AS BIGINT) % 3 AS seed FROM uu), ur AS (SELECT *, row_number() OVER (PARTITION BY model, seed, date ORDER BY pred, instrument) AS rp, row_number() OVER (PARTITION BY model, seed, date ORDER BY label_raw, instrument) AS rl FROM us), ud AS (SELECT model, seed, date, corr(rp, rl) AS c FROM ur GROUP BY ALL HAVING count(*) >= 5), sc AS (SELECT model, seed, year(date) AS fold, avg(c) AS x FROM ud GROUP BY ALL), sp AS (SELECT a.model, seeds, mean, seed_sd, fold_sd FROM (SELECT model, count(*) AS seeds, avg(m) AS mean, stddev_samp(m) AS seed_sd FROM (SELECT model, seed, avg(x) AS m FROM sc GROUP BY ALL) GROUP BY model) a JOIN (SELECT model, sqrt(avg(v)) AS fold_sd FROM (SELECT model, fold, var_samp(x) AS v FROM sc GROUP BY ALL) GROUP BY model) b ON a.model = b.model)"


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two models, three thirds of the instruments as seeds, by year."""
    wide = member_table(spark, sf_dir, ["ROC5", "RSV10"])
    model = F.explode(F.array(F.struct(F.lit("one").alias("model"), F.col("ROC5").alias("pred")), F.struct(F.lit("two").alias("model"), F.col("RSV10").alias("pred"))))
    rows = wide.select("instrument", "date", "label_raw", (F.col("instrument").cast("long") % 3).alias("seed"), model.alias("m")).select("*", "m.*")
    year = metrics.daily_ic(rows, ("model", "seed", "date")).groupBy("model", "seed", F.year("date").alias("fold")).agg(F.avg("rank_ic").alias("x"))
    return models.seed_spread(year)


@register("seed_spread", f"{SEEDS_SQL} SELECT model, seeds, {_r(['mean', 'seed_sd', 'fold_sd'])} FROM sp")
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_spread(spark, sf_dir), ["model", "seeds"], ["mean", "seed_sd", "fold_sd"])


@register("model_difference", f"{SEEDS_SQL}, d AS (SELECT a.mean - b.mean AS difference, sqrt(a.seed_sd ^ 2 / a.seeds + b.seed_sd ^ 2 / b.seeds) AS se FROM sp a, sp b WHERE a.model = 'one' AND b.model = 'two') SELECT {_r(['difference', 'se'])}, {R6.format('difference / se')} AS z FROM d")
def model_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(models.model_difference(_spread(spark, sf_dir), "one", "two"), [], ["difference", "se", "z"])


# ---- sources

@register("bars_from_file", "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS date, value AS close, event_id, event_type FROM events WHERE value IS NOT NULL) SELECT instrument, CAST(date AS VARCHAR) AS date, count(*) AS rows, min(event_id) AS event_id, round(arg_min(close, event_id), 6) + 0.0 AS close FROM e GROUP BY ALL")
def bars_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars read from a file: renamed columns, rows without a price gone, the first of a repeated day kept."""
    raw = sources.read_bars(spark, f"{sf_dir}/events.parquet", "user_id", {"ts": "date", "value": "close"})
    n = sources.table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy(F.col("user_id").alias("instrument"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("rows"))
    return raw.join(n, ["instrument", "date"]).select(F.col("instrument").cast("string").alias("instrument"), day().alias("date"), "rows", "event_id", r6(F.col("close")).alias("close"))


@register("salvaged_prices", "WITH a AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS x FROM orders GROUP BY ALL), u AS (SELECT *, 'ok' AS status FROM a UNION ALL SELECT b.*, 'partial' FROM b ANTI JOIN a USING (k, d)) SELECT status, count(*) AS n, count(DISTINCT k) AS keys, round(sum(x), 2) + 0.0 AS total FROM u GROUP BY status")
def salvaged_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources by priority: the second fills what the first lacks and is marked as partial."""
    orders = sources.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderstatus")
    one, two = (df.groupBy("k", "d").agg(F.sum("o_totalprice").alias("x")) for df in (orders.where("o_orderstatus = 'F'"), orders))
    out = sources.salvaged(one, two, ["k", "d"])
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("keys"), r6(F.sum("x"), 2).alias("total"))


@register("universe_quarters", "WITH m AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(min(o_orderdate) AS DATE) AS since, CASE WHEN o_custkey % 3 > 0 THEN CAST(max(o_orderdate) AS DATE) END AS until FROM orders GROUP BY o_custkey), g AS (SELECT CAST(unnest(generate_series(DATE '1993-01-01', DATE '1998-01-01', INTERVAL 3 MONTH)) AS DATE) AS quarter) SELECT DISTINCT CAST(quarter AS VARCHAR) AS quarter, ticker FROM m, g WHERE since <= quarter AND (until IS NULL OR until >= quarter)")
def universe_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was listed at the start of each quarter of a grid."""
    orders = sources.table(spark, sf_dir, "orders")
    listed = orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("since"), F.max(F.to_date("o_orderdate")).alias("last"))
    members = listed.select(F.col("o_custkey").cast("string").alias("ticker"), "since", F.when(F.col("o_custkey") % 3 > 0, F.col("last")).alias("until"))
    return sources.universe_by_quarter(members, "1993-01-01", "1998-01-01").select(day("quarter").alias("quarter"), "ticker")


NUMBERS = """CASE p_size % 8 WHEN 0 THEN ' ' || CAST(p_size AS VARCHAR) || '.25 ' WHEN 1 THEN CAST(p_size AS VARCHAR) || 'e2' WHEN 2 THEN CAST(p_size AS VARCHAR) || '.' WHEN 3 THEN CAST(p_size AS VARCHAR) || '%'
  WHEN 4 THEN CAST(p_size AS VARCHAR) || 'K' WHEN 5 THEN '-.5' WHEN 6 THEN '1,' || CAST(p_size AS VARCHAR) ELSE '' END"""
AMOUNTS = """CASE p_size % 6 WHEN 0 THEN ' $' || format('{:,.2f}', p_retailprice) WHEN 1 THEN CAST(p_size AS VARCHAR) || 'k' WHEN 2 THEN CAST(p_size AS VARCHAR) || ' M' WHEN 3 THEN CAST(p_size AS VARCHAR) || '%'
  WHEN 4 THEN 'n/a' ELSE '-' || CAST(p_size AS VARCHAR) || 'B' END"""


@register("parsed_numbers", f"""WITH t AS (SELECT 'plain' AS form, p_size % 8 AS kind, {NUMBERS} AS x, CAST(CASE p_size % 8 WHEN 0 THEN p_size + 0.25 WHEN 1 THEN p_size * 100.0 WHEN 2 THEN p_size WHEN 3 THEN p_size * 0.01
    WHEN 4 THEN p_size * 1000.0 WHEN 5 THEN -0.5 WHEN 6 THEN CAST('1' || p_size AS INTEGER) END AS DOUBLE) AS u FROM part
  UNION ALL SELECT 'amount', p_size % 6, {AMOUNTS}, CASE p_size % 6 WHEN 0 THEN p_retailprice WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN p_size * 1e6 WHEN 3 THEN p_size * 0.01 WHEN 4 THEN NULL ELSE -p_size * 1e9 END FROM part)
  SELECT form, kind, count(*) AS n, count(v) AS parsed, round(sum(v), 4) + 0.0 AS total, count(u) AS with_unit, round(sum(u), 4) + 0.0 AS unit_total FROM (SELECT *, try_cast(trim(x) AS DOUBLE) AS v FROM t) GROUP BY ALL""")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from texts in any notation and from amounts with separators, signs and units, each text read both ways: as a
    plain number (units, separators and empty texts are none) and with its unit."""
    text = lambda x: F.expr(x.replace("VARCHAR", "STRING").replace("format('{:,.2f}', p_retailprice)", "format_number(p_retailprice, 2)")).alias("x")
    forms = (F.struct(F.lit(form).alias("form"), (F.col("p_size") % kinds).alias("kind"), text(x)) for form, kinds, x in (("plain", 8, NUMBERS), ("amount", 6, AMOUNTS)))
    rows = sources.table(spark, sf_dir, "part").select(F.inline(F.array(*forms))).select("form", "kind", sources.parsed_number(F.col("x")).alias("v"), sources.number_with_unit(F.col("x")).alias("u"))
    return rows.groupBy("form", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("parsed"), r6(F.sum("v"), 4).alias("total"), F.count("u").alias("with_unit"), r6(F.sum("u"), 4).alias("unit_total"))


RUN_NAMES = "CASE WHEN o_orderkey % 4 > 0 THEN 'fold' || CAST(year(o_orderdate) AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '_cn' END || '_seed' || CAST(o_orderkey % 3 AS VARCHAR) || '.pt' ELSE 'all_s' || CAST(o_orderkey % 3 AS VARCHAR) || '.pt' END"


@register("run_names", f"SELECT coalesce(fold, -1) AS fold, coalesce(tag, 'none') AS tag, coalesce(seed, -1) AS seed, count(*) AS n, 'orders' AS from_data, 'us' AS from_market FROM (SELECT try_cast(regexp_extract(f, 'fold(\\d+)(.*)_seed(\\d+)\\.pt$', 1) AS BIGINT) AS fold, CASE WHEN regexp_matches(f, 'fold(\\d+)(.*)_seed(\\d+)\\.pt$') THEN regexp_extract(f, 'fold(\\d+)(.*)_seed(\\d+)\\.pt$', 2) END AS tag, try_cast(regexp_extract(f, 'fold(\\d+)(.*)_seed(\\d+)\\.pt$', 3) AS BIGINT) AS seed FROM (SELECT {RUN_NAMES} AS f FROM orders)) GROUP BY ALL")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold, tag and seed from the names of models' files, with where the rows come from as columns."""
    names = sources.table(spark, sf_dir, "orders").select(F.expr(RUN_NAMES.replace("VARCHAR", "STRING")).alias("f"))
    out = names.select(*(c.alias(k) for k, c in sources.run_of(F.col("f")).items())).fillna(-1, subset=["fold", "seed"]).fillna("none", subset=["tag"]).groupBy("fold", "tag", "seed").agg(F.count(F.lit(1)).alias("n"))
    return sources.stamped(out, data="orders", market=metrics.market_of("preds_us.parquet"))


@register("file_report", "SELECT name, status, coalesce(CASE name WHEN 'customer' THEN (SELECT count(*) FROM customer) WHEN 'part' THEN (SELECT count(*) FROM part) END, -1) AS rows, CAST(coalesce(CASE name WHEN 'customer' THEN (SELECT sum(c_custkey) FROM customer) WHEN 'part' THEN (SELECT sum(p_partkey) FROM part) END, -1) AS BIGINT) AS total FROM (VALUES ('customer', 'ok'), ('part', 'ok'), ('supplier', 'failed'), ('absent', 'missing')) t(name, status)")
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of files of which one lacks a column and one is not there: what each gave."""
    from ..sources import files

    key = {"customer": "c_custkey", "part": "p_partkey", "supplier": "n_regionkey", "absent": "n_regionkey"}
    out = None
    for name, column in key.items():
        read = files.read_pool(spark, {name: f"{sf_dir}/{name}.parquet"}, {column: "long"}).withColumnRenamed(column, "key")
        one = read.groupBy("name").agg(F.max(F.when(F.col("status") != "row", F.col("status"))).alias("status"), F.max(F.when(F.col("status") == "ok", F.col("place"))).alias("rows"), F.sum("key").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out.fillna(-1, subset=["rows", "total"])
