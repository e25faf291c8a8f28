"""Queries over nulls, bootstraps, audits, folds, manifests and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sources
from ..functions import day, finished, r6, shared_folder
from ..operators import audit, features as feat, labels as lab, metrics, models, portfolio, resample
from .panel import BARS_SQL, FRAMES, PREP_SQL, R6, panel, rolling_sql
from .scores import BASE_SQL, D, DECILE_SQL, FLAGS_SQL, GRID_EXITS, GRID_SPANS, GRID_SQL, HELD5, IC_SQL, KEYS, LEGS_SQL, PREDS_SQL, SERIES_SQL, _r, _rounded, grid_series, predictions, preds_sql, scored

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def member_table(spark: SparkSession, sf_dir: str, members: list[str]) -> DataFrame:
    """(instrument, date, label_raw, label, one column per member): several scores of one panel."""
    return scored(spark, sf_dir).where("label_raw IS NOT NULL").select("instrument", "date", "label_raw", "label", *members)


YEARS_SQL = """
net AS (SELECT *, CAST(year(date) AS BIGINT) AS test_year, gross * 1e4 - 10 * coalesce(turnover, 0) AS net FROM series),
yr AS (SELECT {k} test_year, sum(net) AS s, count(*) AS days FROM net GROUP BY ALL),
past AS (SELECT *, sum(s) OVER b / sum(days) OVER b AS past FROM yr WINDOW b AS (PARTITION BY {p} ORDER BY test_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("nested_reselection", f"{GRID_SQL}, {YEARS_SQL.format(k='span, q_exit,', p='span, q_exit')} SELECT test_year, span, q_exit, days, {R6.format('s / days')} AS net_bps FROM (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY past DESC, span, q_exit) AS k FROM past WHERE past IS NOT NULL) WHERE k = 1")
def nested_reselection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.nested(grid_series(spark, sf_dir), KEYS), ["test_year", *KEYS, "days"], ["net_bps"])


def shuffled_sql(src: str, reps: int) -> str:
    """The draws of ``resample.draws``, in SQL."""
    return f"""
pm0 AS (SELECT date, instrument, label_raw, row_number() OVER (PARTITION BY date ORDER BY instrument) AS k, CAST(date - DATE '1970-01-01' AS BIGINT) AS d FROM {src}),
pl AS (SELECT date, list(label_raw ORDER BY k) AS labels FROM pm0 GROUP BY date),
pm1 AS (SELECT rep, date, instrument, k, ((((rep * 1000003 + d) % 4294967296) * 69069 + k) % 4294967296 * 1103515245 + 12345) % 4294967296 AS h FROM pm0, (SELECT unnest(range(1, {reps + 1})) AS rep)),
pm2 AS (SELECT rep, date, instrument, k, (xor(h, h >> 16) * 1103515245 + 12345) % 4294967296 AS h FROM pm1),
pm3 AS (SELECT rep, date, instrument, row_number() OVER (PARTITION BY rep, date ORDER BY xor(h, h >> 15), k) AS k FROM pm2),
shuf AS (SELECT rep, date, instrument, labels[k] AS label_raw FROM pm3 JOIN pl USING (date))"""


def null_sql(src: str, reps: int, k: str = "", using: str = "") -> str:
    return f"""{shuffled_sql(src, reps)},
gr AS (SELECT s.rep, {k} h.date, avg(s.label_raw) FILTER (WHERE side = 'long') - avg(s.label_raw) FILTER (WHERE side = 'short') AS g FROM held h JOIN shuf s USING (date, instrument) GROUP BY ALL),
nets0 AS (SELECT rep, {k} avg(g * 1e4 - 10 * coalesce(turnover, 0)) AS net_bps FROM gr JOIN series USING ({using} date) GROUP BY ALL),
nets AS (SELECT rep, max(net_bps) AS net_bps FROM nets0 GROUP BY rep),
obs AS (SELECT max(x) AS net_bps FROM (SELECT {k} avg(gross * 1e4 - 10 * coalesce(turnover, 0)) AS x FROM series GROUP BY ALL)),
res AS (SELECT o.net_bps AS observed, count(*) AS reps, avg(n.net_bps) AS null_mean, quantile_cont(n.net_bps, 0.95) AS null_95, (1 + sum(CASE WHEN n.net_bps >= o.net_bps THEN 1 ELSE 0 END)) / CAST(1 + count(*) AS DOUBLE) AS p FROM nets n, obs o GROUP BY o.net_bps)"""


PERM_REPS = 2000
NULL = ["observed", "null_mean", "null_95", "p"]


@register("perm_null", f"{HELD5}, {LEGS_SQL.format(k='')}, {SERIES_SQL['ls'].format(k='')}, {null_sql('dense', PERM_REPS)} SELECT reps, {_r(NULL)} FROM res")
def perm_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = portfolio.dense_days(portfolio.ema(predictions(spark, sf_dir), 5)).persist()
    held = portfolio.hysteresis(ranked, 0.1, 0.2)
    seen = resample.net_of(portfolio.long_short(held)).agg(F.avg("net").alias("net_bps"))
    null = resample.null_of_holdings(held, ranked, PERM_REPS)
    return finished(_rounded(resample.p_value(null, seen), ["reps"], NULL), ranked)


SEL_REPS = 200


@register("selection_null", f"{GRID_SQL}, {null_sql('(SELECT DISTINCT date, instrument, label_raw FROM grid)', SEL_REPS, 'span, q_exit,', 'span, q_exit,')} SELECT reps, {_r(NULL)} FROM res")
def selection_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of the grid per permutation; all variants of a permutation share it."""
    grid = portfolio.variants(predictions(spark, sf_dir))
    held = portfolio.hysteresis(grid, 0.1, "q_exit", KEYS).persist()
    seen = resample.net_of(portfolio.long_short(held, KEYS)).groupBy(*KEYS).agg(F.avg("net").alias("net_bps")).agg(F.max("net_bps").alias("net_bps"))
    names = grid.where((F.col("span") == GRID_SPANS[0]) & (F.col("q_exit") == GRID_EXITS[0]))
    null = resample.null_of_holdings(held, names, SEL_REPS, KEYS).groupBy("rep").agg(F.max("net_bps").alias("net_bps"))
    return finished(_rounded(resample.p_value(null, seen), ["reps"], NULL), held)


BOOT_REPS, BLOCKS = 2000, (5, 10, 20, 40)


def index_sql(reps: int = BOOT_REPS, blocks: tuple[int, ...] = BLOCKS) -> str:
    return f"""
nn AS (SELECT count(*) AS n FROM days),
bl AS (SELECT n, block, rep, unnest(range(0, CAST(ceil(n / CAST(block AS DOUBLE)) AS BIGINT))) AS number FROM nn, (SELECT CAST(unnest({list(blocks)}) AS BIGINT) AS block), (SELECT unnest(range(0, {reps + 1})) AS rep)),
idx0 AS (SELECT block, rep, n, number * block + off AS pos, CASE WHEN rep = 0 THEN number * block + off ELSE (((1103515245 * (1000 * rep + number) + 12345) % 2147483648) % n + off) % n END + 1 AS day_idx FROM (SELECT *, unnest(range(0, block)) AS off FROM bl)),
idx AS (SELECT block, rep, pos, day_idx FROM idx0 WHERE pos < n)"""


def _numbered(daily: DataFrame) -> DataFrame:
    """One row per day, numbered from 1."""
    from pyspark.sql import Window

    return daily.withColumn("day_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).cast("long"))


def _index(spark: SparkSession, daily: DataFrame, reps: int = BOOT_REPS) -> DataFrame:
    return resample.block_index(spark, daily.agg(F.count(F.lit(1)).alias("n")), reps, BLOCKS)


IC_DAYS = "days AS (SELECT date, rank_ic, CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS day_idx FROM daily WHERE rank_ic IS NOT NULL)"


@register("bootstrap_idx", f"{PREDS_SQL}, {IC_SQL}, {IC_DAYS}, {index_sql(10)} SELECT block, rep, pos, day_idx FROM idx")
def bootstrap_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, metrics.daily_ic(predictions(spark, sf_dir)).where("rank_ic IS NOT NULL"), 10)


CI = ["point", "low", "high", "se", "bias", "sign_flips"]


def ci_sql(statistics: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT block, rep, '{x}' AS statistic, {x} AS x FROM boot" for x in statistics)
    return f"""
bs AS ({long}),
ci AS (SELECT b.block, b.statistic, p.x AS point, quantile_cont(b.x, 0.025) AS low, quantile_cont(b.x, 0.975) AS high, stddev_samp(b.x) AS se, avg(b.x) - p.x AS bias, avg(CASE WHEN sign(b.x) <> sign(p.x) THEN 1.0 ELSE 0.0 END) AS sign_flips
  FROM bs b JOIN bs p ON b.block = p.block AND b.statistic = p.statistic AND p.rep = 0 WHERE b.rep > 0 GROUP BY b.block, b.statistic, p.x)"""


_ratio = lambda x, y: f"avg({x}) / nullif(stddev_samp({x}), 0) * {y}"
BOOT_SQL = f"""
sd1 AS (SELECT day_idx, rank_ic AS ic, ls_gross * 1e4 - 10 * ls_turnover AS ls, lo_gross * 1e4 - 10 * lo_turnover AS lo FROM days),
boot AS (SELECT block, rep, avg(ic) AS rank_ic, {_ratio('ic', '1.0')} AS icir, avg(ls) AS ls_net, {_ratio('ls', 'sqrt(252)')} AS ls_ir, avg(lo) AS lo_net, {_ratio('lo', 'sqrt(252)')} AS lo_ir FROM idx JOIN sd1 USING (day_idx) GROUP BY ALL)"""
BOTH_SERIES_SQL = f"""{HELD5}, {IC_SQL}, {LEGS_SQL.format(k='')}, {SERIES_SQL['ls'].format(k='').replace('series AS', 'ser_ls AS')}, {SERIES_SQL['lo'].format(k='', src='dense').replace('series AS', 'ser_lo AS')},
days AS (SELECT *, CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS day_idx FROM (SELECT d.date, d.rank_ic, a.gross AS ls_gross, a.turnover AS ls_turnover, b.gross AS lo_gross, b.turnover AS lo_turnover
  FROM daily d JOIN ser_ls a ON d.date = a.date JOIN ser_lo b ON d.date = b.date WHERE d.rank_ic IS NOT NULL AND a.turnover IS NOT NULL AND b.turnover IS NOT NULL))"""


def daily_series(preds: DataFrame) -> DataFrame:
    """(date, rank_ic, ls and lo gross and turnover): the days that the correlation and both portfolios have."""
    ranked = portfolio.dense_days(portfolio.ema(preds, 5))
    held = portfolio.hysteresis(ranked, 0.1, 0.2)
    sides = {"ls": portfolio.long_short(held), "lo": portfolio.long_only(ranked, held)}
    out = metrics.daily_ic(preds).where("rank_ic IS NOT NULL").select("date", "rank_ic")
    for k, series in sides.items():
        out = out.join(series.where("turnover IS NOT NULL").select("date", F.col("gross").alias(f"{k}_gross"), F.col("turnover").alias(f"{k}_turnover")), "date")
    return out


@register("bootstrap_ci", f"{BOTH_SERIES_SQL}, {index_sql()}, {BOOT_SQL}, {ci_sql(resample.STATISTICS)} SELECT block, statistic, {_r(CI)} FROM ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six statistics, four block lengths, 2000 repetitions; one index for all."""
    daily = _numbered(daily_series(predictions(spark, sf_dir))).withColumnRenamed("rank_ic", "ic").persist()  # a row per day
    boot = resample.statistics(_index(spark, daily), daily)
    return finished(_rounded(resample.intervals(boot), ["block", "statistic"], CI), daily)


IC2_SQL = IC_SQL.replace("ranked AS", "ranked2 AS").replace("FROM ranked", "FROM ranked2").replace("daily AS", "daily2 AS").replace("FROM preds", "FROM preds2")


@register("bootstrap_paired", f"{PREDS_SQL}, {preds_sql('RSV10', 'preds2')}, {IC_SQL.replace('daily AS', 'daily1 AS')}, {IC2_SQL}, daily AS (SELECT a.date, a.rank_ic - b.rank_ic AS rank_ic FROM daily1 a JOIN daily2 b USING (date)), {IC_DAYS}, {index_sql()}, boot AS (SELECT block, rep, avg(rank_ic) AS rank_ic FROM idx JOIN days USING (day_idx) GROUP BY ALL), {ci_sql(('rank_ic',))} SELECT block, statistic, {_r(CI)} FROM ci")
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two scores on the days that both have, resampled by one index."""
    wide = member_table(spark, sf_dir, ["ROC5", "RSV10"])
    one, two = (metrics.daily_ic(wide.withColumn("pred", F.col(m))) for m in ("ROC5", "RSV10"))
    both = one.select("date", F.col("rank_ic").alias("x")).join(two.select("date", F.col("rank_ic").alias("y")), "date").withColumn("rank_ic", F.col("x") - F.col("y")).where("rank_ic IS NOT NULL")
    daily = _numbered(both.select("date", "rank_ic")).persist()  # a row per day
    boot = _index(spark, daily).join(daily, "day_idx").groupBy("block", "rep").agg(F.avg("rank_ic").alias("rank_ic"))
    return finished(_rounded(resample.intervals(boot, ("rank_ic",)), ["block", "statistic"], CI), daily)


SHARES = ["up_t1", "dn_t2", "up_t2", "oneword"]


@register("limit_audit", f"""{PREDS_SQL}, {DECILE_SQL}, fl AS (SELECT instrument, date, NOT coalesce(lead(can_buy, 1) OVER i, false) AS u1, NOT coalesce(lead(can_sell, 2) OVER i, false) AS d2, NOT coalesce(lead(can_buy, 2) OVER i, false) AS u2, coalesce(lead(high = low, 1) OVER i, false) AS ow FROM flags WINDOW i AS (PARTITION BY instrument ORDER BY date)),
  s AS (SELECT decile, count(*) AS n, avg(CAST(u1 AS DOUBLE)) AS up_t1, avg(CAST(d2 AS DOUBLE)) AS dn_t2, avg(CAST(u2 AS DOUBLE)) AS up_t2, avg(CAST(ow AS DOUBLE)) AS oneword FROM dec JOIN fl USING (instrument, date) GROUP BY decile) SELECT decile, n, {_r(SHARES)} FROM s""")
def limit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = lab.diagnostics(lab.with_flags(panel(spark, sf_dir))).select("instrument", "date", "lim_up_t1", "lim_dn_t2", "lim_up_t2", "oneword_t1")
    return _rounded(audit.limit_shares(predictions(spark, sf_dir), flags), ["decile", "n"], SHARES)


def _avg_rank(x: str) -> str:
    return f"rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"


BOTH_SQL = f"""{BASE_SQL}, {preds_sql('RSV10')}, fac AS (SELECT instrument, date, {rolling_sql('ROC', 5)} AS factor FROM prep {FRAMES}),
both_ AS (SELECT p.*, f.factor FROM preds p JOIN fac f USING (instrument, date) WHERE factor IS NOT NULL),
z AS (SELECT *, (pred - avg(pred) OVER d) / nullif(stddev_pop(pred) OVER d, 0) AS pz, (factor - avg(factor) OVER d) / nullif(stddev_pop(factor) OVER d, 0) AS fz, {_avg_rank('pred')} AS rp, {_avg_rank('factor')} AS rf FROM both_ WINDOW d AS (PARTITION BY date)),
expo AS (SELECT date, count(*) AS n, avg(pz * fz) / avg(fz * fz) AS beta, corr(pred, factor) ^ 2 AS r2, corr(rp, rf) AS spearman FROM z GROUP BY date HAVING count(*) >= 20)"""
EXPO = ["beta", "r2", "spearman"]


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = scored(spark, sf_dir).select("instrument", "date", F.col("ROC5").alias("factor")).where("factor IS NOT NULL")
    return predictions(spark, sf_dir, "RSV10").join(factor, ["instrument", "date"])


@register("reversal_beta", f"{BOTH_SQL} SELECT {D}, n, {_r(EXPO)} FROM expo")
def reversal_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audit.exposure(_both(spark, sf_dir)), ["date", "n"], EXPO)


@register("orthogonalize", f"""{BOTH_SQL}, yb AS (SELECT year(date) AS y, sum(beta) AS s, count(beta) AS c FROM expo GROUP BY ALL), eb AS (SELECT y, sum(s) OVER b / sum(c) OVER b AS beta FROM yb WINDOW b AS (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  o AS (SELECT z.instrument, z.date, pz - beta * fz AS pred FROM z JOIN eb ON year(z.date) = y WHERE beta IS NOT NULL) SELECT instrument, {D}, {_r(['pred'])} FROM o""")
def orthogonalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _both(spark, sf_dir)
    return _rounded(audit.orthogonal(both, audit.earlier_beta(audit.exposure(both))), ["instrument", "date"], ["pred"])


MEMBERS = ["ROC5", "RSV10", "STD20", "VMA10"]
POOL_SQL = f"{BASE_SQL}, " + ", ".join(preds_sql(m, f"p_{m}") for m in MEMBERS) + ", wide AS (SELECT a.instrument, a.date, a.label_raw, a.pred AS ROC5, " + ", ".join(f"t_{m}.pred AS {m}" for m in MEMBERS[1:]) + " FROM p_ROC5 a " + " ".join(f"JOIN p_{m} t_{m} ON a.instrument = t_{m}.instrument AND a.date = t_{m}.date" for m in MEMBERS[1:]) + ")"
_pairs = [(a, b) for i, a in enumerate(MEMBERS) for b in MEMBERS[i + 1 :]]


@register("pool_corr", f"{POOL_SQL}, rk AS (SELECT *, " + ", ".join(f"{_avg_rank(m)} AS r_{m}" for m in MEMBERS) + " FROM (SELECT *, count(*) OVER (PARTITION BY date) AS nn FROM wide) WHERE nn >= 20), " + "pd AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, date, corr(r_{a}, r_{b}) AS x FROM rk GROUP BY date" for a, b in _pairs) + f") SELECT a, b, count(x) AS days, {R6.format('avg(x)')} AS rho FROM pd GROUP BY a, b")
def pool_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = member_table(spark, sf_dir, MEMBERS).dropna(subset=MEMBERS)
    return _rounded(audit.pool_correlation(wide, MEMBERS), ["a", "b", "days"], ["rho"])


def _strength_sql(src: str, pred: str, m: str, kind: str) -> str:
    return f"""SELECT '{m}' AS member, '{kind}' AS row_set, CAST(sum(n) AS BIGINT) AS n, {R6.format('avg(x)')} AS mean FROM (SELECT date, count(*) AS n, corr(rp, rl) AS x FROM (SELECT date, row_number() OVER (PARTITION BY date ORDER BY {pred}, instrument) AS rp, row_number() OVER (PARTITION BY date ORDER BY label_raw, instrument) AS rl FROM {src}) GROUP BY date HAVING count(*) >= 5)"""


@register("pool_own_vs_common", f"{POOL_SQL} " + " UNION ALL ".join(_strength_sql(s, p, m, k) for m in MEMBERS for s, p, k in ((f"p_{m}", "pred", "own"), ("wide", m, "common"))))
def pool_own_vs_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of each member on its own rows and on the rows that all have: one panel, both sets side by side."""
    wide = member_table(spark, sf_dir, MEMBERS)
    every = F.lit(True)
    for m in MEMBERS:
        every = every & F.col(m).isNotNull()
    member = F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.col(m).alias("pred")) for m in MEMBERS)))
    kinds = F.explode(F.when(F.col("every"), F.array(F.lit("own"), F.lit("common"))).otherwise(F.array(F.lit("own")))).alias("row_set")
    rows = wide.withColumn("every", every).select("instrument", "date", "label_raw", "every", member.alias("m")).select("instrument", "date", "label_raw", "m.*", kinds)
    daily = metrics.daily_ic(rows, ("member", "row_set", "date"))
    return _rounded(daily.groupBy("member", "row_set").agg(F.sum("n").alias("n"), F.avg("rank_ic").alias("mean")), ["member", "row_set", "n"], ["mean"])


FOLD_ARGS = {"val_days": 20, "embargo": 2, "min_history_years": 2, "min_train_days": 40, "min_test_days": 20}
FOLD_SQL = """
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS d FROM (SELECT DISTINCT date FROM bars)),
fy AS (SELECT CAST(year(date) AS BIGINT) AS test_year, min(d) AS test_start, max(d) AS test_end FROM cal GROUP BY ALL),
fo AS (SELECT test_year, test_start - 3 - 20 + 1 - 3 AS fit_end, test_start - 3 - 20 + 1 AS val_start, test_start - 3 AS val_end, test_start, test_end FROM fy WHERE test_year >= (SELECT min(test_year) + 2 FROM fy)),
folds AS (SELECT *, fit_end AS n_fit, CAST(20 AS BIGINT) AS n_val, test_end - test_start + 1 AS n_test FROM fo WHERE test_end - test_start + 1 >= 20 AND val_end >= 60 AND fit_end > 0)"""


@register("folds", f"WITH {BARS_SQL}, {FOLD_SQL} SELECT test_year, fit_end, val_start, val_end, test_start, test_end, n_fit, n_val, n_test FROM folds")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.folds(sources.weekly_bars(spark, sf_dir).select("date").distinct(), **FOLD_ARGS)


@register("manifest_resume", "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT CAST(c_custkey AS VARCHAR) AS ticker FROM customer LEFT JOIN o ON c_custkey = o_custkey WHERE NOT coalesce(n >= 10, false)")
def manifest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a universe, their orders as what was fetched: who is still to do."""
    orders = sources.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("ticker")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.to_date("o_orderdate")).alias("last_date"))
    manifest = orders.select("ticker", F.when(F.col("rows") >= 10, "ok").otherwise("partial").alias("status"), "rows", "last_date")
    universe = sources.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ticker"))
    return sources.still_to_do(universe, manifest)


@register("universe_union", "SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE)::VARCHAR AS quarter, CAST(o_custkey AS VARCHAR) AS ticker FROM orders")
def universe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the universe by quarter: the distinct union over the quarter grid."""
    orders = sources.table(spark, sf_dir, "orders")
    return orders.select(F.date_trunc("quarter", "o_orderdate").cast("date").cast("string").alias("quarter"), F.col("o_custkey").cast("string").alias("ticker")).distinct()


@register("ledger_explode", f"{PREDS_SQL}, {IC_SQL} SELECT CAST(year(date) AS BIGINT) AS test_year, CAST(row_number() OVER (PARTITION BY year(date) ORDER BY date) - 1 AS BIGINT) AS position, {D}, {_r(['rank_ic'])} FROM daily")
def ledger_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger line per year with its days as an array, made JSON, read again and unnested."""
    daily = metrics.daily_ic(predictions(spark, sf_dir)).select(F.year("date").cast("long").alias("test_year"), day().alias("date"), "rank_ic")
    line = daily.groupBy("test_year").agg(F.array_sort(F.collect_list(F.struct("date", "rank_ic"))).alias("results")).select(F.to_json(F.struct("test_year", "results")).alias("line"))
    schema = T.StructType([T.StructField("test_year", T.LongType()), T.StructField("results", T.ArrayType(T.StructType([T.StructField("date", T.StringType()), T.StructField("rank_ic", T.DoubleType())])))])
    read = line.select(F.from_json("line", schema).alias("l")).select("l.test_year", F.posexplode("l.results").alias("position", "r"))
    return read.select("test_year", F.col("position").cast("long").alias("position"), "r.date", r6(F.col("r.rank_ic")).alias("rank_ic"))


@register("bars_gated", f"WITH {BARS_SQL}, {PREP_SQL}, {FLAGS_SQL} SELECT CAST(year(date) AS BIGINT) AS year, count(*) AS n, sum(CASE WHEN can_buy THEN 1 ELSE 0 END)::BIGINT AS buyable, sum(CASE WHEN can_sell THEN 1 ELSE 0 END)::BIGINT AS sellable FROM flags GROUP BY ALL")
def bars_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.with_flags(panel(spark, sf_dir)).groupBy(F.year("date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if("can_buy").alias("buyable"), F.count_if("can_sell").alias("sellable"))


HORIZONS = (1, 5, 10)


def _horizon_sql() -> str:
    from .scores import labels_sql

    parts = []
    for h in HORIZONS:
        part = labels_sql("vwap", "entry", h)
        for name in ("rtn", "raw", "lab"):
            part = part.replace(f"{name} AS (", f"{name}{h} AS (").replace(f"FROM {name})", f"FROM {name}{h})")
        parts.append(part)
    score = f"sc AS (SELECT instrument, date, {rolling_sql('ROC', 5)} AS pred FROM prep {FRAMES})"
    ics = " UNION ALL ".join(f"SELECT CAST({h} AS BIGINT) AS horizon, date, corr(rp, rl) AS x FROM (SELECT l.date, row_number() OVER (PARTITION BY l.date ORDER BY pred, l.instrument) AS rp, row_number() OVER (PARTITION BY l.date ORDER BY label_raw, l.instrument) AS rl FROM lab{h} l JOIN sc ON sc.instrument = l.instrument AND sc.date = l.date WHERE label_raw IS NOT NULL AND pred IS NOT NULL) GROUP BY date HAVING count(*) >= 5" for h in HORIZONS)
    return f"WITH {BARS_SQL}, {PREP_SQL}, {FLAGS_SQL}, {', '.join(parts)}, {score}, ic AS ({ics}) SELECT horizon, count(x) AS days, {R6.format('avg(x)')} AS mean FROM ic GROUP BY horizon"


@register("horizon_sweep", _horizon_sql())
def horizon_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of one score with labels of several horizons; the panel is made once."""
    keep = ["open", "high", "low", "close", "vwap", "raw_close", "volume", "amount", "factor"]
    flagged = lab.with_flags(feat.features(panel(spark, sf_dir), ["ROC5"], keep)).persist()  # read once per horizon
    out = None
    for h in HORIZONS:
        one = lab.labels(flagged, "vwap", "entry", h).select("instrument", "date", F.col("ROC5").alias("pred"), "label_raw", F.lit(h).cast("long").alias("horizon"))
        out = one if out is None else out.unionByName(one)
    return finished(_rounded(metrics.daily_ic(out, ("horizon", "date")).groupBy("horizon").agg(F.count("rank_ic").alias("days"), F.avg("rank_ic").alias("mean")), ["horizon", "days"], ["mean"]), flagged)


@register("random_baseline", f"{PREDS_SQL.replace('f.pred, l.label_raw', 'CAST(md5(f.instrument || CAST(f.date AS VARCHAR)) AS VARCHAR) AS pred, l.label_raw')}, rr AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY pred, instrument) AS rp, row_number() OVER (PARTITION BY date ORDER BY label_raw, instrument) AS rl FROM preds), dd AS (SELECT date, corr(rp, rl) AS x FROM rr GROUP BY date HAVING count(*) >= 5) SELECT count(x) AS days, {R6.format('avg(x)')} AS mean FROM dd")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score without information: ranks of a hash of instrument and date."""
    from ..functions import first_rank

    preds = predictions(spark, sf_dir).withColumn("pred", F.md5(F.concat("instrument", F.col("date").cast("string")).cast("binary")))
    ranked = preds.withColumns({"rp": first_rank("pred", "date"), "rl": first_rank("label_raw", "date")})
    daily = ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), metrics.pearson("rp", "rl").alias("x")).where("n >= 5")
    return daily.agg(F.count("x").alias("days"), r6(F.avg("x")).alias("mean"))


@register("meta_features", f"{BASE_SQL}, {preds_sql('ROC5', 'pa')}, {preds_sql('RSV10', 'pb')}, m AS (SELECT a.instrument, a.date, a.pred AS a, b.pred AS b FROM pa a JOIN pb b ON a.instrument = b.instrument AND a.date = b.date) SELECT instrument, {D}, round(({_avg_rank('a')}) / count(*) OVER (PARTITION BY date) - 0.5, 6) + 0.0 AS a, round(({_avg_rank('b')}) / count(*) OVER (PARTITION BY date) - 0.5, 6) + 0.0 AS b FROM m")
def meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of a stacked model: centred average percent ranks of two scores on their common rows."""
    from pyspark.sql import Window

    from ..functions import average_rank

    wide = member_table(spark, sf_dir, ["ROC5", "RSV10"]).dropna(subset=["ROC5", "RSV10"])
    both = wide.select("instrument", "date", F.col("ROC5").alias("a"), F.col("RSV10").alias("b"))
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return both.select("instrument", day().alias("date"), *(r6(average_rank(c, "date") / n - 0.5).alias(c) for c in ("a", "b")))


@register("fold_summary", f"{PREDS_SQL}, {IC_SQL}, y AS (SELECT year(date) AS y, avg(rank_ic) AS x FROM daily GROUP BY ALL), s AS (SELECT count(*) AS folds, avg(x) AS mean, median(x) AS median, min(x) AS low, max(x) AS high, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS positive FROM y) SELECT folds, CAST(positive AS BIGINT) AS positive, {_r(['mean', 'median', 'low', 'high'])} FROM s")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over test years: mean, median, extremes and how many are positive."""
    year = metrics.daily_ic(predictions(spark, sf_dir)).groupBy(F.year("date").alias("y")).agg(F.avg("rank_ic").alias("x"))
    agg = year.agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("x") > 0).alias("positive"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.min("x").alias("low"), F.max("x").alias("high"))
    return _rounded(agg, ["folds", "positive"], ["mean", "median", "low", "high"])


SELF_SQL = f"{PREDS_SQL}, {preds_sql('RSV10', 'preds2')}, {IC_SQL.replace('daily AS', 'daily1 AS')}, {IC2_SQL}, y AS (SELECT CAST(year(date) AS BIGINT) AS test_year, avg(rank_ic) AS x FROM daily1 GROUP BY ALL), z AS (SELECT CAST(year(date) AS BIGINT) AS test_year, avg(rank_ic) AS x FROM daily2 GROUP BY ALL)"


@register("self_check", f"{SELF_SQL} SELECT y.test_year, coalesce(abs(round(y.x, 12) - y.x) <= 1e-9, false) AS agrees, coalesce(abs(z.x - y.x) <= 1e-9, false) AS old_agrees FROM y LEFT JOIN z ON y.test_year = z.test_year")
def self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly rank correlation made anew against the latest matching record of a ledger file, within 1e-9.

    The ledger has three records: an older one of another score, one of this score, and a newer one of another run, which
    must not be taken. The first is also held against what is made anew: it must not agree.
    """
    wide = member_table(spark, sf_dir, ["ROC5", "RSV10"])
    year = lambda m: metrics.daily_ic(wide.withColumn("pred", F.col(m))).groupBy(F.year("date").cast("long").alias("test_year")).agg(F.avg("rank_ic").alias("x"))
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    for at, tag, member in ((1, "main", "RSV10"), (2, "main", "ROC5"), (3, "other", "RSV10")):
        record = year(member).select(F.lit(at).cast("long").alias("at"), F.lit(tag).alias("tag"), "test_year", F.round("x", 12).alias("x"))
        sources.append_ledger(record, ["at", "tag"], path)
    ledger = sources.read_ledger(spark, path)
    made = year("ROC5")
    new = audit.self_check(made, sources.latest_records(ledger, {"tag": "main"}), ["test_year"], "x").select("test_year", "agrees")
    old = audit.self_check(made, sources.latest_records(ledger, {"tag": "main", "at": 1}), ["test_year"], "x").select("test_year", F.col("agrees").alias("old_agrees"))
    return new.join(old, "test_year")
