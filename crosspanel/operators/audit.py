"""Audits of a prediction table: price limits, exposure to a factor, correlations within a pool of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import average_rank
from .metrics import pearson, with_decile
from .normalize import standard

LEAST = 20

def limit_shares(preds: DataFrame, flags: DataFrame) -> DataFrame:
    """(decile, n, up_t1, dn_t2, up_t2, oneword): shares of each decile that meet a price limit on coming rows."""
    both = with_decile(preds).join(flags, ["instrument", "date"], "left")
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return both.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), share("lim_up_t1").alias("up_t1"), share("lim_dn_t2").alias("dn_t2"), share("lim_up_t2").alias("up_t2"), share("oneword_t1").alias("oneword"))

def gated_spreads(preds: DataFrame, flags: DataFrame) -> DataFrame:
    """One row in bps: top decile, bottom decile as it is, without entries that a limit forbids, and without failed exits
    as well (which overstates it), with the spreads and what each filter changes.

    A short is opened at t + 1 unless the price is limit-down then (can_sell), and closed at t + 2 unless limit-up.
    """
    both = with_decile(preds).where(F.col("decile").isin(0, 9)).join(flags, ["instrument", "date"], "left")
    opened, closed = F.coalesce("short_open", F.lit(False)), F.coalesce("short_close", F.lit(False))
    low = F.col("decile") == 0
    legs = {"top": ~low, "raw": low, "entry": low & opened, "exits": low & opened & closed}
    day = both.groupBy("date").agg(*(F.avg(F.when(c, F.col("label_raw"))).alias(k) for k, c in legs.items()))
    mean = day.agg(*((F.avg(k) * 1e4).alias(k) for k in legs))
    spread = {f"spread_{k}": F.col("top") - F.col(k) for k in ("raw", "entry", "exits")}
    return mean.withColumns(spread).withColumn("entry_cost", F.col("spread_entry") - F.col("spread_raw"))


def exposure(both: DataFrame) -> DataFrame:
    """(date, n, beta, r2, spearman) of pred on factor for days of at least 20 names where both vary."""
    z = standard(standard(both, "pred", "pz"), "factor", "fz").withColumns({"rp": average_rank("pred", "date"), "rf": average_rank("factor", "date")})
    day = z.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pz") * F.col("fz")).alias("pf"), F.avg(F.col("fz") * F.col("fz")).alias("ff"), pearson("pred", "factor").alias("rho"), pearson("rp", "rf").alias("spearman"))
    return day.where((F.col("n") >= LEAST) & F.col("rho").isNotNull()).select("date", "n", (F.col("pf") / F.col("ff")).alias("beta"), (F.col("rho") * F.col("rho")).alias("r2"), "spearman")

def earlier_beta(daily: DataFrame) -> DataFrame:
    """(year, beta): mean beta of all days of earlier years; the first year has none."""
    year = daily.groupBy(F.year("date").cast("long").alias("year")).agg(F.sum("beta").alias("s"), F.count("beta").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # one row per year
    return year.select("year", (F.sum("s").over(w) / F.sum("n").over(w)).alias("beta"))

def yearly_exposure(daily: DataFrame) -> DataFrame:
    """(year, days, beta, r2, spearman): means of the daily exposure by year."""
    return daily.groupBy(F.year("date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.avg("beta").alias("beta"), F.avg("r2").alias("r2"), F.avg("spearman").alias("spearman"))


def reversal_variants(both: DataFrame, daily: DataFrame) -> DataFrame:
    """(kind, rows of ``both`` with another pred) side by side, on years that have an earlier one: the score's z (raw),
    without the factor by the beta of earlier years (nested) and by that of all years (leaky, an upper bound only), and
    the factor alone (factor)."""
    z = standard(standard(both, "pred", "pz"), "factor", "fz").withColumn("year", F.year("date").cast("long"))
    z = z.join(F.broadcast(earlier_beta(daily).where("beta IS NOT NULL")), "year").crossJoin(F.broadcast(daily.agg(F.avg("beta").alias("all_"))))  # a row per year, one row
    kinds = {"raw": F.col("pz"), "nested": F.col("pz") - F.col("beta") * F.col("fz"), "leaky": F.col("pz") - F.col("all_") * F.col("fz"), "factor": F.col("fz")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("pred")) for k, v in kinds.items())))
    return z.withColumn("k_", each).drop("pred", "pz", "fz", "beta", "all_", "year").select("*", "k_.*").drop("k_")


def dropped_years(both: DataFrame, daily: DataFrame) -> DataFrame:
    """Years of ``both`` that no earlier year gives a beta for."""
    have = earlier_beta(daily).where("beta IS NOT NULL").select("year")
    return both.select(F.year("date").cast("long").alias("year")).distinct().exceptAll(have)


def orthogonal(both: DataFrame, betas: DataFrame) -> DataFrame:
    """``both`` with pred replaced by pred_z - beta of earlier years * factor_z; rows of years without one go."""
    z = standard(standard(both, "pred", "pz"), "factor", "fz").withColumn("year", F.year("date").cast("long"))
    return z.join(betas.where("beta IS NOT NULL"), "year").withColumn("pred", F.col("pz") - F.col("beta") * F.col("fz")).drop("pz", "fz", "beta", "year")

def aligned(pool: dict[str, DataFrame], value: str = "pred") -> DataFrame:
    """(date, instrument, one column per member): the rows that all members have."""
    parts = [df.select("date", "instrument", F.col(value).alias(m)) for m, df in pool.items()]
    return reduce(lambda a, b: a.join(b, ["date", "instrument"]), parts)

def pool_rows(pool: DataFrame, members: list[str]) -> DataFrame:
    """One row: keys that any member has, keys that all have, and their share. ``pool``: date, instrument, members."""
    some = F.coalesce(*(F.col(m) for m in members)).isNotNull()
    every = F.lit(True)
    for m in members:
        every = every & F.col(m).isNotNull()
    return pool.agg(F.count_if(some).alias("n_union"), F.count_if(every).alias("n_common")).withColumn("share", F.col("n_common") / F.col("n_union"))


def off_diagonal(pairs: DataFrame) -> DataFrame:
    """One row: number, mean, least and largest of the correlations of different members."""
    return pairs.where("a <> b").agg(F.count("rho").alias("pairs"), F.avg("rho").alias("mean"), F.min("rho").alias("low"), F.max("rho").alias("high"))


def checked_pair(one: DataFrame, two: DataFrame) -> DataFrame:
    """(date, instrument, a, b): rows that both models have; an error if either has one that the other lacks."""
    both = one.select("date", "instrument", F.col("pred").alias("a"), F.lit(1).alias("l_")).join(two.select("date", "instrument", F.col("pred").alias("b"), F.lit(1).alias("r_")), ["date", "instrument"], "full")
    alone = F.col("l_").isNull() | F.col("r_").isNull()
    return both.withColumn("a", F.when(alone, F.raise_error(F.lit("the models' rows differ")).cast("double")).otherwise(F.col("a"))).drop("l_", "r_")


def pool_correlation(wide: DataFrame, members: list[str]) -> DataFrame:
    """(a, b, days, rho) for all pairs: mean over days (of at least 20 names) of the rank correlation.

    Ranks are projected once per member; all pairs are aggregates of one grouping by date.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    ranked = wide.withColumn("n_", n).where(F.col("n_") >= LEAST).withColumns({f"r_{m}": average_rank(m, "date") for m in members})
    pairs = [(a, b) for i, a in enumerate(members) for b in members[i + 1 :]]
    day = ranked.groupBy("date").agg(*(pearson(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in pairs))
    long = day.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("x")) for a, b in pairs))).alias("p")).select("p.*")
    return long.groupBy("a", "b").agg(F.count("x").alias("days"), F.avg("x").alias("rho"))


def pool_betas(wide: DataFrame, members: list[str], factor: str) -> DataFrame:
    """(member, date, beta) of every member on the factor for days of at least 20 names where both vary: all members are
    aggregates of one grouping by date."""
    n = F.count(F.lit(1))
    day = wide.groupBy("date").agg(n.alias("n"), F.stddev_pop(factor).alias("sf"), *(x for m in members for x in (F.stddev_pop(m).alias(f"s_{m}"), F.covar_pop(m, factor).alias(f"c_{m}"))))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.col(f"s_{m}").alias("s"), F.col(f"c_{m}").alias("c")) for m in members)))
    ok = day.where((F.col("n") >= LEAST) & (F.col("sf") > 1e-12)).select("date", "sf", each.alias("x")).select("date", "sf", "x.*").where("s > 1e-12")
    return ok.select("member", "date", (F.col("c") / (F.col("s") * F.col("sf"))).alias("beta"))


def pool_orthogonal(wide: DataFrame, members: list[str], factor: str) -> DataFrame:
    """``wide`` (date, instrument, members, factor) with every member as its day's z less the factor's z times the member's
    mean beta of earlier years; rows of years that have no earlier one go."""
    year = pool_betas(wide, members, factor).groupBy("member", F.year("date").cast("long").alias("year")).agg(F.sum("beta").alias("s"), F.count("beta").alias("n"))
    before = Window.partitionBy("member").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # a row per member and year
    past = year.select("member", "year", (F.sum("s").over(before) / F.sum("n").over(before)).alias("beta"))
    betas = past.groupBy("year").pivot("member", members).agg(F.first("beta")).select("year", *(F.col(m).alias(f"b_{m}") for m in members)).dropna()
    z = wide
    for c in (*members, factor):
        z = standard(z, c, f"z_{c}")
    z = z.withColumn("year", F.year("date").cast("long")).join(F.broadcast(betas), "year")  # a row per year
    return z.withColumns({m: F.col(f"z_{m}") - F.col(f"b_{m}") * F.col(f"z_{factor}") for m in members}).drop("year", *(f"z_{c}" for c in (*members, factor)), *(f"b_{m}" for m in members))


def pool_matrices(wide: DataFrame, members: list[str], factor: str) -> DataFrame:
    """(kind, a, b, days, rho) for all pairs: of the scores on all days (raw), on the days that the orthogonalised ones have
    (raw_same), and of the scores without the factor (orthogonal)."""
    left = pool_orthogonal(wide, members, factor)
    same = wide.join(left.select("date").distinct(), "date", "left_semi")
    kinds = {"raw": wide, "raw_same": same, "orthogonal": left}
    each = [pool_correlation(df.select("date", "instrument", *members), members).withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b), each).select("kind", "a", "b", "days", "rho")


def sign_test(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, wins, p) from (keys, one, two), a row per fold: folds that differ, those in which the first is larger, and
    the two-sided exact probability of so uneven a count: 2 * P(X <= min(wins, n - wins)) for n fair tosses, at most 1."""
    folds = pairs.where("one <> two").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("one") > F.col("two")).alias("wins"))
    few = F.least("wins", F.col("n") - F.col("wins"))
    # the terms C(n, i) / 2^n follow from each other: no factorial grows
    start = F.struct(F.pow(F.lit(0.5), F.col("n")).alias("term"), F.pow(F.lit(0.5), F.col("n")).alias("total"))

    def step(s, i):
        term = s["term"] * (F.col("n") - i + 1) / i
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    tail = F.aggregate(F.when(few > 0, F.sequence(F.lit(1).cast("long"), few)).otherwise(F.array().cast("array<bigint>")), start, step)["total"]
    return folds.select(*keys, "n", "wins", F.least(F.lit(1.0), 2 * tail).alias("p"))


def self_check(made: DataFrame, logged: DataFrame, keys: list[str], value: str, least: float = 1e-9) -> DataFrame:
    """(keys, made, logged, agrees): values made anew against those on record; a value on one side only does not agree."""
    both = made.select(*keys, F.col(value).alias("made")).join(logged.select(*keys, F.col(value).alias("logged")), keys, "full")
    return both.withColumn("agrees", F.coalesce(F.abs(F.col("made") - F.col("logged")) <= least, F.lit(False)))
