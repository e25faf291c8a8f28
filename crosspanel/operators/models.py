"""Walk-forward folds, linear models from distributed sums of products, and rules over validation curves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .daily import MIN_NAMES, correlation, ordinal
from .spans import Panel, Scored, over_days

ALPHAS = tuple(10.0**k for k in range(10))


def folds(dates: DataFrame, val_days: int = 120, embargo: int = 2, min_history_years: int = 2, min_train_days: int = 250, min_test_days: int = 60) -> DataFrame:
    """(test_year, fit_end, val_start, val_end, test_start, test_end, n_fit, n_val, n_test) as dense day numbers.

    Expanding folds: days before the test year less ``embargo``, of which the last ``val_days`` validate, less another
    embargo before them. ``dates`` has one row per trading day (a table of the calendar's size).
    """
    all_days = Window.partitionBy(F.lit(0))
    day = dates.select("date").distinct().withColumn("d", F.row_number().over(all_days.orderBy("date")).cast("long"))
    year = day.groupBy(F.year("date").cast("long").alias("test_year")).agg(F.min("d").alias("test_start"), F.max("d").alias("test_end"))
    f = year.withColumn("first_", F.min("test_year").over(all_days)).where(F.col("test_year") >= F.col("first_") + min_history_years)
    f = f.withColumn("val_end", F.col("test_start") - 1 - embargo).withColumn("val_start", F.col("val_end") - val_days + 1).withColumn("fit_end", F.col("val_start") - 1 - embargo)
    f = f.withColumns({"n_fit": F.col("fit_end"), "n_val": F.col("val_end") - F.col("val_start") + 1, "n_test": F.col("test_end") - F.col("test_start") + 1})
    ok = f.where((F.col("n_test") >= min_test_days) & (F.col("val_end") >= min_train_days + val_days) & (F.col("n_fit") > 0))
    return ok.select("test_year", "fit_end", "val_start", "val_end", "test_start", "test_end", "n_fit", "n_val", "n_test")


def gram(rows: DataFrame, columns: list[str], target: str, key: str) -> DataFrame:
    """(key, i, sums): for the numbers 1, columns and target of each row, the sums of products of the i-th with all; per
    value of ``key``.

    Each batch of rows is one product of matrices in its task, a partition sends one square per key, and these are
    added up. Missing columns count as 0; rows without a target take no part.
    """
    names = [*columns, target]
    size = len(names) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            z = np.column_stack([np.ones(batch.num_rows), *(np.nan_to_num(batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float)) for i in range(len(names)))])
            for k in np.unique(own).tolist():
                part = z[own == k]
                found[k] = found.get(k, 0.0) + part.T @ part
        for k, g in found.items():
            yield pa.record_batch([pa.array([k] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array(g.tolist())], ["key", "i", "sums"])

    each = rows.where(F.col(target).isNotNull()).select(F.col(key).cast("long").alias("key"), *names).mapInArrow(products, "key long, i int, sums array<double>")
    add = lambda s, x: F.zip_with(s, x, lambda u, v: u + v)
    return each.groupBy("key", "i").agg(F.collect_list("sums").alias("all")).select(F.col("key").alias(key), "i", F.aggregate("all", F.array_repeat(F.lit(0.0), size), add).alias("sums"))


def squares(sums: DataFrame, key: str) -> dict[int, np.ndarray]:
    """The collected squares of ``gram`` per key: their size depends on the number of columns only."""
    out: dict[int, list] = {}
    for r in sums.orderBy(key, "i").collect():
        out.setdefault(r[key], []).append(r["sums"])
    return {k: np.array(v) for k, v in out.items()}


@dataclass
class Moments:
    """What a linear fit needs of a sample: means, deviations, and products of standardised columns and centred target."""

    mean: np.ndarray
    sd: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    n: float

    @staticmethod
    def of(square: np.ndarray) -> Moments:
        """From sums: deviations under 1e-12 count as 1."""
        n, inner = square[0, 0], slice(1, -1)
        mean, target = square[0, inner] / n, square[0, -1] / n
        sd = np.sqrt(np.maximum(np.diag(square)[inner] / n - mean**2, 0.0))
        sd[sd < 1e-12] = 1.0
        xx = (square[inner, inner] - n * np.outer(mean, mean)) / np.outer(sd, sd)
        return Moments(mean, sd, xx, (square[inner, -1] - n * mean * target) / sd, n)


def ridge_weights(m: Moments, alphas: tuple[float, ...] = ALPHAS) -> np.ndarray:
    """(columns, alphas): one spectral decomposition serves all alphas; directions without spread get no weight."""
    value, basis = np.linalg.eigh(m.xx)
    along = basis.T @ m.xy
    shrunk = np.maximum(value, 0.0)[:, None] + np.asarray(alphas)
    least = shrunk.max(0) * np.finfo(float).eps * len(value)
    return basis @ np.where(shrunk > least, along[:, None] / np.where(shrunk > least, shrunk, 1.0), 0.0)


def elastic_weights(m: Moments, alpha: float, share: float, rounds: int = 1000, tolerance: float = 1e-8) -> np.ndarray:
    """Weights that minimise |y - Xw|^2 / 2n + alpha * (share * |w|_1 + (1 - share) / 2 * |w|^2), by coordinate descent on
    the products alone: the rows are not needed again."""
    w, pull = np.zeros(len(m.xy)), m.xy / m.n
    cov = m.xx / m.n
    for _ in range(rounds):
        change = 0.0
        for j in range(len(w)):
            left = pull[j] - cov[j] @ w + cov[j, j] * w[j]
            new = np.sign(left) * max(abs(left) - alpha * share, 0.0) / (cov[j, j] + alpha * (1 - share) or 1.0)
            change, w[j] = max(change, abs(new - w[j])), new
        if change < tolerance:
            break
    return w


def day_squares(panel: Panel, columns: list[str], fold_rows: list) -> dict[int, np.ndarray]:
    """The squares of ``gram`` per segment (see ``with_segment``) of all days of a panel's features as robust z: a square per day,
    added up by date."""
    width, ends = len(columns) + 2, [f["fit_end"] for f in fold_rows]

    def one(d: Scored) -> pa.RecordBatch:
        z = np.concatenate([np.ones((1, len(d.y))), d.x, d.y[None]])
        return pa.record_batch([pa.array([sum(d.day > e for e in ends)], pa.int64()), pa.array([d.day], pa.int64()), pa.array([(z @ z.T).tobytes()], pa.binary())], ["segment", "day", "square"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), float) for x in t.sort_by("day")["square"])
        return pa.table({"segment": t["segment"].slice(0, 1), "square": pa.array([total.tobytes()], pa.binary())})

    rows = over_days(panel, columns, one, "segment long, day long, square binary").groupBy("segment").applyInArrow(add, "segment long, square binary").collect()  # a square per fold
    return {r["segment"]: np.frombuffer(r["square"], float).reshape(width, width) for r in rows}


def linear_days(panel: Panel, columns: list[str], fold_rows: list, weigh=ridge_weights, choices: tuple = ALPHAS) -> DataFrame:
    """(test_year, choice, date, n, rank_ic) of the test days of every fold: ``linear_walk`` and its daily rank correlations,
    each worked out where the day's features are; the features are made twice, and no prediction is written."""
    fold_rows = sorted(fold_rows, key=lambda f: f["fit_end"])
    nets = [(f, w, shift) for f, (w, shift) in zip(fold_rows, _fitted(day_squares(panel, columns, fold_rows), len(columns), len(fold_rows), weigh, choices), strict=True)]

    def scores(d: Scored) -> pa.RecordBatch:
        rows, label = [], ordinal(d.raw)
        for f, w, shift in nets:
            part = next((p for p in ("val", "test") if f[f"{p}_start"] <= d.day <= f[f"{p}_end"]), None)
            if part and len(d.y) >= MIN_NAMES:
                rows += [(int(f["test_year"]), part, c, d.date, len(d.y), correlation(ordinal(p), label)) for c, p in enumerate((d.x.T @ w - shift).T)]
        columns_ = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
        return pa.record_batch([pa.array(list(x), k) for x, k in zip(columns_, kinds, strict=True)], ["test_year", "part", "c", "date", "n", "rank_ic"])

    one = over_days(panel, columns, scores, "test_year long, part string, c int, date int, n long, rank_ic double")
    mean = one.where("part = 'val'").groupBy("test_year", "c").agg(F.avg("rank_ic").alias("s"))
    best = mean.withColumn("k", F.row_number().over(Window.partitionBy("test_year").orderBy(F.col("s").desc_nulls_last(), "c"))).where("k = 1").select("test_year", "c")  # one row per fold
    choice = F.element_at(F.array(*(F.lit(float(c)) for c in choices)), F.col("c") + 1)
    return one.where("part = 'test'").join(F.broadcast(best), ["test_year", "c"]).select("test_year", choice.alias("choice"), F.date_from_unix_date("date").alias("date"), "n", "rank_ic")


def _fitted(by_segment: dict[int, np.ndarray], width: int, folds: int, weigh, choices: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weights (columns, choices) and shifts of every fold, from the squares of its segments."""
    total = np.zeros((width + 2, width + 2))
    for k in range(folds):
        total = total + by_segment.get(k, 0.0)
        m = Moments.of(total)
        w = weigh(m, choices) / m.sd[:, None]
        yield w, m.mean @ w


def with_segment(rows: DataFrame, fold_rows: list) -> DataFrame:
    """``rows`` (day) with segment: how many folds end their fit before the row's day. The rows of fold k's fit are those
    of segments 0 to k, as fits only grow."""
    out = F.lit(0).cast("long")
    for f in fold_rows:
        out = out + (F.col("day") > f["fit_end"]).cast("long")
    return rows.withColumn("segment", out)


def linear_walk(rows: DataFrame, columns: list[str], target: str, fold_rows: list, weigh=ridge_weights, choices: tuple = ALPHAS) -> DataFrame:
    """(test_year, choice, date, instrument, pred, label_raw) of every fold: fitted on its fit days, the choice (an alpha)
    made by mean daily rank correlation on its validation days, predicted on its test days.

    ``rows``: date, day (dense number), instrument, columns, target, label_raw; read twice: once for the sums of all
    folds, once for the predictions of all choices. ``weigh`` gives (columns, choices) from ``Moments``. Only sums
    reach the driver. Columns are standardised by the fit's own moments, the target is centred.
    """
    from .metrics import daily_ic

    fold_rows = sorted(fold_rows, key=lambda f: f["fit_end"])
    by_segment = squares(gram(with_segment(rows, fold_rows), columns, target, "segment"), "segment")
    fitted = _fitted(by_segment, len(columns), len(fold_rows), weigh, choices)
    nets = [(int(f["test_year"]), f["val_start"], f["val_end"], f["test_start"], f["test_end"], *w) for f, w in zip(fold_rows, fitted, strict=True)]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            day = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.nan_to_num(batch.column(4 + i).to_numpy(zero_copy_only=False).astype(float)) for i in range(len(columns))])
            for year, val_start, val_end, test_start, test_end, w, shift in nets:
                for part, low, high in (("val", val_start, val_end), ("test", test_start, test_end)):
                    at = np.flatnonzero((day >= low) & (day <= high))
                    if len(at):
                        preds = x[at] @ w - shift
                        own = batch.select([1, 2, 3]).take(pa.array(at))
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, preds.size + 1, preds.shape[1]), pa.int32()), pa.array(preds.ravel()))
                        yield pa.record_batch([pa.array([year] * len(at), pa.int64()), pa.array([part] * len(at)), *own.columns, lists], ["test_year", "part", "date", "instrument", "label_raw", "preds"])

    schema = "test_year long, part string, date date, instrument string, label_raw double, preds array<double>"
    each = rows.select("day", "date", "instrument", "label_raw", *columns).mapInArrow(predict, schema)
    one = each.select("test_year", "part", "date", "instrument", "label_raw", F.posexplode("preds").alias("c", "pred"))
    score = daily_ic(one.where("part = 'val'"), ("test_year", "c", "date")).groupBy("test_year", "c").agg(F.avg("rank_ic").alias("s"))
    first = Window.partitionBy("test_year").orderBy(F.col("s").desc_nulls_last(), "c")
    best = score.withColumn("k", F.row_number().over(first)).where("k = 1").select("test_year", F.col("c").alias("b"))  # one row per fold
    choice = F.element_at(F.array(*(F.lit(float(c)) for c in choices)), F.col("b") + 1)
    test = each.where("part = 'test'").join(F.broadcast(best), "test_year")
    return test.select("test_year", choice.alias("choice"), "date", "instrument", F.element_at("preds", F.col("b") + 1).alias("pred"), "label_raw")


def with_noise(curve: DataFrame) -> DataFrame:
    """``curve`` (fold, epoch, val) with points, sigma and top per fold: the noise is the deviation of first differences
    over sqrt(2), of under three points that of the values, of one 0."""
    own, order = Window.partitionBy("fold"), Window.partitionBy("fold").orderBy("epoch")
    df = curve.withColumn("diff_", F.col("val") - F.lag("val").over(order)).withColumn("points", F.count(F.lit(1)).over(own))
    sigma = F.when(F.col("points") < 3, F.stddev_pop("val").over(own)).otherwise(F.stddev_samp("diff_").over(own) / 2**0.5)
    return df.withColumn("sigma", sigma).withColumn("top", F.max("val").over(own)).drop("diff_")


def epoch_rules(curve: DataFrame, ks: tuple[int, ...] = (3, 5, 10), zs: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """(fold, rule, mode, epochs): the epochs that each rule chooses from (fold, epoch, val), epochs from 1 without gaps.

    argmax is the first maximum; plateau_med_z the middle of the epochs within z noise levels of the maximum (between
    two, the lower integer); wavg_best_k the k epochs up to the first maximum, wavg_run_k the last k, wavg_top_k the k
    best, the earlier of equals. mode says whether one epoch is used or the mean of the weights of all.
    """
    own = Window.partitionBy("fold")
    df = with_noise(curve).withColumn("place", F.row_number().over(own.orderBy(F.col("val").desc(), "epoch")))
    df = df.withColumn("best", F.min(F.when(F.col("place") == 1, F.col("epoch"))).over(own)).withColumn("last", F.max("epoch").over(own))
    e = F.col("epoch")
    chosen = {"argmax": e == F.col("best")}
    for k in ks:
        chosen |= {f"wavg_best_k{k}": (e <= F.col("best")) & (e > F.col("best") - k), f"wavg_run_k{k}": e > F.col("last") - k, f"wavg_top_k{k}": F.col("place") <= k}
    within = {f"plateau_med_z{z:g}": F.col("val") >= F.col("top") - z * F.col("sigma") for z in zs}
    sets = [F.array_sort(F.collect_list(F.when(c, e))).alias(n) for n, c in chosen.items()]
    middles = [F.array(F.floor(F.percentile(F.when(c, e), F.lit(0.5)))).alias(n) for n, c in within.items()]
    fold = df.groupBy("fold").agg(*sets, *middles)
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit("wavg" if n.startswith("wavg") else "single").alias("mode"), F.col(f"`{n}`").alias("epochs")) for n in [*chosen, *within]))
    return fold.select("fold", F.explode(rules).alias("r")).select("fold", "r.*")


def curve_shape(curve: DataFrame) -> DataFrame:
    """(fold, points, argmax, sigma, top, middle, peak_z): how far a curve's maximum stands out of its noise."""
    df = with_noise(curve).groupBy("fold").agg(F.first("points").alias("points"), F.min_by("epoch", F.struct(-F.col("val"), "epoch")).alias("argmax"), F.first("sigma").alias("sigma"), F.first("top").alias("top"), F.median("val").alias("middle"))
    return df.withColumn("peak_z", F.when(F.col("sigma") > 0, (F.col("top") - F.col("middle")) / F.col("sigma")))


def smoothed_stop(curve: DataFrame, patience: int = 3, least: float = 1e-5) -> DataFrame:
    """(fold, epoch, val, sma, best, stopped): mean of the latest three values, its best so far, and whether training
    would have stopped by then: ``patience`` epochs in a row without a value above the best before by ``least``."""
    order = Window.partitionBy("fold").orderBy("epoch")
    df = curve.withColumn("sma", F.avg("val").over(order.rowsBetween(-2, 0)))
    # the best before an epoch only moves by more than ``least``: the recursion runs over one fold's few epochs
    step = lambda s, x: F.when(x["sma"] > s["best"] + least, F.struct(x["sma"].alias("best"), F.lit(0).alias("bad"), s["at"].alias("at"))).otherwise(F.struct(s["best"].alias("best"), (s["bad"] + 1).alias("bad"), F.when(s["at"].isNull() & (s["bad"] + 1 >= patience), x["epoch"]).otherwise(s["at"]).alias("at")))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("at"))
    stop = df.groupBy("fold").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("epoch", "sma"))), start, step)["at"].alias("stop"))
    return df.join(stop, "fold").select("fold", "epoch", "val", "sma", F.max("sma").over(order).alias("best"), F.coalesce(F.col("epoch") >= F.col("stop"), F.lit(False)).alias("stopped"))


def seed_spread(scores: DataFrame) -> DataFrame:
    """(model, seeds, mean, seed_sd, fold_sd): over (model, seed, fold, x) the deviation of the seeds' means, and the
    deviation between seeds within a fold, pooled over folds."""
    seed = scores.groupBy("model", "seed").agg(F.avg("x").alias("m")).groupBy("model").agg(F.count(F.lit(1)).alias("seeds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("seed_sd"))
    within = scores.groupBy("model", "fold").agg(F.var_samp("x").alias("v")).groupBy("model").agg(F.sqrt(F.avg("v")).alias("fold_sd"))
    return seed.join(within, "model")


def model_difference(spread: DataFrame, one: str, two: str) -> DataFrame:
    """One row: difference of the means of two models of ``seed_spread`` in units of its standard error."""
    a, b = (spread.where(F.col("model") == m).select(*(F.col(c).alias(f"{c}_{k}") for c in ("mean", "seed_sd", "seeds"))) for k, m in enumerate((one, two)))
    se = F.sqrt(F.col("seed_sd_0") ** 2 / F.col("seeds_0") + F.col("seed_sd_1") ** 2 / F.col("seeds_1"))
    return a.crossJoin(b).select((F.col("mean_0") - F.col("mean_1")).alias("difference"), se.alias("se"), F.try_divide(F.col("mean_0") - F.col("mean_1"), se).alias("z"))  # one row each


def segment_losses(preds: DataFrame, fold_rows: list) -> DataFrame:
    """(segment, days, soft_ic, mse): mean over days of the plain correlation of pred and label, and of the mean squared
    difference of pred and label, per fit, validation and test segment of the first fold."""
    f = fold_rows[0]
    part = F.when(F.col("day") <= f["fit_end"], "fit").when(F.col("day").between(f["val_start"], f["val_end"]), "val").when(F.col("day").between(f["test_start"], f["test_end"]), "test")
    from .metrics import pearson

    day = preds.withColumn("segment", part).where("segment IS NOT NULL AND pred IS NOT NULL AND label IS NOT NULL").groupBy("segment", "date").agg(pearson("pred", "label").alias("ic"), F.avg((F.col("pred") - F.col("label")) ** 2).alias("mse"))
    return day.groupBy("segment").agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("soft_ic"), F.avg("mse").alias("mse"))


def tuned(scores: DataFrame) -> DataFrame:
    """(market, setting, folds, positive, val, test, chosen) from (setting, market, test_year, val, test): means over folds, folds
    with a positive test score, and whether the mean validation score chooses the setting in its market (ties by name).
    The test score takes no part in the choice."""
    each = scores.groupBy("market", "setting").agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("test") > 0).alias("positive"), F.avg("val").alias("val"), F.avg("test").alias("test"))
    first = Window.partitionBy("market").orderBy(F.col("val").desc_nulls_last(), "setting")  # a row per setting
    return each.withColumn("chosen", F.row_number().over(first) == 1)


#: Parameters of the boosted trees; ``overridden`` replaces some by name.
BOOSTED = {"trees": 50, "depth": 4, "seed": 0}


def overridden(known: dict, given: list[str]) -> dict:
    """``known`` with the values of ``given`` ("name=value"), each of the kind that it replaces; other names are errors."""
    out = dict(known)
    for pair in given:
        name, _, value = pair.partition("=")
        if name not in known:
            raise KeyError(f"no parameter {name}; known are {', '.join(known)}")
        kind = type(known[name])
        out[name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return out


def boosted_walk(rows: DataFrame, columns: list[str], target: str, fold_rows: list, trees: int = BOOSTED["trees"], depth: int = BOOSTED["depth"], seed: int = BOOSTED["seed"]) -> DataFrame:
    """(test_year, date, instrument, pred, label_raw) of gradient-boosted trees, one model per fold.

    Spark ML grows the trees on the executors; it stops early on the squared error of the validation days, not on their
    rank correlation, and grows by level, so results are comparable in kind and not in digits. Missing features are 0.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = rows.fillna(0.0, subset=columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="x_").transform(filled)
    out = None
    for f in fold_rows:
        fit, val = F.col("day") <= f["fit_end"], F.col("day").between(f["val_start"], f["val_end"])
        known = vectors.where((fit | val) & F.col(target).isNotNull()).withColumn("val_", val)
        model = GBTRegressor(featuresCol="x_", labelCol=target, predictionCol="pred", validationIndicatorCol="val_", maxIter=trees, maxDepth=depth, seed=seed).fit(known)
        test = model.transform(vectors.where(F.col("day").between(f["test_start"], f["test_end"]))).select(F.lit(f["test_year"]).cast("long").alias("test_year"), "date", "instrument", "pred", "label_raw")
        out = test if out is None else out.unionByName(test)
    return out
