"""Queries against DuckDB on the smallest tables, and properties of the operators."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from crosspanel import sources
from crosspanel.operators import features, labels, metrics, models, normalize, portfolio
from crosspanel.plans import catalogue, panel, scores

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


#: Minutes on any table: its parts are tested below, and all of it against DuckDB where queries are checked.
SLOW = {"ridge_normal_eq"}


@pytest.mark.parametrize("name", [n for n in catalogue.ORACLE_SQL if n not in SLOW])
def test_oracle(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(repr([None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def series(spark, values, names=1):
    return spark.createDataFrame([(f"{k:06d}", f"2000-01-{i + 1:02d}", float(v)) for k in range(names) for i, v in enumerate(values)], "instrument string, date string, pred double").withColumn("date", F.col("date").cast("date"))


def test_feature_names():
    assert len(features.FEATURES) == len(set(features.FEATURES)) == 158


def test_flat_window_has_no_fit(spark):
    bars = spark.createDataFrame([("000001", f"2000-01-{i + 1:02d}", 5.0, 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(8)], "instrument string, date string, open double, high double, low double, close double, vwap double, volume double").withColumn("date", F.col("date").cast("date"))
    r = features.features(bars, ["RSQR5", "CORR5", "CORD5", "IMAX5", "MA5", "CNTP5"]).orderBy("date").collect()
    assert r[3]["MA5"] is None and r[4]["MA5"] == 1.0
    assert r[4]["RSQR5"] == 0.0 and r[4]["CORR5"] is None and r[7]["CORD5"] is None
    assert r[4]["IMAX5"] == 0.0 and r[4]["CNTP5"] == 0.0


def test_missing_prices_stay_missing(spark):
    bars = spark.createDataFrame([("000001", "2000-01-01", None, 5.0, 4.0, 4.5, 4.5, 1.0)], "instrument string, date string, open double, high double, low double, close double, vwap double, volume double").withColumn("date", F.col("date").cast("date"))
    r = features.features(bars, ["KUP", "KUP2", "HIGH0"]).first()
    assert r["KUP"] is None and r["KUP2"] is None and r["HIGH0"] == pytest.approx(5 / 4.5)


def test_ema_is_pandas_ewm(spark):
    import pandas as pd

    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    got = [r.pred for r in portfolio.ema(series(spark, x), 5).orderBy("date").collect()]
    assert got == pytest.approx(pd.Series(x).ewm(span=5, adjust=False).mean().tolist())
    assert [r.pred for r in portfolio.ema(series(spark, x), 1).orderBy("date").collect()] == x


def test_robust_z_without_spread(spark):
    df = spark.createDataFrame([("a", "2000-01-01", 1.0), ("b", "2000-01-01", 1.0), ("c", "2000-01-01", 1.0), ("d", "2000-01-01", 9.0), ("e", "2000-01-01", None)], "instrument string, date string, x double")
    got = {r.instrument: r.z for r in normalize.robust_z(df, {"x": "z"}).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 0.0, "d": 3.0, "e": None}


def test_hysteresis_against_a_loop(spark):
    preds = scores.predictions(spark, "/root/testdata/sf0.01")
    ranked = portfolio.dense_days(portfolio.ema(preds, 5)).where("day_idx <= 60").persist()
    held = {(r.side, r.day_idx, r.instrument) for r in portfolio.hysteresis(ranked, 0.1, 0.3).collect()}
    rows = {}
    for r in ranked.collect():
        rows.setdefault(r.day_idx, []).append((r.pred, r.instrument))
    want, before = set(), {"long": set(), "short": set()}
    for d in sorted(rows):
        order, n = sorted(rows[d]), len(rows[d])
        pct = {i: (k + 1) / n for k, (_, i) in enumerate(order)}
        for side in before:
            x = pct if side == "long" else {i: 1 - p for i, p in pct.items()}
            before[side] = {i for i, p in x.items() if p >= 1 - 0.1 or (p >= 1 - 0.3 and i in before[side])}
            want |= {(side, d, i) for i in before[side]}
    assert held == want


def test_folds_do_not_overlap(spark):
    days = spark.sql("SELECT explode(sequence(date'2000-01-01', date'2004-12-31', interval 1 day)) AS date")
    got = models.folds(days).orderBy("test_year").collect()
    assert [r.test_year for r in got] == [2002, 2003, 2004]
    for r in got:
        assert r.fit_end + 3 == r.val_start <= r.val_end == r.test_start - 3 and r.n_val == 120


def test_permuted_labels_have_no_signal(spark):
    from crosspanel.operators import resample

    preds = scores.predictions(spark, "/root/testdata/sf0.01").persist()
    shuffled = resample.permuted(preds, 1).join(preds.select("date", "instrument", "pred"), ["date", "instrument"])
    assert abs(metrics.ic_summary(metrics.daily_ic(shuffled)).first()["t"]) < 4
    assert shuffled.agg(F.sum("label_raw")).first()[0] == pytest.approx(preds.agg(F.sum("label_raw")).first()[0])


def test_full_gate_leaves_nothing_untradeable(spark):
    df = labels.diagnostics(labels.labels(labels.with_flags(panel.panel(spark, SF)), "vwap", "full")).where("label_raw IS NOT NULL")
    assert df.where("lim_up_t1 OR lim_dn_t2").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "u.txt").write_text("AAA # first\n\n# none\n bbb\nAAA\n")
    assert {r.symbol for r in sources.read_universe(spark, str(tmp_path / "u.txt")).collect()} == {"AAA", "bbb"}
    old = spark.createDataFrame([("A", "ok", 5, None), ("B", "fail", None, None)], sources.MANIFEST)
    new = spark.createDataFrame([("B", "ok", 7, None)], sources.MANIFEST)
    sources.write_manifest(sources.upsert_manifest(old, new), str(tmp_path / "m"))
    again = sources.read_manifest(spark, str(tmp_path / "m"))
    assert {(r.ticker, r.status, r.rows) for r in again.collect()} == {("A", "ok", 5), ("B", "ok", 7)}
    wide = spark.createDataFrame([("2000-01-03", 1.0, 2.0, None)], "`d` string, `open|A` double, `close|A` double, `close|B` double")
    assert [tuple(r) for r in sources.unpivot_batch(wide, "d", ["open", "close"]).collect()] == [("A", "2000-01-03", 1.0, 2.0)]
    rows = spark.createDataFrame([("x", 2001, 0.1), ("x", 2002, 0.2)], "model string, test_year int, ic double")
    sources.append_ledger(rows, ["model"], str(tmp_path / "l"))
    assert [(r.model, r.test_year, r.ic) for r in sources.read_ledger(spark, str(tmp_path / "l")).orderBy("test_year").collect()] == [("x", 2001, 0.1), ("x", 2002, 0.2)]


def test_streamed_bars_equal_batch(spark, tmp_path):
    from crosspanel import streaming

    events = sources.table(spark, SF, "events")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed_bars(streaming.event_stream(spark, str(tmp_path / "in"), events.schema), late="60 days")
    q = streaming.write_bars(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    closed = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    batch = sources.daily_bars(spark, SF).select(*closed.columns)
    assert closed.exceptAll(batch).count() == 0


def test_linear_models(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + [3, 0, -1]
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    df = spark.createDataFrame([(int(i % 2), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, c double, y double").repartition(3)
    both = models.squares(models.gram(df, ["a", "b", "c"], "y", "k"), "k")
    z = np.column_stack([np.ones(200), x, y])
    assert both[0] + both[1] == pytest.approx(z.T @ z)
    m = models.Moments.of(both[0] + both[1])
    own, centred = (x - x.mean(0)) / x.std(0), y - y.mean()
    w = models.ridge_weights(m, (0.0, 10.0, 1e4))
    for k, alpha in enumerate((0.0, 10.0, 1e4)):
        assert w[:, k] == pytest.approx(np.linalg.solve(own.T @ own + alpha * np.eye(3), own.T @ centred))
    e = models.elastic_weights(m, 0.1, 0.5)
    left = own.T @ (centred - own @ e) / 200 - 0.05 * e
    assert all(abs(g - 0.05 * np.sign(v)) < 1e-6 if v else abs(g) <= 0.05 + 1e-6 for g, v in zip(left, e, strict=True))
    flat = models.Moments.of(np.array([[4.0, 8.0, 4.0], [8.0, 16.0, 8.0], [4.0, 8.0, 6.0]]))
    assert models.ridge_weights(flat, (0.0,)) == pytest.approx(0.0)  # a constant column


def test_linear_walk_chooses_by_validation(spark):
    rows = spark.range(4000).selectExpr("CAST(id % 40 AS STRING) AS instrument", "id div 40 + 1 AS day", "date_add(date'2000-01-01', CAST(id div 40 AS INT)) AS date", "CAST((id * 7919) % 101 AS DOUBLE) AS a", "CAST((id * 104729) % 97 AS DOUBLE) AS b")
    rows = rows.selectExpr("*", "a - 2 * b AS label", "a - 2 * b AS label_raw")
    fold_rows = [{"test_year": 1, "fit_end": 30, "val_start": 33, "val_end": 40, "test_start": 43, "test_end": 60}, {"test_year": 2, "fit_end": 60, "val_start": 63, "val_end": 70, "test_start": 73, "test_end": 100}]
    got = models.linear_walk(rows, ["a", "b"], "label", fold_rows).persist()
    assert got.groupBy("test_year").count().orderBy("test_year").collect() == [(1, 18 * 40), (2, 28 * 40)]
    assert metrics.daily_ic(got, ("test_year", "date")).agg(F.min("rank_ic")).first()[0] > 0.99


def chosen(curve):
    """The 13 rules by hand."""
    import numpy as np

    c = np.array(curve)
    noise = (np.std(c) if len(c) > 1 else 0.0) if len(c) < 3 else np.std(np.diff(c), ddof=1) / 2**0.5
    best, n = int(np.argmax(c)) + 1, len(c)
    out = {"argmax": [best]}
    for k in (3, 5, 10):
        out[f"wavg_best_k{k}"] = [e for e in range(1, n + 1) if best - k < e <= best]
        out[f"wavg_run_k{k}"] = [e for e in range(1, n + 1) if e > n - k]
        out[f"wavg_top_k{k}"] = sorted(e + 1 for e in sorted(range(n), key=lambda e: (-c[e], e))[:k])
    for z in (0.5, 1, 2):
        out[f"plateau_med_z{z:g}"] = [int(np.median([e + 1 for e in range(n) if c[e] >= c.max() - z * noise]))]
    return out


def test_epoch_rules(spark):
    curves = {1: [0.1, 0.3, 0.2, 0.3, 0.25, 0.1], 2: [0.5], 3: [0.1, 0.2], 4: [0.01 * ((i * 7) % 13) for i in range(14)]}
    df = spark.createDataFrame([(f, e + 1, v) for f, c in curves.items() for e, v in enumerate(c)], "fold long, epoch long, val double")
    got = {(r.fold, r.rule): list(r.epochs) for r in models.epoch_rules(df).collect()}
    assert got == {(f, rule): epochs for f, c in curves.items() for rule, epochs in chosen(c).items()}
    stop = {(r.fold, r.epoch): r.stopped for r in models.smoothed_stop(df).collect()}
    assert not stop[2, 1] and not stop[4, 1]


def test_parameters_by_name():
    assert models.overridden(models.BOOSTED, ["trees=7"]) == models.BOOSTED | {"trees": 7}
    with pytest.raises(KeyError):
        models.overridden(models.BOOSTED, ["leaves=7"])


def test_repeated_keys_are_an_error(spark):
    from crosspanel.functions import unique_by

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    assert unique_by(df, "k").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        unique_by(df.union(df.limit(1)), "k").collect()
    one = spark.createDataFrame([("2000-01-01", "a", 1.0)], "date string, instrument string, pred double")
    from crosspanel.operators import audit

    with pytest.raises(Exception, match="rows differ"):
        audit.checked_pair(one, one.withColumn("instrument", F.lit("b"))).collect()


def test_panel_files(spark, tmp_path):
    for name in ("AAA", "BBB", "CCC"):
        spark.createDataFrame([("2000-01-03", 1.0), (None, 2.0), ("2000-01-03", 3.0), ("2000-01-04", float("nan"))], "day string, close double").coalesce(1).write.parquet(str(tmp_path / "raw" / name))
        next((tmp_path / "raw" / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    files = str(tmp_path / "*.parquet")
    bars = sources.read_bars(spark, files, columns={"day": "date"}).collect()
    assert sorted((r.instrument, str(r.date), r.close) for r in bars) == [(n, "2000-01-03", 1.0) for n in ("AAA", "BBB", "CCC")]
    assert {r.instrument for r in sources.first_files(spark, files, 2, ("CCC",)).collect()} == {"AAA", "CCC"}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "DDD.parquet").write_bytes(b"not parquet")
    for f in tmp_path.glob("*.parquet"):
        (tmp_path / "bad" / f.name).write_bytes(f.read_bytes())
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        assert spark.read.schema("day string, close double").parquet(str(tmp_path / "bad")).count() == 12
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    sources.write_panel(spark.createDataFrame(bars), str(tmp_path / "panel"), "instrument")
    sources.write_panel(spark.createDataFrame(bars[:1]), str(tmp_path / "panel"), "instrument")
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 1
    preds = spark.createDataFrame([("2000-01-03", "AAA", 1)], "date string, instrument string, pred int")
    preds.write.parquet(str(tmp_path / "m1"))
    preds.withColumn("instrument", F.lit("BBB")).write.parquet(str(tmp_path / "m2"))
    pool = sources.read_members(spark, {"one": str(tmp_path / "m1"), "two": str(tmp_path / "m2"), "none": str(tmp_path / "m3")})
    assert sorted((r.instrument, r.one, r.two) for r in pool.collect()) == [("AAA", 1.0, None), ("BBB", None, 1.0)]
    sources.write_document(preds, str(tmp_path / "doc"))
    assert [r.value for r in spark.read.text(str(tmp_path / "doc")).collect()] == ['{"rows":[{"date":"2000-01-03","instrument":"AAA","pred":1}]}']


def test_boosted_trees_find_a_step(spark):
    rows = spark.range(600).selectExpr("CAST(id % 20 AS STRING) AS instrument", "id div 20 + 1 AS day", "date_add(date'2000-01-01', CAST(id div 20 AS INT)) AS date", "CAST((id * 7919) % 100 AS DOUBLE) AS a", "CASE WHEN id % 50 = 0 THEN NULL ELSE 1.0 END AS b")
    rows = rows.selectExpr("*", "CASE WHEN a > 50 THEN 1.0 ELSE -1.0 END AS label", "CASE WHEN a > 50 THEN 1.0 ELSE -1.0 END AS label_raw")
    fold = {"test_year": 2000, "fit_end": 18, "val_start": 20, "val_end": 23, "test_start": 25, "test_end": 30}
    got = models.boosted_walk(rows, ["a", "b"], "label", [fold], trees=3, depth=2).collect()
    assert len(got) == 120 and all((r.pred > 0) == (r.label_raw > 0) for r in got)
