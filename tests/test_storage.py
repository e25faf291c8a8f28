"""Stored panels, files that fail alone, tables replaced in one step, and the audits that came with them."""

import datetime
import math
import shutil

import pytest
from pyspark.sql import functions as F

from crosspanel import sources
from crosspanel.operators import audit, features as feat, resample, stacking
from crosspanel.plans import audits
from crosspanel.sources import files, store


def test_stored_panel_is_pruned_and_needs_no_exchange(spark, tmp_path):
    days = [datetime.date(y, 3, d) for y in (2001, 2002, 2003) for d in range(1, 11)]
    rows = spark.createDataFrame([(f"i{k}", d, float(k * d.day)) for k in range(9) for d in days], "instrument string, date date, x double")
    store.store_panel(rows, "panel_test", 3, str(tmp_path / "p"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        one = store.load_years(spark, "panel_test", 2002, 2002)
        from pyspark.sql import Window

        summed = one.withColumn("s", F.sum("x").over(Window.partitionBy("instrument").orderBy("date")))
        both = summed.join(store.load_years(spark, "panel_test", 2002, 2002).groupBy("instrument").agg(F.max("x").alias("m")), "instrument")
        assert both.count() == 90 and {r.date.year for r in both.select("date").collect()} == {2002}
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(year" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert store.load_years(spark, "panel_test", columns=["x"]).columns == ["x"] and store.load_years(spark, "panel_test").count() == 270


def test_stored_follows_its_input(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([("a", datetime.date(2001, 1, len(made)))], "instrument string, date date")

    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    one = store.stored(spark, str(tmp_path), "t", "x", build)
    assert store.stored(spark, str(tmp_path), "t", "x", build) == one and len(made) == 1
    spark.range(4).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    two = store.stored(spark, str(tmp_path), "t", "x", build)
    assert two != one and len(made) == 2
    shutil.rmtree(store._built[spark.sparkContext.applicationId, two].removeprefix("file:"))
    assert store.stored(spark, str(tmp_path), "t", "x", build) == two and len(made) == 3 and store.load_years(spark, two).count() == 1


def pool(spark, tmp_path):
    good = spark.createDataFrame([("2000-01-03", "AAA", 1.5), ("2000-01-04", "BBB", None)], "date string, instrument string, pred double")
    good.coalesce(1).write.parquet(str(tmp_path / "good"))
    good.drop("pred").coalesce(1).write.parquet(str(tmp_path / "lacks"))
    good.withColumn("date", F.lit("never")).coalesce(1).write.parquet(str(tmp_path / "odd"))
    good.limit(0).coalesce(1).write.parquet(str(tmp_path / "empty"))
    (tmp_path / "broken").mkdir()
    whole = next((tmp_path / "good").glob("*.parquet")).read_bytes()
    (tmp_path / "broken" / "part.parquet").write_bytes(whole[: len(whole) // 2])
    return {n: str(tmp_path / n) for n in ("good", "lacks", "odd", "empty", "broken", "gone")}


def test_files_fail_alone(spark, tmp_path):
    read = files.read_pool(spark, pool(spark, tmp_path))
    found = {r.name: (r.status, r.rows) for r in files.report_of(read).collect()}
    assert found == {"good": ("ok", 2), "lacks": ("failed", None), "odd": ("failed", None), "empty": ("ok", 0), "broken": ("failed", None), "gone": ("missing", None)}
    errors = {r.name: r.error for r in files.report_of(read).collect()}
    assert "pred" in errors["lacks"] and errors["broken"] and errors["good"] is None
    assert [(r.name, str(r.date), r.instrument, r.pred) for r in files.rows_of(read).orderBy("place").collect()] == [("good", "2000-01-03", "AAA", 1.5), ("good", "2000-01-04", "BBB", None)]


def test_members_with_faults_are_left_out(spark, tmp_path):
    wide = sources.read_members(spark, pool(spark, tmp_path))
    assert wide.columns == ["date", "instrument", "good", "empty"] and wide.count() == 2
    assert sources.read_members(spark, {"gone": str(tmp_path / "nothing")}).collect() == []


def test_files_of_a_folder(spark, tmp_path):
    for n in ("x", "y"):
        spark.createDataFrame([(1, n)], "k long, s string").coalesce(1).write.parquet(str(tmp_path / n))
        next((tmp_path / n).glob("*.parquet")).rename(tmp_path / f"{n}.parquet")
    read = files.read_each(files.files_of(spark, str(tmp_path / "*.parquet")), {"key": "long", "text": "string"}, {"key": "k", "text": "s"})
    assert {(r.name, r.key, r.text) for r in files.rows_of(read).collect()} == {("x", 1, "x"), ("y", 1, "y")}


def test_a_failed_job_leaves_the_old_table(spark, tmp_path):
    old = spark.range(5).withColumn("g", F.col("id") % 2)
    bad = spark.range(9).withColumn("g", F.when(F.col("id") == 7, F.raise_error(F.lit("stopped")).cast("long")).otherwise(1))
    for write, read in ((files.replace_table, lambda p: files.read_table(spark, p)), (sources.write_panel, spark.read.parquet)):
        path = str(tmp_path / write.__name__)
        write(old, path)
        with pytest.raises(Exception, match="stopped"):
            write(bad, path)
        assert read(path).count() == 5
        write(read(path).where("id < 3"), path)  # reads what it replaces
        assert read(path).count() == 3
        assert not list(tmp_path.glob(f"{write.__name__}.*"))


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, path)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    files.upsert_table(rows(("a", 1), ("b", 2)), path, ["k"])
    began = files.read_table(spark, path)
    files.upsert_table(rows(("b", 3), ("c", 4)), path, ["k"])
    assert sorted(map(tuple, files.read_table(spark, path).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert began.count() == 2  # a reader of the version before
    files.upsert_table(rows(("a", 9)), path, ["k"])
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2


def test_manifest_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "m")
    make = lambda *x: spark.createDataFrame([(t, s, 1, None) for t, s in x], sources.MANIFEST)
    sources.write_manifest(make(("a", "ok"), ("b", "failed")), path)
    sources.write_manifest(sources.upsert_manifest(sources.read_manifest(spark, path), make(("b", "ok"))), path)
    assert sorted((r.ticker, r.status) for r in sources.read_manifest(spark, path).collect()) == [("a", "ok"), ("b", "ok")]


def test_first_row_of_the_file_stays(spark, tmp_path):
    data = [("2000-01-03", 9.0, 1), ("2000-01-03", 1.0, 2), ("2000-01-04", None, 3), ("2000-01-04", 5.0, 4), ("2000-01-04", 4.0, 5)]
    spark.createDataFrame(data, "date string, close double, n long").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "A.parquet")
    assert sorted((str(r.date), r.close, r.n) for r in sources.read_bars(spark, str(tmp_path / "A.parquet")).collect()) == [("2000-01-03", 9.0, 1), ("2000-01-04", 5.0, 4)]


def test_numbers_and_names_of_runs(spark):
    texts = ["1e5", "5.", " 12 ", "-.5", "5%", "12K", "1,000", "", "x", "1d", "2f", None, "\t7\n"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sources.parsed_number(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [1e5, 5.0, 12.0, -0.5, None, None, None, None, None, None, None, None, 7.0]
    assert spark.range(1).select(sources.number_with_unit(F.lit("1,234.5K")).alias("v")).first().v == 1234500.0
    names = spark.createDataFrame([("a/fold2020_epsel_s_seed0.pt",), ("fold2021_seed12.pt",), ("fold2021_s3.pt",)], "f string").select(*(c.alias(k) for k, c in sources.run_of(F.col("f")).items()))
    assert [tuple(r) for r in names.collect()] == [(2020, "_epsel_s", 0), (2021, "", 12), (None, None, None)]


def test_numbers_with_units_are_read(spark):
    """The query reads amounts with separators and units, and prices, not only plain numbers (F1)."""
    texts = [" $1,234.50", "7k", "7 M", "7%", "n/a", "-7B", "1e2", "5.", "-.5", "1.5e-1K", "", "E5", "."]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sources.number_with_unit(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [1234.5, 7e3, 7e6, 0.07, None, -7e9, 100.0, 5.0, -0.5, 150.0, None, None, None]
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    found = {(r.form, r.kind): r for r in audits.parsed_numbers(spark, "/root/testdata/sf0.001").collect()}
    for form, kinds, none, plain in (("amount", 6, {4}, set()), ("plain", 8, {7}, {0, 1, 2, 5})):
        for kind, n in part.groupBy((F.col("p_size") % kinds).alias("k")).count().collect():
            r = found.pop((form, kind))
            assert (r.n, r.with_unit, r.parsed) == (n, 0 if kind in none else n, n if kind in plain else 0)
            if (form, kind) == ("amount", 0):
                assert r.unit_total == round(part.where("p_size % 6 = 0").agg(F.sum("p_retailprice")).first()[0], 4)
    assert not found


def test_latest_matching_record(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for at, tag, x in ((1, "a", 1.0), (3, "a", 3.0), (2, "a", 2.0), (9, "b", 9.0)):
        sources.append_ledger(spark.createDataFrame([(at, tag, y, x + y) for y in (2001, 2002)], "at long, tag string, test_year long, x double"), ["at", "tag"], path)
    ledger = sources.read_ledger(spark, path)
    pick = lambda match: {r.test_year: r.x for r in sources.latest_records(ledger, match).collect()}
    assert pick({"tag": "a"}) == {2001: 2004.0, 2002: 2005.0} and pick({"tag": "a", "at": 1})[2001] == 2002.0
    assert pick({"tag": "c"}) == {} and pick({"seed": None})[2001] == 2010.0 and pick({"seed": 1}) == {}
    made = spark.createDataFrame([(2001, 2004.0), (2003, 1.0)], "test_year long, x double")
    got = {r.test_year: r.agrees for r in audit.self_check(made, sources.latest_records(ledger, {"tag": "a"}), ["test_year"], "x").collect()}
    assert got == {2001: True, 2002: False, 2003: False}


# ---- features on views

def test_views_equal_window_functions(spark):
    import random

    r = random.Random(3)
    rows = []
    for k, n in enumerate((90, 61, 4)):
        for d in range(n):
            close = None if (k, d) == (1, 30) else 10.0 if k == 0 and 20 < d < 40 else 5 + r.random() * 10
            rows.append((f"i{k}", datetime.date(2000, 1, 1) + datetime.timedelta(days=d), 8.0, 20.0 + r.random(), 3.0 - r.random(), close, 0.0 if d == 12 else float(r.randrange(100)), 9.0))
    bars = spark.createDataFrame(rows, "instrument string, date date, open double, high double, low double, close double, volume double, vwap double")
    names = [n for n in feat.FEATURES if n not in feat.BAR + feat.RATIO]
    plain = {}
    few = [n for n in names if n.rstrip("0123456789") not in feat.ORDERED]
    for at in range(0, len(few), 30):
        for x in feat.features(bars, few[at : at + 30]).collect():
            plain.setdefault((x.instrument, x.date), {}).update(x.asDict())
    for x in feat.features(bars).collect():
        for n in few:
            a, b = x[n], plain[x.instrument, x.date][n]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7)), (n, x.instrument, x.date, a, b)


# ---- selection and pools

def series(spark):
    import random

    r = random.Random(1)
    rows = [(s, q, datetime.date(y, 1, d), d, r.gauss(0.001 * s, 0.01), r.random()) for s in (1, 5) for q in (0.1, 0.2) for y in (2001, 2002, 2003) for d in range(1, 9)]
    return rows, spark.createDataFrame(rows, "span int, q_exit double, date date, day_idx int, gross double, turnover double")


def test_three_definitions_by_hand(spark):
    rows, df = series(spark)
    net = lambda x: x[4] * 1e4 - 10 * x[5]
    mean = lambda xs: sum(xs) / len(xs)
    keys = sorted({x[:2] for x in rows})
    best = max(keys, key=lambda k: mean([net(x) for x in rows if x[:2] == k]))
    want = {"global_best": [net(x) for x in rows if x[:2] == best and x[2].year > 2001], "baseline": [net(x) for x in rows if x[:2] == (1, 0.1) and x[2].year > 2001], "nested": []}
    for y in (2002, 2003):
        own = max(keys, key=lambda k: mean([net(x) for x in rows if x[:2] == k and x[2].year < y]))
        want["nested"] += [net(x) for x in rows if x[:2] == own and x[2].year == y]
    got = {r.definition: (r.days, r.net_bps) for r in resample.definitions(df, ("span", "q_exit"), {"span": 1, "q_exit": 0.1}).collect()}
    assert got == {k: (len(v), pytest.approx(mean(v))) for k, v in want.items()}


def test_null_of_parts_by_hand(spark):
    import random

    r = random.Random(2)
    nets = [(rep, s, q, r.gauss(0, 5)) for rep in range(0, 41) for s in (1, 5) for q in (0.1, 0.2)]
    df = spark.createDataFrame(nets, "rep long, span int, q_exit double, net_bps double")
    base = {"span": 1, "q_exit": 0.1}
    parts = lambda d: resample.selection_parts(d, ("span", "q_exit"), base)
    got = {r.statistic: r for r in resample.null_report(parts(df.where("rep > 0")), parts(df.where("rep = 0"))).collect()}
    by = lambda rep: [x for x in nets if x[0] == rep]
    one = lambda rep: {"best": max(x[3] for x in by(rep)), "baseline": by(rep)[0][3], "gap": max(x[3] for x in by(rep)) - by(rep)[0][3]}
    for k in ("best", "baseline", "gap"):
        seen, null = one(0)[k], [one(i)[k] for i in range(1, 41)]
        assert got[k].observed == pytest.approx(seen) and got[k].p == pytest.approx((1 + sum(x >= seen for x in null)) / 41) and got[k].null_mean == pytest.approx(sum(null) / 40)


def test_sign_test_is_exact(spark):
    df = spark.createDataFrame([(n * 100 + w, 1.0 if f < w else -1.0, 0.0) for n in (1, 5, 6, 40) for w in range(n + 1) for f in range(n)] + [(1, 2.0, 2.0)], "k int, one double, two double")
    got = {r.k: (r.n, r.wins, r.p) for r in audit.sign_test(df, ("k",)).collect()}
    assert 1 not in got
    for k, (n, wins, p) in got.items():
        assert (n, wins) == divmod(k, 100) and p == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, n - wins) + 1)) / 2**n))


def test_pool_without_exposure(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for y in (2001, 2002, 2003):
        for d in range(1, 6):
            f = rng.normal(size=30)
            own = rng.normal(size=(2, 30))
            rows += [(f"{n:02d}", datetime.date(y, 2, d), *(float(v) for v in (f[n] + 0.2 * own[0, n], f[n] + 0.2 * own[1, n], f[n]))) for n in range(30)]
    wide = spark.createDataFrame(rows, "instrument string, date date, a double, b double, f double")
    got = {r.kind: r for r in audit.pool_matrices(wide, ["a", "b"], "f").collect()}
    assert got["raw"].days == 15 and got["raw_same"].days == got["orthogonal"].days == 10
    assert got["raw"].rho > 0.9 and abs(got["orthogonal"].rho) < 0.3


# ---- stacked folds

def test_purged_folds_and_their_check(spark):
    days = [datetime.date(y, 1, d) for y in (2001, 2002, 2003) for d in range(1, 21)]
    dates = spark.createDataFrame([(d,) for d in days], "date date")
    folds = [r.asDict() for r in stacking.folds(dates, 5).orderBy("test_year").collect()]
    assert folds == [{"test_year": 2002, "fit_end": 11, "val_start": 17, "val_end": 15, "test_start": 21, "test_end": 40}, {"test_year": 2003, "fit_end": 15, "val_start": 21, "val_end": 35, "test_start": 41, "test_end": 60}]
    reach = lambda k: stacking.label_reach(stacking.numbered(dates), k)
    stacking.check_purge(reach(5), folds)
    with pytest.raises(ValueError, match="fold 2002: the label of fit day 11 reaches"):
        stacking.check_purge(reach(6), folds)
    stacking.check_purge(reach(6), [])


def test_features_need_one_shuffle_of_the_trades(spark):
    """The trades are dealt by instrument once: bars and features find their rows there."""
    from crosspanel.plans import catalogue

    plan = catalogue.QUERIES["features_158"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan


def test_permutations_of_a_wide_day_are_drawn_in_portions(spark):
    """However many names a day has, a task draws a bounded part of its repetitions at a time; the parts change nothing."""
    import numpy as np

    from crosspanel.operators import resample

    for names in (10, 50_000, 3_000_000):
        parts = resample.portions(2000, names)
        assert np.concatenate(parts).tolist() == list(range(1, 2001)) and all(len(p) == 1 or len(p) * names <= resample.CELLS for p in parts)
    rows = [(f"2020-01-0{d}", f"{i:03d}", (i * 7919 + d) % 101 / 100.0) for d in (1, 2) for i in range(40)]
    table = spark.createDataFrame(rows, "date string, instrument string, label_raw double").selectExpr("cast(date as date) as date", "instrument", "label_raw")
    held = table.where("instrument < '004' OR instrument >= '036'").selectExpr("*", "dayofmonth(date) as day_idx", "if(instrument < '004', 'long', 'short') as side")
    one, two = ({r.rep: round(r.net_bps, 9) for r in resample.null_of_holdings(held, table, 30, cells=c).collect()} for c in (resample.CELLS, 100))
    assert one == two and len(one) == 30
