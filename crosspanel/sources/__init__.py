"""Bar panels, universes, manifests and ledgers, read from and written to files by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spread
from . import files

#: The schema of a bar panel, whatever it was read from.
BARS = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount"))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, price: str, order: Column, size: str) -> DataFrame:
    """One bar per (instrument, date) from single trades."""
    return rows.groupBy("instrument", "date").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(size).alias("volume"),
        F.sum(F.col(price) * F.col(size)).alias("amount"),
    )


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of the suppliers' line items, one artificial splice included (instrument 7 from June 1998).

    A week has few trades of an instrument, so combining before the shuffle saves nothing and its states are several times
    a trade: the trades themselves are dealt by instrument, once for all that is made of bars by instrument.
    """
    items = table(spark, sf_dir, "lineitem")
    instrument = F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("instrument")
    trades = spread(items.select(instrument, (F.col("l_suppkey") == 7).alias("seven"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), "instrument")
    splice = F.when(F.col("seven") & (F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp")), 100.0).otherwise(1.0)
    rows = trades.select(
        "instrument",
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        ((F.lit(92.5) + F.lit(15.0) * F.col("l_extendedprice") / F.lit(105000.0)) * splice).alias("px"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("k"),
        "l_quantity",
    )
    return _bars(rows, "px", F.col("k"), "l_quantity")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the users' events; volume counts events."""
    rows = table(spark, sf_dir, "events").select(
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("instrument"),
        F.to_date("ts").alias("date"),
        "value",
        F.struct("ts", "event_id").alias("k"),
        F.lit(1.0).alias("one"),
    )
    return _bars(rows, "value", F.col("k"), "one")


def read_bars(spark: SparkSession, path: str, instrument: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Bars from a directory of parquet files: the instrument is the column ``instrument`` or else the file's name.

    ``columns`` renames; rows without a date or close go. Of a repeated (instrument, date) the row that stands first stays,
    by the file's path and the row's place in it. NaN becomes NULL. To have broken files reported and passed over, read
    them by ``files.read_each``.
    """
    df = spark.read.parquet(path)
    df = df.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("place_")).withColumnsRenamed(columns or {})
    name = F.regexp_extract("file_", r"([^/]+)\.parquet$", 1)
    df = df.withColumn("instrument", F.col(instrument) if instrument else name)
    doubles = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c, k in df.dtypes if k == "double"}
    df = df.withColumns(doubles).withColumn("date", F.to_date("date")).dropna(subset=["date", "close"])
    return first_of(df, ["instrument", "date"], ["file_", "place_"]).drop("file_", "place_")


def first_files(spark: SparkSession, path: str, most: int, prefer: tuple[str, ...] = ()) -> DataFrame:
    """Rows of at most ``most`` instruments of a directory of parquet files: the preferred names first, then by name."""
    df = spark.read.parquet(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet$", 1)
    df = df.withColumn("instrument", name)
    liked = F.when(F.col("instrument").isin(*prefer), 0).otherwise(1) if prefer else F.lit(1)
    chosen = df.select("instrument").distinct().orderBy(liked, "instrument").limit(most)
    return df.join(F.broadcast(chosen), "instrument", "left_semi")


def read_members(spark: SparkSession, paths: dict[str, str], value: str = "pred") -> DataFrame:
    """(date, instrument, one column per member) of the prediction files that can be read: the rows that any member has,
    NULL where a member lacks one. Members that are missing, broken or lack a column are left out, with all of their files;
    ``files.read_pool`` says why."""
    read = files.read_pool(spark, paths, {"date": "date", "instrument": "string", value: "double"})
    bad = {r["name"] for r in files.report_of(read).where("status <> 'ok'").select("name").distinct().collect()}  # a row per member
    out = None
    for name in paths:
        if name not in bad:
            one = files.rows_of(read).where(F.col("name") == name).select("date", "instrument", F.col(value).alias(name))
            out = one if out is None else out.join(one, ["date", "instrument"], "full")
    return out if out is not None else spark.createDataFrame([], "date date, instrument string")


def salvaged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` for keys that it lacks; status says ok or partial."""
    rest = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.withColumn("status", F.lit("ok")).unionByName(rest.withColumn("status", F.lit("partial")))


def universe_by_quarter(members: DataFrame, start: str, end: str) -> DataFrame:
    """(quarter, ticker): who was listed (ticker, since, until; until may be missing) at the start of each quarter from
    ``start`` to ``end``; the universe is their distinct union."""
    grid = members.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 3 months"))).alias("quarter"))
    listed = (F.col("since") <= F.col("quarter")) & (F.col("until").isNull() | (F.col("until") >= F.col("quarter")))
    return members.join(F.broadcast(grid), listed).select("quarter", "ticker").distinct()  # a row per quarter


def parsed_number(text: Column) -> Column:
    """The number that a text is, white space around it aside; NULL for anything else, units and separators included."""
    plain = F.trim(text, F.lit(" \t\n\r\f\x0b"))
    # Java would also take a letter for the kind of number at its end
    return F.when(~plain.rlike("[dDfFlL]$"), plain.try_cast("double"))


#: A number in any notation, and a unit.
AMOUNT = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:E[+-]?[0-9]+)?)([KMB%]?)$"


def number_with_unit(text: Column) -> Column:
    """A number from a text with thousands separators, a sign, %, K, M or B; NULL where there is none."""
    plain = F.upper(F.regexp_replace(F.trim(text), r"[,\s$]", ""))
    body, unit = (F.regexp_extract(plain, AMOUNT, k) for k in (1, 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "%", 0.01).otherwise(1.0)
    return F.when(body != "", body.cast("double") * scale)


#: What the files of a run's models are called: test year, tag and seed.
RUN = r"fold(\d+)(.*)_seed(\d+)\.pt$"


def run_of(name: Column) -> dict[str, Column]:
    """Fold, tag and seed of a run from its file's name (fold2020_cn_seed3.pt); NULL for other names."""
    part = lambda k: F.when(name.rlike(RUN), F.regexp_extract(name, RUN, k))
    return {"fold": part(1).cast("long"), "tag": part(2), "seed": part(3).cast("long")}


def stamped(rows: DataFrame, **facts: str) -> DataFrame:
    """``rows`` with where they come from as columns (data, market, tier and the like)."""
    return rows.withColumns({f"from_{k}": F.lit(v) for k, v in facts.items()})


def write_document(rows: DataFrame, path: str) -> None:
    """One JSON document with all ``rows`` (a summary of a few) as an array, in one file."""
    rows.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("rows"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, chosen by a map-side minimum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("r_")).select(*keys, *(F.col(f"r_.{c}").alias(c) for c in rest))


def adjusted(bars: DataFrame) -> DataFrame:
    """Adjusted prices: a factor of 1 % a year since 1995 on open, high, low and close; volume stays."""
    factor = 1 + F.lit(0.01) * (F.year("date") - 1995)
    out = bars.withColumn("factor", factor).withColumn("raw_close", F.col("close"))
    for c in ("open", "high", "low", "close"):
        out = out.withColumn(c, F.col(c) * F.col("factor"))
    return out.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)


def by_factor(bars: DataFrame, adj_close: str = "adj_close") -> DataFrame:
    """Adjusted prices of bars that carry an adjusted close; a close of zero gives NULL."""
    factor = F.try_divide(F.col(adj_close), F.col("close"))
    return bars.withColumn("factor", factor).withColumns({c: F.col(c) * F.col("factor") for c in ("open", "high", "low")}).withColumn("close", F.col(adj_close))


def unpivot_batch(wide: DataFrame, date: str, fields: list[str]) -> DataFrame:
    """(instrument, date, fields...) from columns named ``field|instrument``: a downloaded batch made long."""
    names = sorted({c.split("|", 1)[1] for c in wide.columns if "|" in c})
    each = F.array(*(F.struct(F.lit(n).alias("instrument"), *((F.col(f"`{f}|{n}`") if f"{f}|{n}" in wide.columns else F.lit(None)).cast("double").alias(f) for f in fields)) for n in names))
    return wide.select(F.col(date).alias("date"), F.explode(each).alias("r")).select("r.instrument", "date", *(f"r.{f}" for f in fields)).dropna(how="all", subset=fields)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text file: one a line, ``#`` starts a comment, blank lines count for nothing."""
    symbol = F.trim(F.split("value", "#")[0])
    return spark.read.text(path).select(symbol.alias("symbol")).where("symbol <> ''").distinct()


MANIFEST = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("status", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("last_date", T.DateType())])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """CSV that takes the place of what is at ``path`` once it is whole; ``manifest`` may read that."""
    rows = manifest.select(*MANIFEST.fieldNames())
    files.write_beside(manifest.sparkSession, path, lambda new: rows.write.option("header", True).csv(new))


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new``, and those of ``old`` for other tickers."""
    return old.join(new.select("ticker"), "ticker", "left_anti").unionByName(new)


def still_to_do(universe: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tickers of ``universe`` that no row of ``manifest`` says ok about."""
    return universe.join(manifest.where("status = 'ok'").select("ticker"), "ticker", "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per result of a JSON-lines ledger whose lines hold an array ``results``; old lines may lack fields."""
    lines = spark.read.json(path)
    rest = [c for c in lines.columns if c != "results"]
    return lines.select(*rest, F.posexplode("results").alias("position", "r")).select(*rest, "position", "r.*")


def append_ledger(rows: DataFrame, keys: list[str], path: str) -> None:
    """One line per ``keys``, its rows as the array ``results``."""
    rest = [c for c in rows.columns if c not in keys]
    rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("results")).write.mode("append").json(path)


def latest_records(ledger: DataFrame, match: dict, at: str = "at") -> DataFrame:
    """The rows of the newest record (by ``at``) of a ledger whose fields equal ``match``; a field that is missing matches None
    only. No row where none matches."""
    rows = ledger
    for k, v in match.items():
        rows = rows.where(F.col(k).eqNullSafe(F.lit(v))) if k in ledger.columns else rows.where(F.lit(v is None))
    newest = rows.agg(F.max(at).alias("newest_"))
    return rows.join(F.broadcast(newest), F.col(at) == F.col("newest_")).drop("newest_")  # one row on the right


def write_panel(panel: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet that takes the place of what is at ``path`` once it is whole; where the job fails the old panel stays. ``by``
    partitions the files."""
    writer = panel.write.partitionBy(by) if by else panel.write
    files.write_beside(panel.sparkSession, path, writer.parquet)
