"""Quality rules: a threshold table compiled into Spark projections of length, symbol, stop-word and line measures.

Everything is built-in expressions on one pass over the table: no user function, no shuffle, no join. The same table
compiles to SQL for other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

#: White space that separates words, and symbols that are counted (fixed values of the contract).
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WINDOW = 8
#: Frequent words of the corpus languages (fixed values).
STOP_WORDS = """
the of and to in is that for it was on are as with be by this from or an
de la le les et un une des du en que qui dans est pour pas au sur par avec ce
der die und das von mit den ist im des ein zu nicht dem eine auf für als auch sich
el los las del se una por con para es su al lo como más pero sus y o no
""".split()
#: measure, least, most (None: no bound). A text passes if every measure is within its bounds.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("chars_per_word", 2.0, 16.0),
    ("symbols_per_word", None, 0.10),
    ("stop_word_share", 0.02, None),
    ("duplicate_line_share", None, 0.50),
]


def _counted(docs: DataFrame) -> DataFrame:
    """Rows with the contract's counts; each select is one projection on the columns before it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text_"))
    spaced, symbols = F.col("text_"), F.lit(0)
    for c in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    for c in SYMBOLS:
        symbols = symbols + F.octet_length("text_") - F.octet_length(F.replace("text_", F.lit(c), F.lit("")))
    words = F.filter(F.split(spaced, " ", -1), lambda w: w != "")
    lines = F.filter(F.split("text_", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    base = base.select("doc_id", words.alias("words"), lines.alias("lines"), symbols.cast("long").alias("n_symbols"))
    base = base.select(
        "doc_id",
        "words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("words").cast("long").alias("n_words"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # hashes of runs of 2, 4, 8 words, each from two neighbours of the run half as long
    for half in (1, 2, 4):
        left = F.expr(f"slice(h, 1, greatest(size(h) - {half}, 0))")
        right = F.expr(f"slice(h, {half + 1}, greatest(size(h) - {half}, 0))")
        base = base.withColumn("h", F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))
    many = F.size(F.array_distinct("h")) < F.size("h")
    base = base.withColumn("sorted", F.when(many, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    again = F.filter("sorted", lambda s, i: s["x"].eqNullSafe(F.get("sorted", i - 1)["x"]) | s["x"].eqNullSafe(F.get("sorted", i + 1)["x"]))
    base = base.withColumn("places", F.array_sort(F.transform(again, lambda s: s["i"])))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["total"] + WINDOW - F.greatest(s["end"] - p, F.lit(0))).alias("total"), (p + WINDOW).alias("end")),
        lambda s: s["total"],
    )
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"


#: measure -> SQL over the counts; the same text serves Spark and other engines.
MEASURES = {
    "chars_per_word": _share("word_chars", "n_words"),
    "symbols_per_word": _share("n_symbols", "n_words"),
    "stop_word_share": _share("n_stop_words", "n_words"),
    "duplicate_line_share": _share("n_dup_lines", "n_lines"),
}
BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def verdict_sql(table: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> str:
    """The table as one Boolean SQL expression over the counts."""
    tests = [f"({MEASURES[m]}) {op} {x}" for m, low, high in table for op, x in ((">=", low), ("<=", high)) if x is not None]
    return " AND ".join(tests) or "TRUE"


def rule_report(docs: DataFrame, table: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """Counts, base_failed and kept per row of ``docs`` (doc_id, text).

    Null counts as empty: no words, so the base rule fails. Extra columns are ignored, repeated rows answered each.
    """
    counted = _counted(docs)
    kept: Column = F.expr(f"NOT {BASE_FAILED} AND {verdict_sql(table)}")
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), kept.alias("kept"))


def op9_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(documents(spark, sf_dir, "doc_id", "text"))


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN rep USING (doc_id, s)) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(w, lambda x: list_contains([{stops}], lower(x)))) AS BIGINT) AS n_stop_words,
    CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
  NOT {BASE_FAILED} AND {verdict_sql()} AS kept FROM counts"""
