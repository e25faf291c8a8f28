"""Secret scans by multipart credential linking, in DataFrame operations only.

Strong parts (the contract's base kinds) are reported wherever they stand. Weak parts, an account name, an unlabelled
key-like token or an endpoint, say little alone: they are reported only when complementary parts stand within
``SCOPE`` code points. The link is an interval join: parts meet in position bins of a scope's width and its
neighbours, so the pairs of a document stay linear in its length however many parts it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, settle

SCOPE = 400
#: Base kinds in the order of the contract: pattern, and the group whose length must reach the minimum (fixed values).
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds: pattern and least length.
WEAK = {
    "identifier": (r"(?i:user(?:name)?|login|client_?id|account_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", 0, 6),
    "key": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40,}={0,2}", 0, 40),
    "endpoint": (r"(?i:https?|ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis)://[^\x09-\x0D\x20\"'<>]+", 0, 10),
}
KINDS = [*BASE, *WEAK]
#: What a part can be in a credential: access identifiers, secrets, endpoints.
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
#: A text with none of these words in lower case and no printable run of 24 characters has no part of any kind.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key", "akia", "user", "login", "client", "account", "access", "://")
LONG = r"[!-~]{24}"
STEP = 64


def _spans(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with the column ``kind``: array of (start, end) in code points of the matches that are long enough.

    Matches and the texts between them alternate, so starts are running sums of their lengths; sums go by blocks of
    ``STEP``, which keeps the work near linear for texts with very many matches.
    """
    pattern, group, least = (BASE | WEAK)[kind]
    p = F.lit(pattern)
    df = df.withColumn("m_", F.when(F.col("hit_"), F.regexp_extract_all("text_", p, F.lit(0))))
    df = df.withColumn("g_", F.transform(F.when(F.size("m_") > 0, F.regexp_extract_all("text_", p, F.lit(group))), lambda x: F.length(x)))
    between = F.when(F.size("m_") > 0, F.split("text_", pattern, -1))
    df = df.withColumn("l_", F.zip_with(F.transform(between, lambda x: F.length(x)), F.transform("m_", lambda x: F.length(x)), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit(0)).alias("b"))))
    total = lambda arr: F.aggregate(arr, F.lit(0), lambda s, x: s + x["a"] + x["b"])
    df = df.withColumn("s_", F.transform(F.sequence(F.lit(0), F.expr(f"(size(l_) - 1) div {STEP}")), lambda b: total(F.slice("l_", b * STEP + 1, F.lit(STEP)))))
    df = df.withColumn("s_", F.transform("s_", lambda _, b: F.aggregate(F.slice("s_", F.lit(1), b), F.lit(0), lambda s, x: s + x)))
    # naming s_ twice keeps the optimizer from working it out anew for every match
    at = lambda i: F.when(i < F.size("s_") * STEP, F.get("s_", F.floor(i / STEP).cast("int"))) + total(F.slice("l_", (F.floor(i / STEP) * STEP + 1).cast("int"), i % STEP)) + F.get("l_", i)["a"]
    df = df.withColumn("p_", F.transform("m_", lambda m, i: F.struct(at(i).alias("start"), F.length(m).alias("size"), F.get("g_", i).alias("g"))))
    spans = F.transform(F.filter("p_", lambda x: x["g"] >= least), lambda x: F.struct(x["start"].cast("long").alias("start"), (x["start"] + x["size"]).cast("long").alias("end")))
    return df.withColumn(kind, F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"))).drop("m_", "g_", "l_", "s_", "p_")


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and, per kind, the array of spans in each row's whole text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("text_")).withColumn("low_", F.lower("text_"))
    hit = F.col("text_").rlike(LONG)
    for word in HINTS:
        hit = hit | F.col("low_").contains(word)
    df = df.select("doc_id", "text_", hit.alias("hit_"), F.xxhash64("text_").alias("row_key"))
    for kind in KINDS:
        df = _spans(df, kind)
    return df.select("doc_id", "row_key", *KINDS)


def linked(found: DataFrame) -> DataFrame:
    """(doc_id, row_key, weak): the weak spans of each row that complementary parts support.

    A key needs an identifier or an endpoint in scope, an identifier a secret, an endpoint both an identifier and a
    secret. A weak span inside a base span is the base span already.
    """

    def named(k: str) -> Column:
        return F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), F.lit(ROLE[k]).alias("role"), s["start"].alias("start"), s["end"].alias("end")))

    each = [named(k) for k in KINDS]
    some = found.where(" + ".join(f"size({k})" for k in WEAK) + " > 0").select("doc_id", "row_key", F.explode(F.concat(*each)).alias("p")).select("doc_id", "row_key", "p.*").distinct()
    weak = some.where(F.col("kind").isin(list(WEAK))).withColumn("bin", F.explode(F.expr(f"sequence(start div {SCOPE} - 1, start div {SCOPE} + 1)")))
    other = some.select("doc_id", "row_key", F.expr(f"start div {SCOPE}").alias("bin"), F.col("kind").alias("o_kind"), F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    near = weak.join(other, ["doc_id", "row_key", "bin"]).where(f"NOT (kind = o_kind AND start = o_start) AND greatest(start, o_start) - least(start, o_start) <= {SCOPE}")
    apart = F.expr("o_start >= end OR o_end <= start")
    seen = near.groupBy("doc_id", "row_key", "kind", "start", "end").agg(
        *(F.max(apart & (F.col("o_role") == r)).alias(r) for r in ("identifier", "secret", "endpoint")),
        F.max(F.col("o_kind").isin(list(BASE)) & F.expr("o_start <= start AND end <= o_end")).alias("inside"),
    )
    ok = seen.where("NOT inside AND CASE kind WHEN 'key' THEN identifier OR endpoint WHEN 'identifier' THEN secret ELSE identifier AND secret END")
    return ok.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("weak"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.lit(KINDS), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """Spans per row of ``docs`` (doc_id, text): see ``op7_credential_linking``.

    Null and empty texts have none. Rows that repeat a doc_id are answered each by their own text; extra columns are
    ignored; an empty table gives no rows.
    """
    found = settle(parts(docs))
    ranked = lambda k, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k) + 1).alias("rank"), s["end"].alias("end")))
    base = F.concat(*(ranked(k, F.col(k)) for k in BASE))
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i + 1))))
    weak = F.coalesce(F.transform("weak", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"))), F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))
    both = found.join(linked(found), ["doc_id", "row_key"], "left")
    return both.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(base, weak)).alias("spans"))


def op7_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir, "doc_id", "text"))
