"""Document fingerprints by spot signatures, in DataFrame operations only.

The most common words of the corpus are anchors. A spot is an anchor (or the start of the text) with the chain of the next
``CHAIN`` content words, those that are no anchors; the set of a text's hashed spots is its fingerprint. Sets are
compared by their Jaccard similarity. Two sets can only be as similar as their sizes allow, so sets are partitioned by
the logarithm of their size, and a set meets its own and the next partition only; within them sets meet that share one
of their first spots, and most pairs of a group of near copies follow from their distances to a leader.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import connected_components, documents, fresh, settle, small

#: Words that open spots; content words of a chain; words after an anchor among which they are looked for.
ANCHORS, CHAIN, REACH = 96, 2, 10
#: An anchor stands in at least this share of the texts.
COMMON = 0.02
#: Ranges of doc_id per shuffle partition when neighbours are looked up.
RANGES = 4


def _tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def anchors(docs: DataFrame) -> list[str]:
    """The words that stand in most texts of ``docs``, at most ``ANCHORS`` and each in a share of ``COMMON`` at least; texts
    are counted over the whole table, ties go by the word."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_"))
    least = COMMON * texts.count()
    found = texts.select(F.explode(F.array_distinct(_tokens(F.col("text_")))).alias("w")).groupBy("w").count()
    rows = found.where(F.col("count") >= least).orderBy(F.col("count").desc(), "w").limit(ANCHORS).collect()
    return [r["w"] for r in rows]


def with_spots(df: DataFrame, text: str, name: str, words: list[str]) -> DataFrame:
    """``df`` with ``name``: the sorted distinct spots of the column ``text`` as 32-bit hashes.

    A text without content words has its whole sequence of words as one spot, a text without words none.
    """
    t, c = fresh(df, "tokens"), fresh(df, "chains")
    common = lambda w: w.isin(words) if words else F.lit(False)
    df = df.withColumn(t, _tokens(F.col(text)))
    chain = lambda first: F.array_join(F.slice(F.filter(F.slice(F.col(t), first, F.lit(REACH)), lambda w: ~common(w)), 1, CHAIN), " ")
    every = F.transform(F.col(t), lambda w, i: F.when(common(w), F.concat(w, F.lit("\n"), chain(i + 2))))
    start = F.concat(F.lit("\n"), chain(F.lit(1)))
    df = df.withColumn(c, F.filter(F.array_append(every, start), lambda s: ~s.endswith("\n")))
    whole = F.when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))
    spots = F.transform(F.when(F.size(c) > 0, F.col(c)).otherwise(whole), lambda s: F.hash(s))
    return df.withColumn(name, F.array_sort(F.array_distinct(spots))).drop(t, c)


def as_text(spots: str) -> Column:
    """The fingerprint as text: eight hex digits a spot, in the order of the hashes."""
    return F.array_join(F.transform(spots, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two spot sets; equal ones (two empty ones too) have 1 and an empty one with another 0, without
    an intersection."""
    same = F.size(F.array_intersect(a, b))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / (F.size(a) + F.size(b) - same))


def with_next(docs: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """``docs`` (doc_id, ``columns``) with ``names``: the values of ``columns`` in the next document by descending doc_id, after
    the last those of the first. Rows without doc_id come last; equal ids follow each other by a hash of the first column.

    Ids are cut into ranges at quantiles; a range is a window of its own, and the first row of each range is also sent
    to the end of the range before. So no task holds more than a range, and texts are shuffled once.
    """
    spark = docs.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    down = F.struct(F.col("doc_id").isNull().alias("o1"), F.bitwise_not(F.col("doc_id").cast("long")).alias("o2"), F.xxhash64(columns[0]).alias("o3"))
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("doc_id").cast("long"))))
    keyed = docs.select("doc_id", *columns, down.alias("order_"), place.alias("range_"))
    firsts = keyed.groupBy("range_").agg(F.min("order_").alias("order_"))
    around = Window.partitionBy(F.lit(0)).orderBy("range_")  # a row per range
    last = F.max("range_").over(Window.partitionBy(F.lit(0)))
    firsts = settle(firsts.select("range_", "order_", F.coalesce(F.lag("range_").over(around), last).alias("before_")))
    hit = keyed.join(F.broadcast(firsts), ["range_", "order_"], "left")  # a row of numbers per range
    own = F.array(F.struct(F.col("range_").alias("r"), F.lit(False).alias("g")))
    both = F.array(F.struct(F.col("range_").alias("r"), F.lit(False).alias("g")), F.struct(F.col("before_").alias("r"), F.lit(True).alias("g")))
    sent = hit.select("doc_id", *columns, "order_", F.explode(F.when(F.col("before_").isNull(), own).otherwise(both)).alias("to_"))
    sent = sent.select("doc_id", *columns, "order_", F.col("to_.r").alias("range_"), F.col("to_.g").alias("ghost_"))
    w = Window.partitionBy("range_").orderBy("ghost_", "order_")
    led = sent.select("doc_id", *columns, "ghost_", *(F.lead(c).over(w).alias(m) for c, m in zip(columns, names, strict=True)))
    return led.where("NOT ghost_").drop("ghost_")


#: Two sets are near from this share on, in percent; rounds of leaders before what is left is compared pairwise.
PERCENT, LEADERS = 80, 6
#: Spots that stand among the first of at least ``OFTEN`` sets are put last, at most ``LATE`` of them (more only cost time).
OFTEN, LATE = 20, 1000


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, any more columns) with j, their similarity."""
    one, two = (sets.select(F.col("uid").alias(k), F.col("spots").alias(f"s_{k}")) for k in ("a", "b"))
    each = settle(pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", likeness("s_a", "s_b").alias("j")))
    return pairs.join(each, ["a", "b"])


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect just the sets of ``sets`` (uid, spots; distinct, not empty) that pairs of at least
    ``percent`` connect.

    A set of n spots belongs to the partition of log(n) to the base 100 / percent and looks into the next one too, as no
    set further off can be near. Near sets share one of the first n - ceil(n * percent / 100) + 1 of their spots in order
    of rarity, so these make the buckets of a partition. A bucket is not compared pairwise: all its sets meet its leader,
    the smallest uid. 1 - j is a metric, so of the sets that are not near the leader only those within twice the bound may
    have a near one among those that are, and only where their distances to the leader differ by the bound at most: only
    these pairs are compared. What is not near the leader goes on under a new one.
    """
    least = percent / 100
    far = 1 - least + 1e-9
    first = F.expr(f"size(spots) - CAST(ceil(size(spots) * {percent} / 100.0D - 1e-9) AS INT) + 1")
    counted = sets.select(F.explode(F.slice("spots", F.lit(1), first)).alias("spot")).groupBy("spot").count()
    often = [r["spot"] for r in counted.where(F.col("count") >= OFTEN).orderBy(F.col("count").desc(), "spot").limit(LATE).collect()]
    late = lambda x: x.isin(often) if often else F.lit(False)
    order = F.concat(F.filter("spots", lambda x: ~late(x)), F.filter("spots", late)) if often else F.col("spots")
    level = F.floor(F.log(F.size("spots")) / math.log(1 / least) + 1e-9).cast("int")
    put = sets.select("uid", level.alias("home"), F.slice(order, F.lit(1), first).alias("first"))
    rows = put.select("uid", F.explode(F.array("home", F.col("home") + 1)).alias("level"), "first").select("uid", "level", F.explode("first").alias("spot"))
    rows = rows.select(F.xxhash64("spot", "level").alias("bucket"), "uid")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size_")).where("size_ > 1").select("bucket")
    found, rest = None, settle(rows.join(small(settle(shared)), "bucket"))
    for turn in range(LEADERS + 1):
        lead = rest.groupBy("bucket").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("size_")).where("size_ > 1").select("bucket", "a")
        if turn < LEADERS:
            pairs = rest.join(lead, "bucket").where("uid <> a").select("bucket", "a", F.col("uid").alias("b"))
        else:
            pairs = rest.select("bucket", F.col("uid").alias("a")).join(rest.select("bucket", F.col("uid").alias("b")), "bucket").where("a < b")
        scored = settle(_scored(pairs, sets).select("bucket", "a", "b", (1 - F.col("j")).alias("d")))
        near, off = scored.where(F.col("d") <= far), scored.where(F.col("d") > far)
        found = near.select("a", "b") if found is None else found.union(near.select("a", "b"))
        if turn == LEADERS:
            break
        edge = off.where(F.col("d") <= 2 * far).select("bucket", F.col("b").alias("a"), F.col("d").alias("d_a"))
        cross = edge.join(near.select("bucket", "b", F.col("d").alias("d_b")), "bucket").where(F.col("d_a") - F.col("d_b") <= far).select("a", "b").distinct()
        found = found.union(_scored(cross, sets).where(1 - F.col("j") <= far).select("a", "b"))
        rest = settle(off.select("bucket", F.col("b").alias("uid")))
        if rest.isEmpty():
            break
    return found.distinct()


def class_roots(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root): for every doc_id of ``sets`` (doc_id, spots) that a near or equal set or a repeated id links, the smallest
    doc_id it reaches. Equal sets count once, under their smallest id; rows without doc_id or spots are linked with nothing."""
    full = sets.where("doc_id IS NOT NULL AND size(spots) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "spots", F.md5(as_text("spots").cast("binary")).alias("mark"))
    ids = settle(full.groupBy("mark").agg(F.min("doc_id").alias("first"), F.first("spots").alias("spots")).withColumn("uid", F.xxhash64("mark")))
    own = full.select("doc_id", "mark").distinct().join(ids.select("mark", "first"), "mark").where("doc_id <> first").select("doc_id", F.col("first").alias("b"))
    found = links(ids.select("uid", "spots"), percent)
    one, two = (ids.select(F.col("uid").alias(k), F.col("first").alias(f"{k}_")) for k in ("a", "b"))
    near = found.join(one, "a").join(two, "b").select("a_", "b_")
    return connected_components(near.union(own).toDF("a", "b"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs`` (doc_id,
    text): see the contract of ``op12_spot_signatures``. ``near_classes`` searches among all documents.

    A null text counts as empty. Rows that share a doc_id follow each other by a hash of their text; rows without one
    come after all others. A single row is its own next. Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = anchors(rows)
    spotted = with_spots(rows, "text", "spots", words)
    df = with_next(spotted, ["text", "spots"], ["next_text", "next_spots"])
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.expr("CAST(n_chars div 2 AS INT)"))
    df = df.withColumn("edited", F.expr("concat(left(text, CAST(n_chars - half AS INT)), left(next_text, half))"))
    df = with_spots(df, "edited", "edited_spots", words)
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("spots").alias("fingerprint"),
        as_text("edited_spots").alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"),
        likeness("spots", "next_spots").alias("near_next"),
    )


def near_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_spots, class_id) per row of ``docs`` (doc_id integer, text): class_id is the smallest doc_id that a row reaches
    through spot sets of at least ``percent`` similarity; a text without words has its own, a row without doc_id none. A
    repeated doc_id is one document. Extra columns are ignored; an empty table gives no rows."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = settle(with_spots(rows, "text", "spots", anchors(rows)).select("doc_id", "spots"))
    roots = class_roots(sets, percent).withColumnRenamed("node", "doc_id")
    return sets.join(roots, "doc_id", "left").select("doc_id", F.size("spots").cast("long").alias("n_spots"), F.coalesce("root", "doc_id").alias("class_id"))


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir, "doc_id", "text"))
