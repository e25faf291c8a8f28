"""Filter interaction audit: which filter removes what, in every order, from one pass over the documents.

Each document becomes a 32-bit word: bit S is set if the document survives the subset S of the five filters. Adding up
each bit over the documents of a part gives the survivors of all subsets, and every count of every order follows from
them. Bits are added up by carry-save: three words become a word of sums and one of carries, so a batch of n words is
brought down to two words per power of two before any bit is unpacked.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, settle, small

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Bounds of the filters (fixed values of the contract).
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Groups whose counts a task holds before it hands them on.
HELD = 50_000
#: The word of each set of failed filters: bit S is set if S has none of them.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & fails) for fails in range(SUBSETS)], np.uint32)


def counted_bits(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (uint32) have each of the 32 bits set: carry-save adders level by level, leftovers unpacked."""
    total, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) >= 3:
            k = len(words) // 3
            a, b, c = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * k :]])
        total += weight * np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return total


def fails_by_text(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D the text fails."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, CAPITALS, ""))
    tests = [n < LEAST_WORDS, 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"), 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"), text.rlike(MARKS)]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, fails) per row of ``docs``: fails is the set of failed filters as bits.

    Copies meet by the digest of their text; only digests of texts that stand under two or more doc_ids are joined, to
    one row each, so a text that a third of all documents share is not gathered anywhere.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = settle(docs.select("doc_id", part.alias("part"), text.alias("text_")).select("doc_id", "part", fails_by_text(F.col("text_")).alias("own"), F.unhex(F.sha2(F.col("text_").cast("binary"), 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_"), F.max("doc_id").alias("last_")).where("first_ < last_").select("digest", "first_")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    both = rows.join(small(settle(first), 250_000), "digest", "left").join(known.where("good OR toxic"), "doc_id", "left")
    again = F.when(F.col("first_") < F.col("doc_id"), 1 << FILTERS.index("E")).otherwise(0)
    no = F.lit(False)
    return both.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), (F.col("own") + again).alias("fails"))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, all, good, toxic): per part the survivors of all 32 subsets, of all documents and of those with the label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def release() -> pa.RecordBatch:
            keys = list(held)
            flat = pa.array(np.concatenate([held[k] for k in keys]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SUBSETS), pa.int32()), flat)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys]), lists], ["part", "good", "toxic", "counts"])
            held.clear()
            return out

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            key = np.asarray(coded.indices).astype(np.int64) * 4
            key += 2 * np.asarray(batch.column("good").cast(pa.int8())) + np.asarray(batch.column("toxic").cast(pa.int8()))
            words = WORDS[np.asarray(batch.column("fails"))]
            order = np.argsort(key, kind="stable")
            keys, at = np.unique(key[order], return_index=True)
            names = coded.dictionary.to_pylist()
            for k, own in zip(keys.tolist(), np.split(words[order], at[1:]), strict=True):
                name = (names[k // 4], bool(k & 2), bool(k & 1))
                held[name] = held.get(name, 0) + counted_bits(own)
            if len(held) > HELD:
                yield release()
        if held:
            yield release()

    each = rows.mapInArrow(count, "part string, good boolean, toxic boolean, counts array<long>").select("part", "good", "toxic", F.posexplode("counts").alias("s", "n"))
    per = each.groupBy("part", "s").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    ordered = F.array_sort(F.collect_list(F.struct("s", "all", "good", "toxic")))
    listed = per.groupBy("part").agg(ordered.alias("l"))  # 32 rows a part
    return listed.select("part", *(F.col("l")[c].alias(c) for c in ("all", "good", "toxic")))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): see the contract
    of ``op13_filter_audit``.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic. A null text counts as empty, a null lang as the
    empty part. A document without doc_id repeats nothing and has no labels; rows that share doc_id and text do not
    repeat each other, and count each; of several labels of a doc_id one with the value is enough. Extra columns are
    ignored; empty documents give no rows.
    """
    found = survivors(marked(docs, labels))
    everything = SUBSETS - 1
    shares = []  # per filter: the subsets without it, each with the number of orders that have just these before it
    for f in range(len(FILTERS)):
        without = [s for s in range(SUBSETS) if not s >> f & 1]
        ways = [math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) for s in without]
        shares.append(sum(((F.get("all", s) - F.get("all", s | 1 << f)) * w for s, w in zip(without, ways, strict=True)), F.lit(0)))
    df = found.withColumn("shares", F.array(*shares))
    df = df.select("*", F.explode(F.lit(ORDERS)).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = lambda letter: f"element_at(array({', '.join(str(1 << i) for i in range(len(FILTERS)))}), instr('{FILTERS}', {letter}))"
    df = df.withColumn("f", F.expr(bit("letter"))).withColumn("before", F.expr(f"aggregate(slice(split(filter_order, ''), 1, at), 0, (m, x) -> m + {bit('x')})"))
    lost = lambda c: F.get(c, "before") - F.get(c, F.col("before") + F.col("f"))
    failing = F.get("all", F.lit(0)) - F.get("all", "f")
    unique = F.get("all", everything - F.col("f")) - F.get("all", F.lit(everything))
    return df.select("part", "filter_order", (F.col("at") + 1).alias("step"), F.get("all", F.col("before") + F.col("f")).alias("kept"), lost("all").alias("removed"), (failing - lost("all")).alias("redundant"), unique.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.expr(f"element_at(shares, instr('{FILTERS}', letter))").alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def oracle() -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN known USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
each AS (
  SELECT part, good, toxic, n, filter_order, step, letter, contains(fails, letter) AS failing, fails = letter AS alone,
    len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM g, steps),
counts AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
    coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND toxic), 0) AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counts"""
