"""Near duplicates by min-max hashing: both extremes of each permutation are kept, banded, then verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import STEP, U, groups, mix, shingles, slices
from .shared import connected_components, documents, quoted, settle, small

#: 60 permutations give 120 signature values in 24 bands of 5: a pair shares no band with probability
#: (1 - 0.85**5)**24 = 8e-7 at similarity 0.85, and with 7e-5 at 0.8.
PERMUTATIONS, ROWS = 60, 5
SHINGLE_WORDS = 5
#: Distinct texts, and shingles of them, in a block (about); a larger candidate group is dealt as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 512, 400_000


def signatures(value: np.ndarray, bounds: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(rows, 2 * permutations): smallest and largest image of each row's shingles under each permutation."""
    rows = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, 2 * permutations), np.uint64)
    rng = np.random.default_rng(11)
    factor, shift = rng.integers(0, 1 << 63, (2, permutations), dtype=np.uint64)
    for k in range(permutations if len(rows) else 0):
        image = (value ^ shift[k]) * (factor[k] << U(1) | U(1))
        out[rows, 2 * k] = np.minimum.reduceat(image, bounds[rows])
        out[rows, 2 * k + 1] = np.maximum.reduceat(image, bounds[rows])
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(documents, bands): one key for each run of ``rows`` signature values; the band's number is part of it."""
    n = signature.shape[1] // rows
    parts = signature[:, : n * rows].reshape(len(signature), n, rows)
    weight = np.array([pow(STEP, j, 1 << 64) for j in range(rows)], np.uint64)
    return mix((parts * weight).sum(2, dtype=np.uint64) + np.arange(n, dtype=np.uint64) * U(0x632BE59BD9B4E019))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in slices(batches):
        value, bounds = shingles(data, offs, SHINGLE_WORDS)
        key = bands(signatures(value, bounds))
        sets = [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        n = np.array([len(s) for s in sets])
        d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
        d2 = np.array([mix(s ^ U(STEP)).sum(dtype=np.uint64) for s in sets], np.uint64)
        width = key.shape[1]
        filled = n > 0
        offsets = np.concatenate([[0], np.cumsum(np.where(filled, width, 0))]).astype(np.int32)
        yield pa.record_batch([rows.column(0), n.astype(np.int64), d1.view(np.int64), d2.view(np.int64), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[filled].ravel().view(np.int64)))], ["doc_id", "n_shingles", "d1", "d2", "bands"])


def _linked(query: list[np.ndarray], index: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the members of ``index`` with 100 * intersection >= percent * union, by one inverted list."""
    key = np.concatenate(index)
    owner = np.repeat(np.arange(len(index)), [len(s) for s in index])
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([begin, [len(key)]]))
    distinct, size = key[begin], np.array([len(s) for s in index])
    for i, own in enumerate(query):
        at = np.searchsorted(distinct, own)
        at = at[(at < len(distinct)) & (distinct[np.minimum(at, len(distinct) - 1)] == own)]
        many = count[at]
        place = np.repeat(begin[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(owner[place], minlength=len(index))
        yield i, np.flatnonzero(100 * shared >= percent * (len(own) + size - shared))


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["cc", "bi", "bj"]):
            ids, block = table["doc_id"].to_numpy(), table["block"].to_numpy()
            sets = []
            for _, data, offs in slices(iter(table.combine_chunks().to_batches())):
                value, bounds = shingles(data, offs, SHINGLE_WORDS)
                sets += [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
            left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
            parent = list(range(len(ids)))

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            if len(left) and len(right):
                for i, js in _linked([sets[x] for x in left], [sets[x] for x in right], percent):
                    for j in js:
                        a, b = root(int(left[i])), root(int(right[j]))
                        if a != b:
                            low, high = (a, b) if ids[a] < ids[b] else (b, a)
                            parent[high] = low
            tops = np.array([root(x) for x in range(len(ids))], np.int64)
            moved = np.flatnonzero(tops != np.arange(len(ids)))
            yield pa.record_batch([pa.array(ids[moved]), pa.array(ids[tops[moved]])], ["a", "b"])

    return verify


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for ``docs`` (doc_id, text): see ``op8_minmax_near_dups``.

    Equal sets collapse first (one representative each), so groups of copies never meet in one task. Bands link
    representatives into candidate groups through each bucket's smallest member (no pairs are listed). Within a
    candidate group all texts are compared on full shingle sets, in blocks of ``BLOCK`` texts. Null or empty
    texts have no set and link with nothing; extra columns are ignored; an empty table gives no rows. Rows that share a
    doc_id are told apart by their sets only: equal ones are one text, and others are linked as documents of that id.
    Rows without doc_id link with nothing and are kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = settle(docs.mapInArrow(_digest, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    filled = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = filled.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("d1", "d2", "n_shingles", "m.*")
    same = settle(same)
    keyed = same.select("doc_id", F.explode("bands").alias("key"))
    lead = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    candidates = connected_components(keyed.join(lead, "key").where("doc_id <> a").select("a", F.col("doc_id").alias("b")))
    weighed = candidates.join(same.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    sized = weighed.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    member = settle(candidates.join(sized, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("cc"), "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("block")))
    dealt = docs.join(small(member), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("cc", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "doc_id", "text")
    # only blocks spread over tasks: a block pair is one group, a group is at most two blocks
    edges = dealt.repartition("cc", "bi", "bj").sortWithinPartitions("cc", "bi", "bj").mapInArrow(_verifier(percent), "a long, b long")
    component = connected_components(edges)
    rep = same.select("d1", "d2", "n_shingles", F.col("doc_id").alias("node")).join(component, "node", "left").select("d1", "d2", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    rep = settle(rep)  # both sides of the join are plain tables: a hot group of copies may be split
    linked = filled.select("doc_id", "n_shingles", "d1", "d2").join(rep, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = made.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each near-duplicate group; columns stay as they are."""
    gone = settle(near_duplicates(docs, percent).where("NOT kept").select("doc_id"))
    return docs.join(small(gone), "doc_id", "left_anti").select(*quoted(*docs.columns))


def op8_minmax_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
