"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted verification.

Words are maximal runs of letters, digits and non-ASCII characters in lower case, shingles have five of them. Every
run of ``c`` consecutive shingles of a benchmark item has a 64-bit fingerprint, and every run of c shingles in every
document has one too. Fingerprints within ``RADIUS`` bits agree in one of RADIUS + 1 blocks (pigeonhole), which a table
per block finds.

The search is complete because c follows from the threshold, per item. Let W be the weight of its shingles and r that of
the rarest. A place where a copy departs from the item brings at least four shingles that the item lacks, each of weight
r, so with k such places a similarity of ``SIMILARITY`` means that shingles of weight SIMILARITY * (W + 4kr) at least are
kept, in k + 1 runs at most: the heaviest run has that much over k + 1. c is the length of the shortest run of the item
that is so heavy, the least over all k that W allows: about four fifths of a short item, 12 to 16 shingles of a long one.
Any copy holds such a run whole, and its fingerprint has distance 0. All stretches of the item's length around what was
found are compared on full sets, so each pair gets the largest similarity of any stretch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import PUNCTUATION, U, shingles, slices
from .shared import documents, quoted, settle, small

SIMILARITY, RADIUS = 0.8, 3
#: Shingles that a departure from an item brings at least (a word left out; one put in or changed brings five).
NEW = 4
#: Rounding of float sums.
EPSILON = 1e-9
#: Window sizes in shingles (fixed values; at most 127, as counts share a word by bytes).
WINDOWS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96)
#: Items searched for in one pass over the documents; more items make more passes.
PASS_ITEMS, PASS_BYTES = 20_000, 16 << 20
#: Byte -> its eight bits in the eight bytes of a word.
SPREAD = np.array([sum((b >> j & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def counters(value: np.ndarray) -> list[np.ndarray]:
    """Eight running sums; byte j of a difference of sum k counts bit 8k + j over a run of hashes (under 256)."""
    raw = value.view(np.uint8).reshape(-1, 8)
    return [np.concatenate([np.zeros(1, np.uint64), np.cumsum(SPREAD[raw[:, k]], dtype=np.uint64)]) for k in range(8)]


def simhash(sums: list[np.ndarray], size: int) -> np.ndarray:
    """The fingerprint of every run of ``size`` hashes: the bits that at least half of them have."""
    n = len(sums[0]) - size
    out = np.zeros(max(0, n), np.uint64)
    enough = U(0x0101010101010101 * (128 - (size + 1) // 2))
    for k, s in enumerate(sums):
        bits = (s[size:] - s[:n]) + enough & U(0x8080808080808080)
        out |= ((bits >> U(7)) * U(0x0102040810204080) >> U(56)) << U(8 * k)
    return out


def shortest_run(weight: np.ndarray, least: float) -> int:
    """The smallest number of consecutive entries that sum to ``least`` or more; all of them where even they do not."""
    total = np.concatenate([[0.0], np.cumsum(weight)])
    end = np.searchsorted(total, total[:-1] + least - EPSILON * max(1.0, total[-1]))
    ok = end < len(total)
    return int((end - np.arange(len(weight)))[ok].min()) if ok.any() else len(weight)


def window_of(weight: np.ndarray, total: float, rare: float) -> int:
    """The window size of an item whose shingles have ``weight`` in order, ``total`` as a set: see above."""
    most = int(total * (1 - SIMILARITY) / SIMILARITY / (NEW * rare) + EPSILON) if rare > 0 else 0
    need = min(shortest_run(weight, SIMILARITY * (total + NEW * k * rare) / (k + 1)) for k in range(most + 1))
    return max(w for w in WINDOWS if w <= max(1, need))


@dataclass
class Items:
    ids: list
    sets: list[np.ndarray]  # sorted shingles of each item
    counts: list[int]  # shingles of each item with repeats: the length of what it is compared with
    totals: np.ndarray  # weight of each item's set
    known: np.ndarray  # all shingles, sorted, and their weights
    weight: np.ndarray
    rare: float  # weight of shingles that an item does not have
    tables: dict[int, tuple]  # window size -> fingerprints, item, offset, then per block: order and 2**16 + 1 bounds

    @staticmethod
    def of(ids: list, texts: list[str], total: int, common: dict[int, int]) -> Items:
        """Items of one pass; ``total`` is the number of items of all passes, and ``common`` tells how many of those hold
        a shingle (signed) where more than one does."""
        parts = []
        for _, data, offs in slices(iter([pa.record_batch([pc.utf8_lower(pa.array(texts, pa.string()))], ["text"])])):
            value, bounds = shingles(data, offs, space=PUNCTUATION)
            parts += [value[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sets = [np.unique(v) for v in parts]
        known = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
        holders = np.array([common.get(x, 1) for x in known.view(np.int64).tolist()])
        rare = float(np.log1p(max(1, total)))
        weight = np.log1p(max(1, total) / holders) if len(known) else np.zeros(0)  # rare shingles tell more than those of many items
        at = [np.searchsorted(known, x) for x in sets]
        totals = np.array([weight[a].sum() for a in at])
        prints: dict[int, list] = {}
        for i, v in enumerate(parts):
            if len(v):
                c = window_of(weight[np.searchsorted(known, v)], float(totals[i]), rare)
                f = simhash(counters(v), c)
                prints.setdefault(c, []).append((f, np.full(len(f), i), np.arange(len(f))))
        tables = {}
        for c, found in prints.items():
            f, item, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            blocks = []
            for b in range(RADIUS + 1):
                key = (f >> U(16 * b) & U(0xFFFF)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                blocks.append((order, np.searchsorted(key[order], np.arange((1 << 16) + 1))))
            tables[c] = (f, item, offset, blocks)
        return Items(ids, sets, [len(v) for v in parts], totals, known, weight, rare, tables)

    def weights(self, s: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Weights of shingles; those that are not ``mine`` (the item's) weigh as if no item had them, so that a pair's
        similarity does not depend on which other items are searched for with it."""
        at = np.minimum(np.searchsorted(self.known, s), max(0, len(self.known) - 1))
        return np.where(mine, self.weight[at], self.rare)

    def matches(self, value: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], float]:
        """(row, item) -> largest weighted Jaccard similarity, at least ``SIMILARITY``."""
        best: dict[tuple[int, int], float] = {}
        if not len(value) or not self.tables:
            return best
        sums = counters(value)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        ranges: dict[tuple[int, int], set[tuple[int, int]]] = {}  # (row, item) -> first and last start of stretches
        for c, (prints, item, offset, blocks) in self.tables.items():
            if len(value) < c:
                continue
            mine = simhash(sums, c)
            inside = row[: len(mine)] == row[c - 1 :]
            for b, (order, edge) in enumerate(blocks):
                key = (mine >> U(16 * b)).astype(np.uint16)
                at = np.flatnonzero((edge[1:] > edge[:-1])[key] & inside)
                low, many = edge[key[at]], edge[key[at].astype(np.int64) + 1] - edge[key[at]]
                place = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
                at, hit = np.repeat(at, many), order[place]
                near = np.bitwise_count(mine[at] ^ prints[hit]) <= RADIUS
                at, hit = at[near], hit[near]
                for r, i, p in zip(row[at].tolist(), item[hit].tolist(), at.tolist(), strict=True):
                    ranges.setdefault((r, i), set()).add((p + c - self.counts[i], p))  # all stretches that hold the window
        for (r, i), found in ranges.items():
            similarity = max(self.closest(value, int(bounds[r]), int(bounds[r + 1]), i, *x) for x in joined(found))
            if similarity >= SIMILARITY - EPSILON:
                best[r, i] = similarity
        return best

    def closest(self, value: np.ndarray, begin: int, end: int, i: int, first: int, last: int) -> float:
        """Largest similarity to item i of the stretches of its length that start at ``first`` to ``last``, cut at the
        text's ends ``begin`` and ``end``; 0 where even all of them together hold too little of the item."""
        size, items = self.counts[i], self.sets[i]
        low, high = max(first, begin), min(last + size, end)
        own, at = np.unique(value[low:high], return_inverse=True)
        mine = items[np.minimum(np.searchsorted(items, own), len(items) - 1)] == own
        weight = self.weights(own, mine)
        if weight[mine].sum() < (SIMILARITY - EPSILON) * self.totals[i]:
            return 0.0
        # a shingle counts in the stretches from behind its previous place on, so once in each
        place = np.arange(low, high)
        order = np.argsort(at, kind="stable")
        again = at[order][1:] == at[order][:-1]
        behind = np.full(high - low, first)
        behind[order[1:][again]] = place[order[:-1][again]] + 1
        since, until = np.maximum(behind, np.maximum(place - size + 1, first)), np.minimum(place, last)
        ok = since <= until
        total, shared = np.zeros(last - first + 2), np.zeros(last - first + 2)
        for sums, w in ((total, weight[at]), (shared, np.where(mine, weight, 0.0)[at])):
            np.add.at(sums, since[ok] - first, w[ok])
            np.add.at(sums, until[ok] + 1 - first, -w[ok])
        total, shared = np.cumsum(total)[:-1], np.cumsum(shared)[:-1]
        start = first + int(np.argmax(shared / (total + self.totals[i] - shared)))
        own = np.unique(value[max(start, begin) : min(start + size, end)])
        mine = items[np.minimum(np.searchsorted(items, own), len(items) - 1)] == own
        weight = self.weights(own, mine)
        both = weight[mine].sum()
        return float(both / (weight.sum() + self.totals[i] - both))


def joined(ranges: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same numbers in ranges (first, last) that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, shingle): the distinct shingles of each item."""
    lowered = (pa.record_batch([b.column(0), pc.utf8_lower(b.column(1))], ["part", "text"]) for b in batches)
    for rows, data, offs in slices(lowered):
        value, bounds = shingles(data, offs, space=PUNCTUATION)
        sets = [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        part = np.repeat(rows.column(0).to_numpy(), [len(x) for x in sets])
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["part", "shingle"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity): the items of ``benchmark`` (item_id, text) that ``docs`` (doc_id, text) hold.

    Null or wordless texts and items match nothing; equal items are all reported; repeated rows report repeatedly.
    The items of one pass (``PASS_ITEMS``, ``PASS_BYTES``) are broadcast; a larger benchmark is searched for in as
    many passes as it needs, with weights counted over all items, so the result does not depend on the passes. Only
    the items' shingles are shuffled. A document of any length is searched whole.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    passes = max(1, math.ceil(n / PASS_ITEMS), math.ceil((size or 0) / PASS_BYTES))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double"
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)).cast("int"))
    held = settle(items.select("part", "text").mapInArrow(_shingles_of, "part int, shingle long"))
    common = settle(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.collect_set("part").alias("parts")).where("n > 1"))
    out = None
    for k in range(passes):
        rows = items.where(F.col("part") == k).collect()
        rows.sort(key=lambda r: (str(r[0]), r[1]))
        shared = dict(common.where(F.array_contains("parts", k)).select("shingle", "n").collect())  # of this pass's items
        share = docs.sparkSession.sparkContext.broadcast(Items.of([r[0] for r in rows], [r[1] for r in rows], n, shared))

        def search(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            own = share.value
            lowered = (pa.record_batch([b.column(0), pc.utf8_lower(b.column(1))], ["doc_id", "text"]) for b in batches)
            for rows, data, offs in slices(lowered):
                found = own.matches(*shingles(data, offs, space=PUNCTUATION))
                pairs = sorted(found)
                yield pa.record_batch([rows.column(0).take(pa.array([r for r, _ in pairs], pa.int64())), pa.array([own.ids[i] for _, i in pairs], benchmark_kind), pa.array([found[x] for x in pairs], pa.float64())], ["doc_id", "item_id", "similarity"])

        from pyspark.sql.pandas.types import to_arrow_type

        benchmark_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
        part = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(search, kinds)
        out = part if out is None else out.union(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; doc_id must be unique, columns stay as they are."""
    found = settle(contaminated(docs, benchmark).select("doc_id").distinct())
    return docs.join(small(found), "doc_id", "left_anti").select(*quoted(*docs.columns))


def op4_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity rounded to 6 digits) for every item that a document holds."""
    found = contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("similarity", F.round("similarity", 6))
