"""Line dedup by winnowing over line hashes: window minima are joined, matches extended both ways, later runs deleted.

Lines are the text's lines, and a line of more than a few words is cut into shorter ones before each word that its hash
chooses (one in ``PIECE`` words), so that a passage inside a long line has lines of its own. A line's hash is that of
``SEED_WORDS`` words from its first on. Of the lines in a window of ``MIN_WORDS`` words the smallest hash is the window's
fingerprint; a window without a line takes its smallest hash of any ``SEED_WORDS`` words. So equal windows that break
lines alike have equal fingerprints wherever they stand (others mostly, through the lines that words begin), and only
windows whose fingerprint stands at two places can repeat: that is the join of positions. From each such place on, both
ways, word by word, the windows that it is the minimum of are compared by content: one that also stands at an earlier
place, (doc_id, word) being the order, is deleted, and deleted ones that overlap or touch make up the full length of the
repeat. No pairs of documents are made: a window needs its earliest place only. Contents are 64-bit hashes of whole
windows; of N windows that are compared, N * N / 2**65 pairs would be taken as equal by chance (1e-4 for 1e8).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import U, mix, powers, prefix_hash, range_hash, slices, words
from .shared import BROADCAST_ROWS, documents, fresh, quoted, settle, small

MIN_WORDS, SEED_WORDS, PIECE = 50, 8, 8
STEP = 0xD6E8FEB86659FD93
#: Bytes of text worked on at a time; equal runs among them leave only the earliest for the shuffle.
SLICE = 1 << 19
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def line_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line that \\n ends or that ends a text: row, start, end (without \\n), number of words."""
    newline = np.flatnonzero(data == 10)
    # every text has one line more than it has newlines
    row = np.concatenate([np.searchsorted(offs, newline, side="right") - 1, np.arange(len(offs) - 1)])
    end = np.concatenate([newline, offs[1:]])
    order = np.lexsort((end, row))
    row, end = row[order], end[order]
    start = np.concatenate([[0], end[:-1] + 1])
    first = np.concatenate([[True], row[1:] != row[:-1]])
    start[first] = offs[row[first]]
    begins, _, _ = words(data, offs)
    n = np.searchsorted(begins, end) - np.searchsorted(begins, start)
    return row, start, end, n


class Runs:
    """All runs of ``MIN_WORDS`` words of a slice of texts, and their fingerprints."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        begins, stops, word_row = words(data, offs)
        hashed = range_hash(prefix_hash(data), begins, stops)
        n = len(begins)
        self.word_count = np.bincount(word_row, minlength=len(offs) - 1)
        self.first_word = np.cumsum(self.word_count) - self.word_count
        # word hashes as a polynomial over words give the content of any run
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * powers(STEP, n + 1)[:n], dtype=np.uint64)])
        start = np.arange(max(0, n - MIN_WORDS + 1))
        self.start = start[word_row[start] == word_row[start + MIN_WORDS - 1]] if n else start
        self.row = word_row[self.start]
        # a line begins at a text's first word, behind \n and at a chosen word
        fresh_line = (mix(hashed ^ U(STEP)) % U(PIECE)) == 0
        newline = np.flatnonzero(data == 10)
        after = np.searchsorted(begins, newline)
        fresh_line[after[after < n]] = True
        fresh_line[self.first_word[self.word_count > 0]] = True
        whole = np.zeros(n + 1, bool)  # SEED_WORDS words of one text follow
        at = np.arange(max(0, n - SEED_WORDS + 1))
        whole[at] = word_row[at] == word_row[at + SEED_WORDS - 1]
        last = self.start + MIN_WORDS - SEED_WORDS + 1
        seen = np.concatenate([[0], np.cumsum(fresh_line)])
        bare = np.flatnonzero(seen[last] == seen[self.start])
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, self.start[bare], 1)
        np.add.at(depth, last[bare], -1)
        low = np.flatnonzero((fresh_line | (np.cumsum(depth)[:n] > 0)) & whole[:n])
        prints = self.content(low, low + SEED_WORDS) >> U(1)
        prints[~fresh_line[low]] |= U(1 << 63)  # lines go before words that begin none
        # the smallest hash of each run's lines, by doubling
        a, b = np.searchsorted(low, self.start), np.searchsorted(low, last)
        pick, have = np.arange(len(low)), 1
        best = np.zeros(len(a), np.int64)
        while len(a):
            now = np.flatnonzero((b - a >= have) & (b - a < 2 * have))
            left, right = pick[a[now]], pick[b[now] - have]
            best[now] = np.where(prints[right] < prints[left], right, left)
            if 2 * have > MIN_WORDS or len(pick) <= have:
                break
            x, y = pick[:-have], pick[have:]
            pick = np.where(prints[y] < prints[x], y, x)
            have *= 2
        self.best, self.prints = best, prints

    def content(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        back = powers(pow(STEP, -1, 1 << 64), len(self.prefix))
        return mix((self.prefix[high] - self.prefix[low]) * back[low] ^ (high - low).astype(np.uint64))

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the selected lines, each place once."""
        place, at = np.unique(self.best, return_index=True)
        return self.row[at], self.prints[place]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its digest, number of words and fingerprints."""
    for rows, data, offs in slices(batches, most=SLICE):
        runs = Runs(data, offs)
        row, prints = runs.fingerprints()
        order = np.argsort(row, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offs) - 1))]).astype(np.int32)
        digest = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(prints[order].view(np.int64)))
        yield pa.record_batch([rows.column(0), rows.column(1), pa.array(digest, pa.binary()), pa.array(runs.word_count), lists], ["doc_id", "version", "digest", "n_words", "prints"])


def _searcher(known):
    """Candidate runs (doc_id, version, word, n, content); content is null for n runs that are known to repeat."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, most=SLICE):
            runs = Runs(data, offs)
            if known is not None:
                have = known.value
                shared = lambda row, h: have[np.minimum(np.searchsorted(have, h), len(have) - 1)] == h if len(have) else np.zeros(len(h), bool)
            else:
                own = rows.column(3)
                pairs = set(zip(pc.list_parent_indices(own).to_pylist(), own.flatten().to_pylist(), strict=True))
                shared = lambda row, h: np.fromiter((x in pairs for x in zip(row.tolist(), h.view(np.int64).tolist(), strict=True)), bool, len(h))
            at = np.flatnonzero(shared(runs.row, runs.prints[runs.best]))
            if not len(at):
                continue
            start, row = runs.start[at], runs.row[at]
            word, content = start - runs.first_word[row], runs.content(start, start + MIN_WORDS)
            rank = pc.rank(rows.column(0), tiebreaker="dense").to_numpy().astype(np.int64)
            version = rows.column(1).to_numpy()
            order = np.lexsort((word, version[row], rank[row], content))
            c, d, v, w = content[order], rank[row][order], version[row][order], word[order]
            head = np.concatenate([[True], c[1:] != c[:-1]])
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = np.zeros(len(at), bool)
            later[order] = (d > d[first]) | (v > v[first]) & (d == d[first]) | (w > w[first]) & (d == d[first]) & (v == v[first])
            # runs that repeat an earlier one of the slice are decided: neighbours travel as one row
            k = np.flatnonzero(later)
            new = np.concatenate([[True], (start[k][1:] != start[k][:-1] + 1) | (row[k][1:] != row[k][:-1])]) if len(k) else np.zeros(0, bool)
            f = np.flatnonzero(new)
            n = np.diff(np.append(f, len(k)))
            open_ = np.flatnonzero(~later)
            pick = np.concatenate([open_, k[f]])
            yield pa.record_batch(
                [rows.column(0).take(pa.array(row[pick])), rows.column(1).take(pa.array(row[pick])), pa.array(word[pick], pa.int32()), pa.array(np.concatenate([np.ones(len(open_), np.int64), n]), pa.int32()), pa.array(content[pick].view(np.int64), mask=np.arange(len(pick)) >= len(open_))],
                ["doc_id", "version", "word", "n", "content"],
            )

    return search


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, version, cuts): settled; cuts has ``word << 32 | n`` for n runs in a row that repeat earlier ones, by
    their first word from 0, or -1 for a text that is whole a copy of an earlier one.

    ``docs`` has doc_id, version (a number that tells texts of the same doc_id apart) and text. Texts with fewer than
    ``MIN_WORDS`` words, null ones and rows without doc_id have no runs. Copies are found by digest and take no
    further part. One run's places are sorted in one task and read as a stream: equal ones of a slice of text were
    joined before, so a task gets one row for each slice that has the run, and keeps none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    own = settle(texts.mapInArrow(_profile, f"doc_id {kind}, version int, digest binary, n_words long, prints array<long>").where(f"n_words >= {MIN_WORDS}"))
    firsts = settle(own.groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many"))
    copies = settle(own.join(small(firsts), "digest").where("struct(doc_id, version) > least").select("doc_id", "version"))
    rest = own.join(small(copies), ["doc_id", "version"], "left_anti").select("doc_id", "version", F.explode("prints").alias("print"))
    shared = settle(rest.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"))
    left = texts.join(small(copies), ["doc_id", "version"], "left_anti").select("doc_id", "version", "text")
    if shared.count() <= BROADCAST_ROWS:
        hashes = np.sort(shared.toPandas()["print"].to_numpy(np.int64).view(np.uint64))
        known = docs.sparkSession.sparkContext.broadcast(hashes)
    else:
        known = None
        marked = settle(rest.join(shared, "print").groupBy("doc_id", "version").agg(F.collect_set("print").alias("shared")))
        left = left.join(marked, ["doc_id", "version"])
    found = left.mapInArrow(_searcher(known), f"doc_id {kind}, version int, word int, n int, content long")
    key = F.coalesce("content", F.xxhash64("doc_id", "version", "word"))
    rank = F.rank().over(Window.partitionBy("key", F.col("content").isNull()).orderBy("doc_id", "version", "word"))
    later = found.withColumn("key", key).withColumn("rank", rank).where("content IS NULL OR rank > 1")
    coded = F.shiftleft(F.col("word").cast("long"), 32) + F.col("n")
    cuts = later.groupBy("doc_id", "version").agg(F.collect_list(coded).alias("cuts"))
    return settle(cuts.union(copies.select("doc_id", "version", F.array(F.lit(-1).cast("long")))))


def without_runs(t: str, cuts: np.ndarray) -> str:
    """``t`` without the runs ``cuts``.

    A line that loses all its words goes, as do lines without words inside a cut and after one that reaches the text's
    last word. Of other lines what stays is left with the white space before it.
    """
    if cuts[0] < 0:  # every word goes: what stays is the lines before the first
        m = WORD.search(t)
        return t[: max(0, t.rfind("\n", 0, m.start()))] if m else t
    place = [m.span() for m in WORD.finditer(t)]
    depth = np.zeros(len(place) + 1, np.int64)
    first = cuts >> 32
    np.add.at(depth, first, 1)
    np.add.at(depth, first + (cuts & 0xFFFFFFFF) + MIN_WORDS - 1, -1)
    gone = [*(np.cumsum(depth)[:-1] > 0).tolist(), True]  # behind the last word nothing stays that a cut reaches
    out, k, at = [], 0, 0
    for line in t.split("\n"):
        low, end = k, at + len(line)
        while k < len(place) and place[k][1] <= end:
            k += 1
        own = gone[low:k]
        if low == k:
            if not (low and gone[low - 1] and gone[low]):
                out.append(line)
        elif not any(own):
            out.append(line)
        elif not all(own):
            kept, to = "", at
            for j in range(low, k):
                if not gone[j]:
                    kept += t[to : place[j][1]]
                to = place[j][1]
            out.append(kept if gone[k - 1] else kept + t[to:end])
        at = end + 1
    return "\n".join(out)


def _cut(text: pa.Array, cuts: pa.Array) -> pa.Array:
    return pa.array([without_runs(t.as_py(), c.values.to_numpy()) if c.is_valid else None for t, c in zip(text, cuts, strict=True)], pa.string())


def with_kept(docs: DataFrame, kept: str) -> DataFrame:
    """``docs`` with the column ``kept``: the text that stays where something is cut, else null."""
    key, version, cuts = (fresh(docs, x) for x in ("cut_id", "cut_version", "cut_runs"))
    number = F.xxhash64(F.col("text").cast("string")).bitwiseAND(0x7FFFFFFF).cast("int")
    runs = repeated_runs(docs.select("doc_id", number.alias("version"), F.col("text").cast("string").alias("text")))
    ids = small(runs.select(F.col("doc_id").alias(key)).distinct())
    touched = docs.join(ids, docs["doc_id"] == ids[key], "left_semi").withColumn(version, number)
    runs = runs.select(F.col("doc_id").alias(key), F.col("version").alias(version + "_"), F.col("cuts").alias(cuts))
    joined = touched.join(runs, (touched["doc_id"] == runs[key]) & (touched[version] == runs[version + "_"]), "left")
    once = F.arrow_udf(_cut, "string").asNondeterministic()  # else a filter on ``kept`` would have it run twice
    cut = joined.withColumn(kept, once(F.col("text").cast("string"), F.col(cuts)))
    same = docs.join(ids, docs["doc_id"] == ids[key], "left_anti").withColumn(kept, F.lit(None).cast("string"))
    return cut.select(*quoted(*docs.columns, kept)).union(same.select(*quoted(*docs.columns, kept)))


def without_repeats(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the repeated runs cut out of text.

    Texts without repeats, null and blank ones and rows without doc_id come out as they are; an empty table stays
    empty. Rows of the same doc_id and text are the same place and get the same result; other texts of a doc_id
    count as documents of their own. A text that loses all its words is a copy of what stands earlier: it stays as
    what is left of it, or its row goes with ``drop_emptied``. Texts that nothing is cut from are not shuffled.
    """
    kept = fresh(docs, "cut_text")
    out = with_kept(docs, kept)
    if drop_emptied:
        out = out.where(F.col(kept).isNull() | (F.trim(F.col(kept), F.lit(" \t\n\r\f\v")) != ""))
    return out.withColumn("text", F.coalesce(kept, F.col("text").cast("string"))).select(*quoted(*docs.columns))


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before, lines deleted, sha256 (lowercase hex) of the text that stays."""
    both = with_kept(documents(spark, sf_dir, "doc_id", "text"), "kept")
    lines = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, "\n", -1))).cast("long")
    stays = F.coalesce("kept", "text")
    return both.select("doc_id", lines(F.col("text")).alias("n_lines"), (lines(F.col("text")) - lines(stays)).alias("n_deleted"), F.sha2(F.encode(F.coalesce(stays, F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
