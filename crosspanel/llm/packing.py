"""Best-fit packing of token pieces into sequences: non-negative least squares over length patterns, then residuals.

Only the length histogram (``size`` numbers, whatever the corpus) reaches the driver. The plan made from it is a list
of runs "``count`` sequences, each with these lengths"; every piece then finds its place by its rank among the pieces
of its length, which is computed with two levels of grouping, so no length's pieces meet in one task.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import LOWER, prefix_hash, range_hash, slices, words
from .shared import documents, settle

SIZE, END = 4096, 1
#: Patterns are fitted on lengths rounded up to SIZE / UNITS tokens and have at most DEPTH documents.
UNITS, DEPTH = 64, 4
#: Numbers of sequences that are tried when pieces are dealt in turns, and turns that are worth it.
TRIES, TURNS = 24, 64
#: Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.95, 0.8, 0.5, 0.0)
#: What stands between words that are encoded in one text, and their number.
SEPARATOR, TOGETHER = " \x01 ", 128
#: Words whose ids a worker keeps (about 50 bytes each); beyond it the oldest are forgotten.
CACHE_WORDS = 400_000


class WordIds:
    """Token ids by word: the tokenizer sees each distinct word once as long as it stays in the cache.

    White space only separates words for this vocabulary, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids[-1]
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, starts, lengths
        self.ids = np.zeros(0, np.uint32)
        self.used = 0

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, length = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, s, n in self.parts:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            start[hit], length[hit] = s[at[hit]], n[at[hit]]
        return start, length

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``texts``, words, one after another, number of ids of each).

        A call costs much more than a short word, so words are encoded ``TOGETHER``, each followed by a separator that is a
        word of its own. Its id tells where each word ends; where a word has that id too the count shows it, and the words
        are encoded one by one."""
        many = self.tokenizer.encode_batch_fast([SEPARATOR.join((*texts[at : at + TOGETHER], "")) for at in range(0, len(texts), TOGETHER)], add_special_tokens=False)
        flat = np.concatenate([np.array(x.ids, np.uint32) for x in many])
        ends = np.flatnonzero(flat == self.separator)
        if len(ends) == len(texts):
            return flat[flat != self.separator], np.diff(ends, prepend=-1) - 1
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(length.sum())), length

    def _add(self, hashes: np.ndarray, texts: list[str]) -> None:
        parts = [self._encode(texts[at : at + 2048]) for at in range(0, len(texts), 2048)]
        ids, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        total = len(ids)
        if self.used + total > len(self.ids):
            grown = np.zeros(2 * (self.used + total), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + total] = ids
        self.parts.append((hashes, self.used + np.cumsum(length) - length, length))
        self.used += total
        while len(self.parts) > 1 and len(self.parts[-2][0]) < 3 * len(self.parts[-1][0]):
            b, a = self.parts.pop(), self.parts.pop()
            joined = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(joined[0], kind="stable")
            self.parts.append(tuple(x[order] for x in joined))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        raw = data.tobytes()
        low = data if b"<|" in raw else LOWER[data]  # the special tokens' strings count in lower case only
        distinct, first, back = np.unique(range_hash(prefix_hash(low), starts, ends), return_index=True, return_inverse=True)
        start, length = self._find(distinct)
        new = np.flatnonzero(start < 0)
        if len(new):
            if sum(len(x[0]) for x in self.parts) > CACHE_WORDS:
                self.parts, self.used, new = [], 0, np.arange(len(distinct))
            self._add(distinct[new], [raw[starts[i] : ends[i]].decode() for i in first[new]])
            start, length = self._find(distinct)
        s, n = start[back], length[back]
        return self.ids[np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


_vocabularies: dict[str, WordIds] = {}


def _cutter(path: str, size: int, end: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabularies.get(path) or _vocabularies.setdefault(path, WordIds(path))
        for rows, data, offs in slices(batches):
            starts, stops, row = words(data, offs)
            flat, per_word = known.of(data, starts, stops)
            n = len(offs) - 1
            total = np.bincount(row, weights=per_word, minlength=n).astype(np.int64)
            flat = np.insert(flat, np.cumsum(total), end).astype("<u4")
            total += 1
            pieces = -(-total // size)
            doc = np.repeat(np.arange(n), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = number * size
            length = np.minimum(total[doc] - begin, size)
            at = (np.cumsum(total) - total)[doc] + begin
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            out = {"doc_id": rows.column(0).take(pa.array(doc)), "piece": pa.array(number, pa.int32()), "start": pa.array(begin), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:  # pieces tile the slice's ids in order
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    return cut


def token_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut only beyond ``size``.

    Null and empty texts have the end id alone. doc_id keeps its type; other columns are dropped.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_cutter(vocabulary, size, end, with_ids), schema)


def patterns(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with at most ``depth`` parts, each pattern in descending order."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, have: tuple[int, ...]) -> None:
        if not left:
            out.append(have)
        elif len(have) < depth:
            for part in range(min(left, most), 0, -1):
                if part * (depth - len(have)) >= left:
                    grow(left - part, part, (*have, part))

    grow(units, units, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        free[j] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if not (low := free & (s <= 1e-12)).any():
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x += min(1.0, float(step)) * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
        x = np.where(free, s, 0)
    return x


def plan(histogram: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (count, lengths) that place every piece: fitted patterns, then best fit of what is left, longest first.

    ``histogram[n]`` is the number of pieces of n tokens; its last index is the sequence's size. Work is on counts:
    the number of steps depends on the number of different lengths, not on the number of pieces. The fit rounds lengths
    up, so with some histograms fewer repeats of the patterns leave better residuals: of ``SHARES`` of the fitted counts
    the one that needs the fewest sequences is taken. Where many pieces fit a sequence no pattern of few documents helps;
    there all pieces are also dealt in turns, which may need fewer still.
    """
    size = len(histogram) - 1
    left = histogram.astype(np.int64)
    unit = max(1, size // UNITS)
    units = -(-size // unit)
    shapes = patterns(units, DEPTH)
    target = np.bincount(-(-np.arange(size + 1) // unit), weights=left, minlength=units + 1)[1:]
    a = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        np.add.at(a[:, j], np.array(shape) - 1, 1)
    weight = np.sqrt(np.arange(1, units + 1) / units)[:, None]  # long pieces are the hard ones to place
    fitted = nnls(a * weight, target * weight[:, 0])
    plans = (_place(left, shapes, unit, np.floor(fitted * share + 1e-9).astype(np.int64)) for share in SHARES)
    best = min(plans, key=sequences)
    return dealt(left, sequences(best)) or best


def sequences(runs: list[tuple[int, tuple[int, ...]]]) -> int:
    return sum(count for count, _ in runs)


def dealt(histogram: np.ndarray, below: int) -> list[tuple[int, tuple[int, ...]]] | None:
    """Runs that deal all pieces in turns, longest first, the fullest sequence getting the shortest piece of a turn; of about
    ``TRIES`` numbers of sequences from the least possible to under ``below`` the first that holds them all, None if none
    does. Sequences that have got the same are one run, so a turn's work depends on the different lengths alone."""
    size = len(histogram) - 1
    pieces, total = int(histogram.sum()), int((histogram * np.arange(size + 1)).sum())
    low = max(1, -(-total // size))
    if below <= low or pieces > TURNS * low:
        return None
    for m in sorted({int(round(low + (below - 1 - low) * k * k / (TRIES - 1) ** 2)) for k in range(TRIES)}):
        if runs := _turns(histogram, m):
            return runs
    return None


def _turns(histogram: np.ndarray, m: int) -> list[tuple[int, tuple[int, ...]]] | None:
    size = len(histogram) - 1
    queue = [[n, int(histogram[n])] for n in range(1, size + 1) if histogram[n]]  # the longest at the end
    runs = [(0, m, ())]  # tokens, sequences, lengths: emptiest first
    while queue:
        after = []
        for used, count, lengths in runs:
            while count:
                if not queue:
                    after.append((used, count, lengths))
                    break
                length, have = queue[-1]
                n = min(count, have)
                if used + length > size:
                    return None
                after.append((used + length, n, (*lengths, length)))
                count -= n
                queue[-1][1] -= n
                if not queue[-1][1]:
                    queue.pop()
        runs = sorted(after)
    return [(count, lengths) for _, count, lengths in runs if lengths]


def _place(histogram: np.ndarray, shapes: list[tuple[int, ...]], unit: int, repeats: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of ``repeats`` of the patterns ``shapes``, and of the rest by best fit."""
    size, left = len(histogram) - 1, histogram.copy()

    def take(low: int, high: int, want: int) -> Iterator[tuple[int, int]]:
        for length in range(high, low - 1, -1):
            if want and left[length]:
                n = int(min(want, left[length]))
                left[length] -= n
                want -= n
                yield length, n

    open_: dict[int, list[list]] = {}  # room left in a sequence -> runs [count, lengths]

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        open_.setdefault(room, []).append([count, lengths])

    for j in np.argsort([-s[0] for s in shapes], kind="stable"):
        states = [(int(repeats[j]), 0, ())] if repeats[j] else []
        for k, part in enumerate(shapes[j]):
            after = []
            for count, used, lengths in states:
                room = size - used
                final = k == len(shapes[j]) - 1
                high = room if final else min(part * unit, room)
                low = max(1, room - 2 * unit if final else (part - 1) * unit + 1)
                for length, n in take(low, high, count):
                    after.append((n, used + length, (*lengths, length)))
                    count -= n
                if count and lengths:
                    put(room, count, lengths)
            states = after
        for count, used, lengths in states:
            put(size - used, count, lengths)
    rooms = np.zeros(size + 1, np.int64)
    for room, runs in open_.items():
        rooms[room] = sum(r[0] for r in runs)
    for length in range(size, 0, -1):
        while left[length]:
            room = length + int(np.argmax(rooms[length:] > 0))
            if rooms[room]:
                run = open_[room].pop()
                n = int(min(run[0], left[length]))
                if n < run[0]:
                    put(room, run[0] - n, run[1])
                rooms[room] -= n
                put(room - length, n, (*run[1], length))
                rooms[room - length] += n
            else:
                fit = size // length
                n = max(1, int(left[length]) // fit)
                fit = min(fit, int(left[length]))
                put(size - fit * length, n, (length,) * fit)
                rooms[size - fit * length] += n
                n *= fit
            left[length] -= n
    return [(r[0], r[1]) for runs in open_.values() for r in runs if r[0]]


def pack(pieces: DataFrame, key: list[str], size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset: at most ``size`` tokens a sequence, no gaps between its pieces.

    ``pieces`` needs the columns ``key`` (unique) and length (1 to ``size``); it should be settled, as it is read
    more than once. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts:
        histogram[length] = n
    slots, next_rank, sequence = [], np.zeros(size + 1, np.int64), 0
    for count, lengths in plan(histogram) if counts else []:
        at = 0
        for length in lengths:
            rank = int(next_rank[length])
            slots.append((length, rank, rank + count, sequence, at))
            next_rank[length] += count
            at += length
        sequence += count
    table = pa.table([pa.array([s[i] for s in slots], pa.int64()) for i in range(5)], ["length", "lo", "hi", "sequence", "at"])
    step = 512
    places = spark.createDataFrame(table).withColumn("part", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi - 1) div {step}"))))
    share = max(1, math.isqrt(int(histogram.sum())))
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64(*key), F.lit(share)))
    before = dealt.groupBy("length", "share").count().withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")).drop("count")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy(*key)) - 1).join(before, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).withColumn("part", F.expr(f"rank div {step}"))
    found = ranked.join(places, (ranked["length"] == places["length"]) & (ranked["part"] == places["part"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"]))
    return found.select(*(pieces[c] for c in pieces.columns), (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text) with their sequences; ``with_ids`` adds the ids themselves.

    Null and empty texts are one piece, the end id; extra columns are dropped; an empty table gives no rows. Rows that
    share a doc_id are packed each: of equal pieces any one may take either place.
    """
    pieces = settle(token_pieces(docs, vocabulary or vocabulary_path(), with_ids=with_ids))
    return pack(pieces, ["doc_id", "piece"])


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))
