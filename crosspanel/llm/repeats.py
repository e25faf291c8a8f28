"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts in a document with a smaller doc_id.

Suffix arrays are built per shard, and shards are made so that equal strings meet: every string of LENGTH bytes has a
minimizer, the smallest hash of its K-byte strings. Only minimizers that two documents share can be part of a repeat.
Around those, a passage (everything that a string with that minimizer can reach) goes to the minimizer's shard; the
shard's suffix array by induced sorting and its permuted common prefixes tell which strings repeat, exactly.

Before shuffling, what one batch can decide stays there: exact copies go first, by digest; a minimizer shared within
a batch is shared; of equal passages only the smallest document's travel, the others' are repeats at once. So a
passage that a third of all documents hold costs a shard one row per batch and different surrounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U, flat, groups, mix, prefix_hash, range_hash, slices
from .shared import documents, settle, small
from .suffixes import shares_prefix, suffix_array

LENGTH, K = 50, 20
REACH = LENGTH - K
#: Minimizers and passage bytes per shard, about.
SHARD_ROWS, SHARD_BYTES = 400_000, 2 << 20
NONE = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of x[i : i + n] for every i that has them, by doubling."""
    have = 1
    while 2 * have <= n:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def minimizers(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): K-byte strings such that every LENGTH-byte string of a text holds one that is the smallest of
    its own. Ties are thinned out, so runs of one character do not select every place."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - K + 1)
    h = range_hash(prefix_hash(data), at, at + K)
    least = _sliding(h, REACH + 1, np.minimum)  # per start of a string
    inside = np.zeros(len(least), bool)
    size = np.diff(offs)
    for a, m in zip(offs[:-1][size >= LENGTH].tolist(), size[size >= LENGTH].tolist(), strict=True):
        inside[a : a + m - LENGTH + 1] = True
    least = np.where(inside, least, U(0))
    pad = np.zeros(REACH, np.uint64)
    top = _sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)  # per K-byte string, over what holds it
    place = np.flatnonzero((top == h) & (top > U(0)))
    value = h[place]
    # chains of ties at most K apart keep their ends and one in K bytes
    if len(place) > 2:
        link = (value[1:] == value[:-1]) & (place[1:] - place[:-1] <= K // 2)
        head = np.concatenate([[True], ~link])
        origin = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
        step = (place - origin) // (K // 2)
        keep = head | np.append(~link, True) | np.concatenate([[True], step[1:] != step[:-1]])
        place, value = place[keep], value[keep]
    return place, value


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _spread(shards: int):
    """Rows of minimizers by shard: h (6 bytes each), doc (8) with counts (4), place (4). doc -1 says shared already;
    a row without h is decided: its places are shared."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            hs, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, data, offs in slices(iter([batch])):
                at, h = minimizers(data, offs)
                row = np.searchsorted(offs, at, side="right") - 1
                hs.append(h)
                docs.append(rows.column(0).to_numpy(zero_copy_only=False)[row])
                places.append(at - offs[row])
            h, doc, place = np.concatenate(hs), np.concatenate(docs), np.concatenate(places)
            order = np.lexsort((doc, h))
            h, doc, place = h[order], doc[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(h)))
            many = np.repeat(doc[head] != doc[np.append(head[1:], len(h)) - 1], count) if len(h) else np.zeros(0, bool)
            marks = np.unique(h[many])
            decided = (doc[many], place[many])
            h, doc, place = np.concatenate([h[~many], marks]), np.concatenate([doc[~many], np.full(len(marks), -1)]), np.concatenate([place[~many], np.zeros(len(marks), np.int64)])
            shard = (mix(h) % U(shards)).astype(np.int64)
            order = np.lexsort((doc, shard))
            h, doc, place, shard = h[order], doc[order], place[order], shard[order]
            cut = np.searchsorted(shard, np.arange(shards + 1))
            out: dict[str, list] = {"shard": [], "h": [], "doc": [], "n": [], "place": []}

            def put(s: int, hb: bytes | None, d: np.ndarray, p: np.ndarray, out=out) -> None:
                own, n = np.unique(d, return_counts=True)
                for k, v in zip(out, (s, hb, own.astype("<i8").tobytes(), n.astype("<u4").tobytes(), p.astype("<u4").tobytes()), strict=True):
                    out[k].append(v)

            for s in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[s], cut[s + 1]
                put(s, _six(h[a:b]), doc[a:b], place[a:b])
            if len(decided[0]):
                order = np.argsort(decided[0], kind="stable")
                put(int(decided[0][0] % shards), None, decided[0][order], decided[1][order])
            yield pa.record_batch([pa.array(out["shard"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("h", "doc", "n", "place"))], list(out))

    return spread


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, place) of the minimizers that at least two documents have."""
    for table in groups(batches, ["shard"]):
        hs, docs, places = [], [], []
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for h, d, n, p in zip(*(table[c].to_pylist() for c in ("h", "doc", "n", "place")), strict=True):
            doc = np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(n, "<u4"))
            place = np.frombuffer(p, "<u4").astype(np.int64)
            if h is None:
                done.append((doc, place))
                continue
            six = np.zeros((len(h) // 6, 8), np.uint8)
            six[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
            hs.append(six.view(np.uint64).ravel())
            docs.append(doc)
            places.append(place)
        if hs:
            h, doc, place = np.concatenate(hs), np.concatenate(docs), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            h, doc, place = h[order], doc[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(head, len(h)))
            low, high = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
            keep = np.repeat(low != high, count) & (doc >= 0) | np.repeat(low < 0, count) & (doc >= 0)
            done.append((doc[keep], place[keep]))
        for doc, place in done:
            yield pa.record_batch([pa.array(doc), pa.array(place.astype(np.int32))], ["doc_id", "place"])


def _passages(shards: int):
    """Rows (shard, h, doc_id, start, left, text) of passages, the minimizer at text[left]; without text: start to stop
    of doc_id is a repeat already."""

    names = ["shard", "h", "doc_id", "start", "left", "text", "stop"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(iter([batch])):
                lists = rows.column(2)
                row = pc.list_parent_indices(lists).to_numpy()
                at = lists.flatten().to_numpy().astype(np.int64) + offs[row]
                doc = rows.column(0).to_numpy(zero_copy_only=False)[row]
                low, high = np.maximum(at - REACH, offs[row]), np.minimum(at + K + REACH, offs[row + 1])
                prefix = prefix_hash(data)
                h = range_hash(prefix, at, at + K)
                around = range_hash(prefix, low, high)
                order = np.lexsort((at, doc, around, h))
                h, around, doc, low, high, row, at = (x[order] for x in (h, around, doc, low, high, row, at))
                head = np.concatenate([[True], (h[1:] != h[:-1]) | (around[1:] != around[:-1])]) if len(h) else np.zeros(0, bool)
                least = doc[np.flatnonzero(head)][np.cumsum(head) - 1] if len(h) else doc
                sent, known = np.flatnonzero(doc == least), np.flatnonzero(doc > least)
                size = (high - low)[sent]
                edge = np.concatenate([[0], np.cumsum(size)])
                text = data[np.repeat(low[sent] - edge[:-1], size) + np.arange(edge[-1])]
                texts = pa.Array.from_buffers(pa.binary(), len(sent), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                shard = (mix(h[sent]) % U(shards)).astype(np.int64)
                first = low - offs[row]
                yield pa.record_batch([pa.array(shard, pa.int32()), pa.array(h[sent].view(np.int64)), pa.array(doc[sent]), pa.array(first[sent], pa.int32()), pa.array((at - low)[sent], pa.int32()), texts, pa.nulls(len(sent), pa.int32())], names)
                if len(known):  # spans of a document may be joined before they travel
                    order = np.lexsort((first[known], doc[known]))
                    k = known[order]
                    d, a, b = doc[k], first[k], (high - offs[row])[k]
                    new = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > b[:-1])])
                    g = np.cumsum(new) - 1
                    stop = np.zeros(g[-1] + 1, np.int64)
                    np.maximum.at(stop, g, b)
                    f = np.flatnonzero(new)
                    m = len(f)
                    yield pa.record_batch([pa.array(d[f] % shards, pa.int32()), pa.nulls(m, pa.int64()), pa.array(d[f]), pa.array(a[f], pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array(stop, pa.int32())], names)

    return cut


def repeats_in(text: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, start, stop) of the parts of passages, one after another in ``text``, that are covered by a string
    which starts in a passage of a smaller document too."""
    sa = suffix_array(text, LENGTH)
    same = shares_prefix(text, sa, LENGTH)[sa]
    edge = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    whole = edge[owner + 1] - np.arange(len(text)) >= LENGTH
    run = np.flatnonzero(~same)
    least = np.minimum.reduceat(np.where(whole[sa], doc[owner[sa]], NONE), run)
    hit = np.zeros(len(text), bool)
    hit[sa] = whole[sa] & (doc[owner[sa]] > np.repeat(least, np.diff(np.append(run, len(sa)))))
    p = np.flatnonzero(hit)
    new = np.concatenate([[True], (p[1:] - p[:-1] > 1) | (owner[p[1:]] != owner[p[:-1]])]) if len(p) else np.zeros(0, bool)
    f = np.flatnonzero(new)
    last = np.append(f[1:], len(p)) - 1 if len(p) else f
    passage = owner[p[f]]
    return passage, p[f] - edge[passage], p[last] + LENGTH - edge[passage]


def _in_two(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether documents other than a row's own have its key."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head), np.diff(np.append(head, len(k))))
    return out


def _may_match(h: np.ndarray, doc: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Passages that can share LENGTH bytes around their minimizer with another document's: such a string reaches
    half of REACH beyond the minimizer on one side at least, so that side's bytes must be shared."""
    out = np.zeros(len(h), bool)
    many = np.flatnonzero(_in_two(h, doc)) if len(h) else np.zeros(0, np.int64)
    half, prefix = REACH // 2, prefix_hash(data)
    at = begin + left
    for low, high in ((at - half, at + K), (at, at + K + half)):
        ok = many[(low >= begin)[many] & (high <= begin + size)[many]]
        if len(ok):
            out[ok] |= _in_two(range_hash(prefix, low[ok], high[ok]), doc[ok])
    return np.flatnonzero(out)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ["shard"]):
        known = table.filter(pc.is_null(table["text"]))
        yield from known.select(["doc_id", "start", "stop"]).to_batches()
        rows = table.filter(pc.is_valid(table["text"])).combine_chunks()
        if not rows.num_rows:
            continue
        data, offs = flat(rows["text"].combine_chunks())
        doc, start = rows["doc_id"].to_numpy(), rows["start"].to_numpy().astype(np.int64)
        h, size = rows["h"].to_numpy(), np.diff(offs)
        around = mix(range_hash(prefix_hash(data), offs[:-1], offs[1:]) ^ h.view(np.uint64))
        order = np.lexsort((doc, around))
        head = np.concatenate([[True], around[order][1:] != around[order][:-1]])
        least = np.zeros(len(doc), np.int64)
        least[order] = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        later = np.flatnonzero(doc > least)
        yield pa.record_batch([pa.array(doc[later]), pa.array(start[later], pa.int32()), pa.array((start + size)[later], pa.int32())], ["doc_id", "start", "stop"])
        stay = np.flatnonzero(doc == least)
        stay = stay[_may_match(h[stay], doc[stay], data, offs[:-1][stay], size[stay], rows["left"].to_numpy().astype(np.int64)[stay])]
        if not len(stay):
            continue
        edge = np.concatenate([[0], np.cumsum(size[stay])])
        text = data[np.repeat(offs[:-1][stay] - edge[:-1], size[stay]) + np.arange(edge[-1])]
        passage, a, b = repeats_in(text, size[stay], doc[stay])
        yield pa.record_batch([pa.array(doc[stay][passage]), pa.array(start[stay][passage] + a, pa.int32()), pa.array(start[stay][passage] + b, pa.int32())], ["doc_id", "start", "stop"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digest, kept_text = [], [], [], []
        for text, cuts in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            code = np.sort(np.asarray(cuts, np.int64))
            a, b = code >> 32, np.maximum.accumulate(code & 0xFFFFFFFF)
            new = np.concatenate([[True], a[1:] > b[:-1]])
            f = np.flatnonzero(new)
            a, b = a[f], b[np.append(f[1:], len(code)) - 1]
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
            rest = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            removed.append(int((b - a).sum()))
            spans.append(len(f))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept_text.append(rest)
        yield pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(kept_text, pa.binary())], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])


def removed_spans(docs: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, spans): doc_ids of whole copies of a smaller document, and (doc_id, start, stop) byte spans that
    repeat in the other documents (spans may overlap). ``own``: doc_id, n_bytes, sha256 of ``docs``, settled."""
    own = own.where("doc_id IS NOT NULL")
    firsts = own.where(f"n_bytes >= {LENGTH}").groupBy("sha256", "n_bytes").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = settle(own.join(small(settle(firsts)), ["sha256", "n_bytes"]).where("doc_id > least").select("doc_id"))
    size = own.agg(F.sum("n_bytes")).first()[0] or 0
    texts = docs.join(small(copies), "doc_id", "left_anti").where(F.octet_length("text") >= LENGTH).select("doc_id", "text")
    shards = max(1, int(size * 2 / (REACH + 2)) // SHARD_ROWS)
    spread = texts.mapInArrow(_spread(shards), "shard int, h binary, doc binary, n binary, place binary")
    shared = spread.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shared, "doc_id long, place int")
    places = settle(shared.groupBy("doc_id").agg(F.collect_list("place").alias("places")))
    total = places.agg(F.sum(F.size("places").cast("long"))).first()[0] or 0
    shards = max(1, total * (K + 2 * REACH) // SHARD_BYTES)
    rows = texts.join(places, "doc_id").mapInArrow(_passages(shards), "shard int, h long, doc_id long, start int, left int, text binary, stop int")
    spans = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_decide, "doc_id long, start int, stop int")
    return copies, spans


def _with_own_ids(docs: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, ids): every different text of a doc_id once, under a number of its own that keeps the order of (doc_id,
    sha256), and these numbers (uid) by doc_id and sha256."""
    pairs = own.where("doc_id IS NOT NULL").select("doc_id", "sha256").distinct()
    ordered = pairs.repartitionByRange("doc_id", "sha256").sortWithinPartitions("doc_id", "sha256")
    ids = settle(ordered.withColumn("uid", F.monotonically_increasing_id()))  # by partition, then by row: in order
    named = docs.withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256)).join(ids, ["doc_id", "sha256"])
    return settle(named.groupBy("uid").agg(F.first("text").alias("text")).withColumnRenamed("uid", "doc_id")), ids


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``docs`` (integer doc_id, text).

    kept is the remaining bytes, null where nothing was removed (then they are the text's) and empty where all was.
    Null and empty texts have no bytes; texts under LENGTH bytes lose nothing; extra columns are ignored; an empty
    table gives no rows. Matches never cross documents and are judged on the input. Rows that share doc_id and text get
    the same result; different texts of one doc_id are documents in the order of their sha256. Rows without doc_id lose
    nothing, and nothing is lost because of them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    raw = F.encode("text", "UTF-8")
    own = settle(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha256")))
    if own.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        texts, ids = _with_own_ids(docs, own)
        found = without_repeats(texts).drop("n_bytes").withColumnRenamed("doc_id", "uid")
        known = own.join(ids, ["doc_id", "sha256"], "left").join(found, "uid", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return known.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "kept")
    docs = docs.where("doc_id IS NOT NULL")
    copies, spans = removed_spans(docs, own)
    coded = F.shiftleft(F.col("start").cast("long"), 32) + F.col("stop")
    cuts = settle(spans.groupBy("doc_id").agg(F.collect_list(coded).alias("cuts")))
    touched = docs.join(small(cuts.select("doc_id")), "doc_id", "left_semi").join(cuts, "doc_id").select("doc_id", "text", "cuts")
    changed = touched.mapInArrow(_remove, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    gone = copies.select("doc_id", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"))
    both = own.join(changed.union(gone), "doc_id", "left")
    n_removed = F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long")
    return both.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir, "doc_id", "text")).drop("kept")
