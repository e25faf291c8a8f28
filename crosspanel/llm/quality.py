"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document.

Layers: one learned weight per (tap, byte, filter), i.e. a convolution of width 8 and stride 4 over one-hot bytes;
the largest response of each filter in every chunk of 1024 bytes (step 512) through a rectifier; mean and maximum of
those over all chunks; a logistic unit on both. The gradient reaches the filters through the pooled positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import slices
from .shared import documents, fresh, quoted, sampled

TAPS, STRIDE, FILTERS = 8, 4, 24
#: Windows in half a chunk; a chunk is two neighbouring halves. Halves whose responses are held at once.
HALF, AT_ONCE = 128, 128
#: Labelled rows to fit on at most (by hash of doc_id), each with its whole text. Scoring has no such bound.
TRAIN_ROWS = 4000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-4
THRESHOLD = 0.3


@dataclass
class Network:
    taps: np.ndarray  # (TAPS, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (2 * FILTERS + 1,): weights of means, of maxima, constant

    def responses(self, quads: np.ndarray) -> np.ndarray:
        """(windows, FILTERS) for bytes in rows of STRIDE; the window of a row reaches into the next."""
        out = np.repeat(self.bias[None], len(quads) - 1, 0)
        for k in range(TAPS):
            out += self.taps[k][quads[k // STRIDE : len(quads) - 1 + k // STRIDE, k % STRIDE]]
        return out


def layout(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quads, starts, rows): texts in rows of STRIDE bytes with a zero row after each; first window and text of
    every half chunk. An empty text is one window of zeros."""
    size = np.diff(offs)
    need = np.maximum(1, -(-size // STRIDE)) + 1
    begin = np.cumsum(need) - need
    buf = np.zeros(int(need.sum()) * STRIDE, np.uint8)
    for a, b, at in zip(offs[:-1].tolist(), offs[1:].tolist(), (begin * STRIDE).tolist(), strict=True):
        buf[at : at + b - a] = data[a:b]
    halves = -(-(need - 1) // HALF)
    rows = np.repeat(np.arange(len(size)), halves)
    starts = begin[rows] + HALF * (np.arange(len(rows)) - (np.cumsum(halves) - halves)[rows])
    return buf.reshape(-1, STRIDE), starts, rows


def chunks_of(halves: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk maxima from half-chunk maxima, and the first chunk of each text."""
    same = rows[1:] == rows[:-1]
    joined = halves.copy()
    joined[:-1][same] = np.maximum(halves[:-1][same], halves[1:][same])
    count = np.bincount(rows)
    keep = np.ones(len(rows), bool)
    last = np.cumsum(count) - 1
    keep[last[count > 1]] = False  # the last half of a longer text is in its last chunk already
    return joined[keep], np.cumsum(np.maximum(1, count - 1)) - np.maximum(1, count - 1)


def score(net: Network, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    quads, starts, rows = layout(data, offs)
    quads = np.concatenate([quads, np.zeros((1, STRIDE), np.uint8)])
    pooled = np.zeros((len(starts), FILTERS), np.float32)
    for k in range(0, len(starts), AT_ONCE):
        # the window after a text's last one is the zero row before the next text: it never exceeds a padded window
        low, high = starts[k], starts[k + AT_ONCE] if k + AT_ONCE < len(starts) else len(quads) - 1
        pooled[k : k + AT_ONCE] = np.maximum.reduceat(net.responses(quads[low : high + 1]), starts[k : k + AT_ONCE] - low, 0)
    chunk, first = chunks_of(np.maximum(pooled, 0), rows)
    count = np.diff(np.append(first, len(chunk)))
    features = np.concatenate([np.add.reduceat(chunk, first, 0) / count[:, None], np.maximum.reduceat(chunk, first, 0)], 1)
    return 1 / (1 + np.exp(-np.clip(features @ net.top[:-1] + net.top[-1], -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Network:
    """Adam on log loss. Constant labels or no rows give a network that answers with their share (0.5 for none)."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (TAPS, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS + 1))
    if not len(labels) or labels.min() == labels.max():
        net.top[-1] = 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
        return net
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    net.top[:-1] = rng.normal(0, 0.05, 2 * FILTERS)
    params = [net.taps, net.bias, net.top]
    m, v, step = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
            quads, starts, rows = layout(data, offs)
            quads = np.concatenate([quads, np.zeros((1, STRIDE), np.uint8)])
            z = net.responses(quads)
            ends = np.append(starts[1:], len(z))
            arg = np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)])  # (halves, FILTERS)
            peak = np.take_along_axis(z, arg, 0)
            act = np.maximum(peak, 0)
            # chunks of one and two halves with the half that won
            same = rows[1:] == rows[:-1]
            win = np.arange(len(rows))[:, None].repeat(FILTERS, 1)
            win[:-1][same] += act[1:][same] > act[:-1][same]
            count = np.bincount(rows)
            keep = np.ones(len(rows), bool)
            keep[(np.cumsum(count) - 1)[count > 1]] = False
            win, owner = win[keep], rows[keep]
            chunk = np.take_along_axis(act, win, 0)
            number = np.bincount(owner)
            first = np.cumsum(number) - number
            mean, top = np.add.reduceat(chunk, first, 0) / number[:, None], np.maximum.reduceat(chunk, first, 0)
            features = np.concatenate([mean, top, np.ones((len(part), 1))], 1)
            p = 1 / (1 + np.exp(-np.clip(features @ net.top, -30, 30)))
            delta = (p - labels[part]) * weight[part] / len(part)
            grad_top = features.T @ delta + DECAY * net.top
            back = (delta / number)[owner, None] * net.top[:FILTERS]
            is_top = chunk == top[owner]
            back = back + is_top * (delta[owner, None] * net.top[FILTERS:-1])
            half_grad = np.zeros(act.shape)
            np.add.at(half_grad, (win, np.arange(FILTERS)[None].repeat(len(win), 0)), back)
            half_grad *= peak > 0
            grad_taps = np.zeros(net.taps.shape)
            f = np.arange(FILTERS)[None].repeat(len(arg), 0)
            for k in range(TAPS):
                np.add.at(grad_taps[k], (quads[arg + k // STRIDE, k % STRIDE], f), half_grad)
            step += 1
            for i, g in enumerate((grad_taps, half_grad.sum(0), grad_top)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(params[i].dtype)
    return net


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """Fit on at most ``rows`` labelled documents that are not held out; rows without a label or text take no part."""
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out())
    chosen = sampled(known, rows, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    pairs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    got = pairs.select("doc_id", "quality", F.encode("text", "UTF-8").alias("raw")).orderBy(F.xxhash64("doc_id", "raw"), "doc_id", "quality").limit(rows).collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return fit([bytes(r[2]) for r in got], np.array([r[1] for r in got]))


def with_score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 from the whole text; null counts as empty. Nothing is shuffled."""
    share = docs.sparkSession.sparkContext.broadcast(net)  # 0.2 MB whatever the input

    def apply(text: pa.Array) -> pa.Array:
        batch = pa.record_batch([text], ["text"])
        return pa.array(np.concatenate([score(share.value, d, o) for _, d, o in slices(iter([batch]), most=1 << 18)] or [np.zeros(0)]), pa.float64())

    return docs.withColumn(name, F.arrow_udf(apply, "double")(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; only text is an input of the score.

    Null and empty texts are scored as empty ones, repeated rows each; extra columns are ignored; an empty table gives
    no rows, and without usable labels the score is 0.5 everywhere.
    """
    net = train(docs, labels)
    return with_score(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns stay as they are. Null and empty texts are judged as
    empty ones, repeated rows each; an empty table stays empty."""
    name = fresh(docs, "score")
    return with_score(docs, train(docs, labels), name).where(F.col(name) >= THRESHOLD).select(*quoted(*docs.columns))


def op6_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
