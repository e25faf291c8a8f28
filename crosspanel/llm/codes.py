"""Vector code compression: eight codebooks of sixteen entries per vector, assigned under norm-of-sum bounds.

A vector is cut into ``PARTS`` equal parts; each part position has a codebook that rounds of assignment and replacement
refine in whole numbers. Per part a row keeps its entry, an upper bound of the distance to it, a lower bound of the
distance to every other entry, and the round in which each bound was exact (its stamp). The history of all codebooks is
kept: a bound of round s holds in round t after the net displacement |entry(t) - entry(s)| is added or taken off. That
is at most the sum of the drifts between s and t and far less where entries swing back. Only parts whose bounds do not
settle the nearest entry are compared exactly: first with their own entry, then with all.

A round is one pass over a table in the shared folder: it writes the rows with their new bounds, and beside them the sums
of each task, so a lost task is done again as a whole. Sums are added up by Spark; 8 * 16 rows of sums and the codebooks
are all that the driver sees. A round's table is deleted when the next one is complete.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, settle, shared_folder, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Relative and absolute slack of a bound, far above the rounding of doubles: ties are always compared exactly.
SLACK = 1e-6


@dataclass
class Books:
    """The codebooks of all rounds: ``history[t]`` is (parts, entries, width) in whole numbers, used by assignment t."""

    history: list[np.ndarray]
    length: int
    #: parts compared with their own entry, and with all entries, per assignment
    tightened: list[int] = field(default_factory=list)
    rescanned: list[int] = field(default_factory=list)

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """(stamps, parts, entries) twice: net displacement of each entry since the stamp, and the largest of the others'."""
        now = self.history[-1].astype(float)
        own = np.stack([np.sqrt(((now - past) ** 2).sum(-1)) for past in self.history])
        k = own.shape[-1]
        others = np.zeros_like(own) if k < 2 else np.stack([np.delete(own, j, -1).max(-1) for j in range(k)], -1)
        return own, others


def usable(vector: str) -> Column:
    """Whether the vector is there and all of its components are finite numbers (NaN is above infinity in Spark)."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def whole(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length): floor(SCALE * x), rows filled up with zeros. Beyond 2**30 / sqrt(width) distances would not fit in
    64 bits: an error."""
    offs = np.asarray(column.offsets)
    flat = np.asarray(column.values.slice(offs[0], offs[-1] - offs[0])).astype(float)
    size = np.diff(offs)
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() > 2**30 / max(1.0, (length / PARTS) ** 0.5):
        raise OverflowError(f"a component of {np.abs(flat).max()} is too large for exact distances in 64 bits")
    out = np.zeros((len(size), length), np.int64)
    out[np.arange(length) < size[:, None]] = scaled.astype(np.int64)
    return out


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(rows, entries) squared distances, exact: in doubles while all sums stay under 2**53, else in 64-bit integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * max(1, x.shape[1]) * top * top < 2**53 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry (ties to the lower index), its distance, and the distance to the nearest other entry (infinite without one)."""
    d = distances(x, book)
    best = d.argmin(1)
    at = np.arange(len(x))
    first = d[at, best].astype(float)
    if d.shape[1] < 2:
        return best, np.sqrt(first), np.full(len(x), np.inf)
    d[at, best] = np.iinfo(np.int64).max
    return best, np.sqrt(first), np.sqrt(d.min(1).astype(float))


@dataclass
class State:
    """Bounds of a batch: all arrays are (rows, PARTS)."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    upper_stamp: np.ndarray
    lower_stamp: np.ndarray

    @staticmethod
    def unknown(rows: int) -> State:
        """Nothing known: every part is to be compared with all entries."""
        return State(np.zeros((rows, PARTS), np.uint8), np.full((rows, PARTS), np.inf, np.float32), np.zeros((rows, PARTS), np.float32), np.zeros((rows, PARTS), np.uint8), np.zeros((rows, PARTS), np.uint8))


def assign(x: np.ndarray, state: State, books: Books) -> tuple[int, int]:
    """Bring ``state`` to the latest codebooks; how many parts had to be tightened and how many rescanned."""
    now = len(books.history) - 1
    own, others = books.moved()
    width = books.length // PARTS
    tight = scanned = 0
    for p in range(PARTS):
        entry = state.entry[:, p]
        low = state.lower[:, p] - others[state.lower_stamp[:, p], p, entry]
        high = state.upper[:, p] + own[state.upper_stamp[:, p], p, entry]
        open_ = np.flatnonzero(~(high * (1 + SLACK) + SLACK < low))
        if not len(open_):
            continue
        part = x[open_, p * width : (p + 1) * width]
        book = books.history[-1][p]
        known = np.flatnonzero(np.isfinite(state.upper[open_, p]))
        diff = part[known] - book[state.entry[open_[known], p]]
        exact = np.full(len(open_), np.inf)
        exact[known] = np.sqrt((diff * diff).sum(1).astype(float))
        tight += len(known)
        state.upper[open_[known], p] = np.nextafter(exact[known].astype(np.float32), np.float32(np.inf))
        state.upper_stamp[open_[known], p] = now
        left = ~(exact * (1 + SLACK) + SLACK < low[open_])
        rows, part = open_[left], part[left]
        scanned += len(rows)
        if len(rows):
            best, first, second = nearest(part, book)
            state.entry[rows, p], state.upper_stamp[rows, p], state.lower_stamp[rows, p] = best, now, now
            state.upper[rows, p] = np.nextafter(first.astype(np.float32), np.float32(np.inf))
            state.lower[rows, p] = np.nextafter(second.astype(np.float32), np.float32(-np.inf))
    return tight, scanned


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width or 1)[: rows + 1] if width else np.zeros(rows + 1, int), pa.int32()), pa.array(values.ravel(), kind))


def _bytes(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, rows * width + 1, width, np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Values of a list or binary column whose rows all have ``width`` of them."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).copy()
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), width)


STATE = "v array<int>, entry binary, upper array<float>, lower array<float>, upper_stamp binary, lower_stamp binary"


def _pass(rows: DataFrame, books: Books, first: bool) -> str:
    """Assign all ``rows`` (from the vectors if ``first``, else from a table of bounds); the path of the table written. It
    has two kinds of rows: bounds, and sums (part, entry, place, total) per task, place -1 being the count."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"kind string, vec_id {fields['vec_id']}, label {fields['label']}, {STATE}, part int, slot int, place int, total long"
    length = books.length

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, ENTRIES, length // PARTS + 1), np.int64)
        tight = scanned = 0
        ids = None
        for batch in batches:
            n = batch.num_rows
            ids = batch.column("vec_id").type, batch.column("label").type
            if first:
                x, state = whole(batch.column("embedding"), length), State.unknown(n)
            else:
                x = _matrix(batch.column("v"), length, np.int64)
                stamps = [_matrix(batch.column(c), PARTS, np.uint8) for c in ("entry", "upper_stamp", "lower_stamp")]
                state = State(stamps[0], _matrix(batch.column("upper"), PARTS, np.float32), _matrix(batch.column("lower"), PARTS, np.float32), *stamps[1:])
            t, s = assign(x, state, books)
            tight, scanned = tight + t, scanned + s
            cut = x.reshape(n, PARTS, -1)
            for p in range(PARTS):
                for e in np.unique(state.entry[:, p]).tolist():
                    own = state.entry[:, p] == e
                    sums[p, e, :-1] += cut[own, p].sum(0)
                    sums[p, e, -1] += own.sum()
            none = [pa.nulls(n, pa.int32())] * 3 + [pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(["row"] * n), batch.column("vec_id"), batch.column("label"), _lists(x, pa.int32()), _bytes(state.entry), _lists(state.upper, pa.float32()), _lists(state.lower, pa.float32()), _bytes(state.upper_stamp), _bytes(state.lower_stamp), *none], names)
        if ids:
            p, e, c = np.nonzero(sums)
            total = np.append(sums[p, e, c], [tight, scanned])
            c = np.append(np.where(c == sums.shape[2] - 1, -1, c), [-2, -3])
            p, e, n = np.append(p, [0, 0]), np.append(e, [0, 0]), len(total)
            gone = [pa.nulls(n, t) for t in (*ids, pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(["sum"] * n), *gone, *(pa.array(a, pa.int32()) for a in (p, e, c)), pa.array(total, pa.int64())], names)

    names = ["kind", "vec_id", "label", "v", "entry", "upper", "lower", "upper_stamp", "lower_stamp", "part", "slot", "place", "total"]
    path = f"{shared_folder(rows.sparkSession)}/codes-{uuid.uuid4().hex}"
    rows.mapInArrow(work, schema).write.partitionBy("kind").parquet(path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a table of an earlier round: what followed from it is complete in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("kind = 'row'").select("vec_id", "label", *(c.split()[0] for c in STATE.split(", ")))


def _sums(spark: SparkSession, path: str, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) as Python integers, from at most PARTS * ENTRIES * (width + 1) added-up rows; notes the rescans."""
    rows = spark.read.parquet(path).where("kind = 'sum'").groupBy("part", "slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = np.zeros(books.history[-1].shape, object)
    counts = np.zeros(books.history[-1].shape[:2], object)
    noted = {-2: 0, -3: 0}
    for r in rows:
        if r["place"] < -1:
            noted[r["place"]] = int(r["total"])
        elif r["place"] == -1:
            counts[r["part"], r["slot"]] = int(r["total"])
        else:
            sums[r["part"], r["slot"], r["place"]] = int(r["total"])
    books.tightened.append(noted[-2])
    books.rescanned.append(noted[-3])
    return sums, counts


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[Books, str] | None:
    """Codebooks after ``rounds``, and the path of a table with every row's final bounds; None without a usable vector.

    ``vectors``: vec_id, embedding, label. Starts are the parts of the ``ENTRIES`` smallest vec_ids (rows without one come
    last, repeated ones by their vectors); fewer rows give fewer entries.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").where(usable("embedding"))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    length = max(1, -(-longest // PARTS)) * PARTS
    starts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    rows = whole(pa.array([r["embedding"] for r in starts], pa.list_(pa.float64())), length)
    books = Books([rows.reshape(len(rows), PARTS, -1).transpose(1, 0, 2)], length)
    path = _pass(kept, books, True)
    for _ in range(rounds):
        sums, counts = _sums(spark, path, books)
        new = books.history[-1].copy()
        for p, e in zip(*np.nonzero(counts), strict=True):
            new[p, e] = [int(s) // int(counts[p, e]) for s in sums[p, e]]
        books.history.append(new)
        before, path = path, _pass(_state(spark, path), books, False)
        _drop(spark, before)
    _sums(spark, path, books)
    return books, path


SCHEMA = "code string, error long"


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per usable row of ``vectors`` (vec_id, embedding, label).

    Rows without a vector, or with a component that is null or not finite, are left out. Vectors of other lengths are
    filled up with zeros to the longest one and to a multiple of ``PARTS``; repeated rows and vec_ids count each; rows
    without a label share one sum. Components beyond 2**30 / sqrt(width) after scaling are an error. Extra columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    found = fit(vectors, rounds)
    if found is None:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    books, path = found
    length, last = books.length, books.history[-1]
    text = ",".join(str(int(x)) for x in last.ravel())

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), length, np.int64).reshape(batch.num_rows, PARTS, -1)
            entry = _matrix(batch.column("entry"), PARTS, np.uint8)
            diff = x - last[np.arange(PARTS), entry]
            code = pa.array([bytes(row).hex() for row in entry], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array((diff * diff).sum((1, 2)), pa.int64())], ["vec_id", "label", "code", "error"])

    coded = settle(_state(spark, path).select("vec_id", "label", "v", "entry").mapInArrow(report, f"vec_id {kinds['vec_id']}, label {kinds['label']}, {SCHEMA}"))
    _drop(spark, path)
    total = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(small(settle(total), BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    steps = []
    for t in range(ROUNDS + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT rid, part, entry, dist FROM (SELECT rid, part, entry, sum((x - c) * (x - c)) AS dist FROM x JOIN b{t} USING (part, pos) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY dist, entry) = 1)""")
        if t < ROUNDS:
            steps.append(f"""b{t + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m, c) AS c FROM b{t} LEFT JOIN
  (SELECT part, entry, pos, CAST((s - (s % n + n) % n) // n AS BIGINT) AS m FROM (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{t} USING (rid, part) GROUP BY ALL)) USING (part, entry, pos))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, (i - 1) // (len(v) // {PARTS}) AS part, (i - 1) % (len(v) // {PARTS}) AS pos, v[i] AS x FROM (SELECT rid, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS (SELECT part, rid - 1 AS entry, pos, x AS c FROM x WHERE rid <= {ENTRIES}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT rid, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(dist) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, lower(code) AS code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books"""
