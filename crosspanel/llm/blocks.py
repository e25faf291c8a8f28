"""Arrow text batches as flat numpy arrays: bytes, words, shingles and their 64-bit hashes.

Everything works on slices of about ``CHUNK`` bytes, so a task's memory does not depend on its number of rows; a
longer text makes a slice of its own. Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes, null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
#: Odd multipliers of the polynomial hashes (fixed values; any odd numbers do).
BASE, STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits: for comparisons that punctuation must not disturb.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with about ``most`` bytes each; text of row i is bytes[offsets[i]:offsets[i + 1]]."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at), *flat(texts.slice(at, to - at))
            at = to
        del texts, batch
        pa.default_memory_pool().release_unused()  # a worker lives on for other operators


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    _, where, data = texts.buffers()
    offs = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of data[k] * BASE**k over i <= k < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, equal for equal contents wherever they stand."""
    back = powers(pow(BASE, -1, 1 << 64), len(prefix))
    return mix(((prefix[ends] - prefix[starts]) * back[starts]) ^ ((ends - starts).astype(np.uint64) * U(STEP)))


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words; no word crosses two rows."""
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = offs[:-1][offs[:-1] < len(data)], offs[1:][offs[1:] > 0] - 1
    first[begin], last[end] = inside[begin], inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every n consecutive hashes (length len - n + 1)."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        total += hashes[j : len(hashes) - n + 1 + j] * U(pow(STEP, j, 1 << 64))
    return mix(total ^ U(n))


def shingles(data: np.ndarray, offs: np.ndarray, n: int = 5, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): row i has the n-word shingles hashes[bounds[i]:bounds[i + 1]], in order, repeats kept.

    A-Z count as a-z. Fewer than n words: the whole sequence is the one shingle; no word: none.
    """
    low = LOWER[data]
    starts, ends, row = words(low, offs, space)
    hashed = range_hash(prefix_hash(low), starts, ends)
    rows = len(offs) - 1
    per = np.bincount(row, minlength=rows)
    full = runs(hashed, n)
    own = np.flatnonzero(row[: len(full)] == row[n - 1 :]) if len(full) else np.zeros(0, np.int64)
    value, at = full[own], row[own]
    few = np.flatnonzero((per > 0) & (per < n))
    if len(few):
        begin = np.cumsum(per) - per
        short = [runs(hashed[begin[i] : begin[i] + per[i]], int(per[i]))[0] for i in few]
        value, at = np.concatenate([value, np.array(short, np.uint64)]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    return value, np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows))])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal ``keys`` from batches of rows that are sorted by them."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if kept and any(kept[-1].column(kept[-1].schema.get_field_index(k))[-1].as_py() != batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys):
            yield pa.Table.from_batches(kept)
            kept = []
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if i:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)
