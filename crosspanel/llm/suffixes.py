"""Suffix arrays by induced sorting in numpy, and permuted common prefixes up to a given length.

The byte level works bucket by bucket: all suffixes that a bucket's scan induces into itself come in rounds, those for
other buckets by one stable partition. Leftmost-smaller substrings are named in their induced order; where names repeat,
the substrings are sorted recursively: each level names pairs of the level below and so orders twice as many substrings,
until all names differ or the names cover the length that matters.
"""

from __future__ import annotations

import numpy as np

from .blocks import prefix_hash, range_hash


def smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the end counts as smallest)."""
    n = len(t)
    turn = np.flatnonzero(t[1:] != t[:-1])
    up = np.append(t[turn] < t[turn + 1], False)
    return up[np.searchsorted(turn, np.arange(n))]


def _deal(where: np.ndarray, chars: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Append ``where`` to the lists of its characters, keeping its order."""
    if not len(where):
        return
    order = np.argsort(chars, kind="stable")
    where, chars = where[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for part, c in zip(np.split(where, cuts), chars[np.concatenate([[0], cuts])].tolist(), strict=True):
        to[c].append(part)


def _induce(t: np.ndarray, is_s: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones in the order given."""
    none = np.zeros(0, np.int64)
    starts: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(leftmost, t[leftmost], starts)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    small: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[int(t[-1])].append(np.array([len(t) - 1]))

    def scan(c: int, front: np.ndarray, to: list, kind: bool) -> np.ndarray:
        """One bucket: rounds of suffixes that it induces into itself; the others are dealt out."""
        rounds = [front]
        while len(front):
            before = front[front > 0] - 1
            before = before[is_s[before] == kind]
            chars = t[before]
            front = before[chars == c]
            _deal(before[chars != c], chars[chars != c], to)
            if len(front):
                rounds.append(front)
        return np.concatenate(rounds)

    for c in range(256):
        large[c] = [scan(c, np.concatenate([none, *large[c]]), large, False)]
        for part in starts[c]:
            _deal(part - 1, t[part - 1], large)
    for c in range(255, -1, -1):
        small[c] = [scan(c, np.concatenate([none, *small[c]]), small, True)]
        down = large[c][0][::-1]
        down = down[down > 0] - 1
        down = down[is_s[down]]
        _deal(down, t[down], small)
    return np.concatenate([x for c in range(256) for x in (large[c][0], small[c][0][::-1])])


def _sort_names(names: np.ndarray, count: int, reach: int, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` (numbers below ``count``, each standing for ``reach`` substrings from its
    place on) by their first ``depth`` substrings."""
    n = len(names)
    if count == n or reach >= depth:
        return np.argsort(names, kind="stable")
    after = np.zeros(n, np.int64)  # beyond the end is smallest
    after[: max(0, n - reach)] = names[reach:] + 1
    pairs = names * (count + 1) + after
    distinct, higher = np.unique(pairs, return_inverse=True)
    return _sort_names(higher, len(distinct), 2 * reach, depth)


def suffix_array(t: np.ndarray, length: int | None = None) -> np.ndarray:
    """Starts of the suffixes of the bytes ``t`` in ascending order; a suffix that is a prefix of another comes first.

    With ``length`` only the first ``length`` bytes decide: suffixes that share them stand together in any order.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    is_s = smaller(t)
    leftmost = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sa = _induce(t, is_s, leftmost)
    if len(leftmost) < 2:
        return sa
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = sa[is_leftmost[sa]]
    place = np.zeros(n, np.int64)
    place[leftmost] = np.arange(len(leftmost))
    stop = np.append(leftmost[1:] + 1, n)[place[order]]
    h = range_hash(prefix_hash(t), order, stop)
    new = np.concatenate([[False], (h[1:] != h[:-1]) | (stop[1:] - order[1:] != stop[:-1] - order[:-1]) | (stop[1:] == n) | (stop[:-1] == n)])
    name = np.cumsum(new)
    reduced = np.zeros(len(leftmost), np.int64)
    reduced[place[order]] = name
    if name[-1] + 1 < len(leftmost):
        # two neighbouring leftmost-smaller suffixes are two bytes apart at least
        order = leftmost[_sort_names(reduced, int(name[-1]) + 1, 1, n if length is None else length // 2 + 1)]
    return _induce(t, is_s, order)


def shares_prefix(t: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Per position in text order: whether it has ``length`` bytes in common with the suffix before it in ``sa``
    (the permuted common prefix, cut off at ``length``; beyond the end are zeros)."""
    padded = np.concatenate([t, np.zeros(length + 8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    before = np.full(len(t), -1)
    before[sa[1:]] = sa[:-1]
    p = np.flatnonzero(before >= 0)
    q = before[p]
    as_number = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        as_number |= padded[j : len(padded) - 7 + j].astype(np.uint64) << np.uint64(8 * j)
    del word
    for off in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = as_number[p + off] == as_number[q + off]
        p, q = p[same], q[same]
    out = np.zeros(len(t), bool)
    out[p] = True
    return out
