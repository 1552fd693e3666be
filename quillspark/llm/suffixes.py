"""Suffix arrays by the difference-cover algorithm, in NumPy.

Suffixes that start at positions 1 and 2 modulo 3 are sorted by their first three symbols; where those names are not
yet all different, the text of names is sorted by recursion.  The other suffixes are sorted by their first symbol and
the rank of what follows, and merged in.  As all suffixes are wanted in order only up to some depth, recursion ends
as soon as the names cover that depth.
"""

from __future__ import annotations

import numpy as np


def _ordered(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows of symbols; rows are packed into one number each where that is possible."""
    bits = [max(int(c.max(initial=0)).bit_length(), 1) for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    return np.argsort(_packed(columns, bits))


def _packed(columns: list[np.ndarray], bits: list[int]) -> np.ndarray:
    key = columns[0]
    for c, width in zip(columns[1:], bits[1:], strict=True):
        key = (key << width) | c
    return key


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Rank of each row of symbols among the distinct rows, from 1, and their number."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), 0
    order = _ordered(columns)
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        sorted_c = c[order]
        new[1:] |= sorted_c[1:] != sorted_c[:-1]
    ranks = np.cumsum(new)
    out = np.empty(len(order), np.int64)
    out[order] = ranks
    return out, int(ranks[-1])


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (integers from 1 up), in order.

    With a ``depth``, suffixes that agree in their first ``depth`` symbols may be in any order.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with one past the end where needed, so that every third has a neighbour
    sample = np.concatenate([ones, np.arange(2, n, 3)])
    names, distinct = _names([padded[sample], padded[sample + 1], padded[sample + 2]])
    if distinct < len(sample) and (depth is None or depth > 3):
        order = suffix_array(names, None if depth is None else -(-depth // 3))
        ranked = np.empty(len(sample), np.int64)
        ranked[order] = np.arange(1, len(sample) + 1)
    else:
        ranked = np.empty(len(sample), np.int64)
        ranked[np.argsort(names)] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = ranked
    by_rank = np.empty(len(sample), np.int64)
    by_rank[ranked - 1] = sample
    by_rank = by_rank[by_rank < n]
    rest = np.arange(0, n, 3)
    rest = rest[_ordered([padded[rest], rank[rest + 1]])]
    return _merged(padded, rank, by_rank, rest)


def _merged(text: np.ndarray, rank: np.ndarray, sample: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Merge two sorted lists of suffixes: for every suffix of ``rest`` find how many of ``sample`` come before it.

    A suffix at 0 modulo 3 is compared with one at 1 by a symbol and a rank, with one at 2 by two symbols and a
    rank.  Both comparisons agree with one order, so the sample is split in two lists, each searched for on its own.
    """
    before = np.zeros(len(rest), np.int64)
    for kind in (1, 2):
        own = sample[sample % 3 == kind]
        if not len(own):
            continue
        keys = [np.concatenate([text[own + k], text[rest + k]]) for k in range(kind)]
        keys.append(np.concatenate([rank[own + kind], rank[rest + kind]]))
        side = np.concatenate([np.zeros(len(own), np.int64), np.ones(len(rest), np.int64)])
        order = _ordered([*keys, side])
        seen = np.cumsum(side[order] == 0)
        found = np.empty(len(order), np.int64)
        found[order] = seen
        before += found[len(own) :]
    # with a depth, comparisons of suffixes that agree up to it may contradict each other
    before = np.maximum.accumulate(before) if len(before) else before
    out = np.empty(len(sample) + len(rest), np.int64)
    places = np.arange(len(rest)) + before
    taken = np.zeros(len(out), bool)
    taken[places] = True
    out[places] = rest
    out[~taken] = sample
    return out


def shared_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes of ``data`` (bytes) at ``a`` and ``b`` agree in their first ``depth`` bytes.

    Eight bytes are compared at a time, from the far end on: there, neighbours in a suffix order differ first.
    """
    n = len(data)
    agree = (a + depth <= n) & (b + depth <= n)
    words = np.zeros(n, np.uint64)
    for k in range(min(8, depth)):
        words[: n - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    last = max(depth - 8, 0)
    for at in [last, *range(0, last, 8)]:
        rows = np.nonzero(agree)[0]
        if not len(rows):
            break
        agree[rows] = words[a[rows] + at] == words[b[rows] + at]
    return agree
