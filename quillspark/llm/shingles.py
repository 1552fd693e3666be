"""Word shingles and MinHash signatures, computed on whole Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # after lower-casing A-Z: the words of the operators' contracts
CACHED_WORDS = 400_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = 0x9E3779B97F4A7C15
ROWS_AT_ONCE = 8_192


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    found = _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run, one without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(_STEP) + words[k : len(words) - width + 1 + k]
    return np.unique(_mixed(out + np.uint64(width)))


def coefficients(n: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """One row of ``n`` 32-bit MinHash values per set; rows of empty sets are all ones."""
    a, b = coefficients(n)
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        for at in range(0, len(s), ROWS_AT_ONCE):
            values = s[at : at + ROWS_AT_ONCE, None] * a
            values += b
            out[i] = np.minimum(out[i], (values.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = _mixed(out + parts[:, :, k] + np.uint64(k))
    return out.astype(np.int64)
