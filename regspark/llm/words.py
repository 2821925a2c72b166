"""Task-side helpers shared by the text operators: words, hashes, worker-wide stores.

A word is a maximal run of bytes other than the six ASCII white-space characters
(``\\x20`` and ``\\x09``-``\\x0D``), which is exactly what ``bytes.split()`` yields.
"""

from __future__ import annotations

import sys
import types

import numpy as np

from regspark.sources.archives import _ship_by_value

MULT = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def worker_store(name: str, make):
    """A value that the Python worker keeps from task to task, until another one is asked for:
    a worker that goes on to other work does not hold the caches of the last."""
    mod = sys.modules.setdefault("_regspark_worker_store", types.ModuleType("_regspark_worker_store"))
    held = mod.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        import pyarrow as pa
        pa.default_memory_pool().release_unused()
        held[name] = make()
    return held[name]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; emptied when full so that memory stays bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        from xxhash import xxh64_intdigest
        self.limit, self.digest = limit, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = self.digest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes(words: list) -> np.ndarray:
    """64-bit hash of every word, as ``uint64``."""
    return worker_store("word_hashes", WordHashes).of(words)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal inputs stay equal, bits get spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int, mult: int = MULT) -> np.ndarray:
    """Hash of every ``k`` consecutive elements (polynomial, doubling the width)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, width = None, 0                    # hash of the first ``width`` elements
    block, size = h, 1                      # hash of ``size`` elements, size a power of two
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            part = block[width:]
            if out is None:
                out = part
            else:
                m = min(len(out), len(part))
                out = out[:m] * np.uint64(pow(mult, size, 1 << 64)) + part[:m]
            width += size
        if (size << 1) <= k:
            block = block[:-size] * np.uint64(pow(mult, size, 1 << 64)) + block[size:]
            size <<= 1
    return mix(out[:n])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive elements."""
    if len(h) < w:
        return np.empty(0, h.dtype)
    m, size = h, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def member(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted ``values``."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def shingle_hashes(words: list, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter text is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(k, len(h))))


def binary_list(column) -> list:
    """An Arrow string column as a list of UTF-8 ``bytes`` (null: empty)."""
    import pyarrow as pa
    big = pa.types.is_large_string(column.type)
    return [b or b"" for b in column.cast(pa.large_binary() if big else pa.binary()).to_pylist()]


_ship_by_value(__name__)
