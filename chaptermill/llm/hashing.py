"""Word and shingle hashes of whole batches of texts in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

_GENERATOR = np.random.default_rng(20240229)
_SYMBOL = _GENERATOR.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = _GENERATOR.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are taken at once, if no single text has more.
CHUNK_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes the words (A-Z lower-cased) of many texts at once."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
            self.inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)]))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where each text's words start (one more than texts)."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        self._grow(max(len(data), CHUNK_BYTES))
        gap = _GAP[data]
        opens = ~gap
        opens[1:] &= gap[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        opens[firsts] = ~gap[firsts]
        starts = np.flatnonzero(opens)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        values = _SYMBOL[_LOWER[data]] * self.powers[: len(data)]
        values[gap] = 0
        hashes = mixed(np.add.reduceat(values, starts) * self.inverses[starts])
        return hashes, np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, one for each start."""
    n = len(hashes) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        total += hashes[i : i + len(total)] * _STEP[i]
    return mixed(total)


def text_chunks(column, limit: int = CHUNK_BYTES):
    """(start, list of texts as bytes) of a pyarrow string column, nulls as empty."""
    at, held, size = 0, [], 0
    for i, value in enumerate(column):
        b = value.as_py()
        b = b.encode("utf-8", "surrogatepass") if b else b""
        held.append(b)
        size += len(b)
        if size > limit:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held
