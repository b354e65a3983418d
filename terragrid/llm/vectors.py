"""Words of many texts at once, as numpy arrays: bounds, hashes, runs of words.

Hashes are polynomials modulo 2^64 over bytes, then over words, each finished by
a mixing step; they depend on the bytes of the words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are held as arrays at once; a longer text is taken alone.
CHUNK = 1 << 20
#: Bytes of text that are hashed at once: their sums stay in the processor's cache.
HASHED = 1 << 16

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_plain = np.ones(256, bool)  # everything but ASCII letters and digits and bytes of other scripts
_plain[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_codes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((int(_BASE), _inverse(int(_BASE)))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all of them."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hashes_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word of ``data``, from its first byte to the one before its end."""
    power, inverse = _grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_codes[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


class Words:
    """Words of ``texts``, in order; ``doc`` is the index of a word's text.

    With ``plain``, ASCII signs part words as white space does.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False, plain: bool = False):
        joined = b"\n".join([t or b"" for t in texts]) + b"\n"
        if lower:
            joined = joined.lower()  # of bytes: A-Z only
        self.data = np.frombuffer(joined, np.uint8)
        solid = ~(_plain if plain else _space)[self.data]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if len(solid) and solid[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        #: index of the first word of each text, and one more entry
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._solid = solid

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        cuts = np.unique(np.searchsorted(self.start, np.arange(0, len(self.data) + HASHED, HASHED)))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = self.start[i], self.end[j - 1]
            out[i:j] = hashes_at(self.data[lo:hi], self.start[i:j] - lo, self.end[i:j] - lo)
        return out

    def packed(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one space, and where each begins."""
        after = np.zeros(len(self.data), bool)
        after[self.end] = True  # there is white space after every word
        out = np.where(self._solid, self.data, np.uint8(0x20))[self._solid | after]
        return out.tobytes(), np.concatenate([[0], np.cumsum(self.end - self.start + 1)])


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    power = np.uint64(1)
    for j in range(k):
        total += h[j : j + n] * power
        power = np.uint64(int(power) * int(_WORD_BASE) & 0xFFFFFFFFFFFFFFFF)
    return mix(total)


#: Bytes of an Arrow batch between Spark and a task's Python, unless the session names its own.
BATCH_BYTES = 4 << 20


def small_batches(spark) -> None:
    """Bound the batches of whole texts by bytes: ten thousand rows of them can be hundreds of MB on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about ``most`` bytes of text each, and their texts as bytes."""
    for whole in batches:
        # a first cut by the mean size, so that few texts are held as objects at once
        step = max(16, int(2 * most * whole.num_rows / max(1, whole.nbytes)))
        for from_row in range(0, whole.num_rows, step):
            batch = whole.slice(from_row, step)
            texts = batch.column(column).cast(pa.large_binary()).to_pylist()
            at, size = 0, 0
            for i, t in enumerate(texts):
                own = len(t) if t else 0
                if i > at and size + own > most:
                    yield batch.slice(at, i - at), texts[at:i]
                    at, size = i, 0
                size += own
            if at < len(texts):
                yield batch.slice(at), texts[at:]
