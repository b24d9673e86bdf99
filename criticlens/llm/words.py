"""Word positions and rolling hashes of whole texts, vectorised over a chunk of documents.

Spark partitions and shuffles the documents; these helpers only turn the texts of one Arrow batch
into arrays. Nothing is cut: a text longer than the chunk size becomes a chunk of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

CHUNK_BYTES = 1 << 20
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)

#: The white space of the word rule [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Terms are runs of ASCII letters and digits and of everything beyond ASCII.
_NO_TERM = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _NO_TERM[_low:_high] = False

_powers: dict[int, np.ndarray] = {}


def ship(module: str) -> None:
    """Send the functions of ``module`` to the executors by value, so that they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` characters, or of one longer document."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of a chunk: byte spans, the first word of each document, and word hashes."""

    def __init__(self, texts: list[str | None], terms: bool = False):
        encoded = [(t.lower() if terms else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = b"\n".join(encoded) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        gap = (_NO_TERM if terms else _SPACE)[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.raw = raw

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, the same wherever the word stands."""
        if not len(self):
            return np.zeros(0, np.uint64)
        value = (self.raw.astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, len(self.raw))
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        span = total[self.ends] - total[self.starts]
        return mixed(span * powers(inverse(_BYTE_BASE), len(self.raw))[self.starts])

    def document(self) -> np.ndarray:
        """The index within the chunk of each word's document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text_of(self, i: int) -> list[bytes]:
        a, b = self.first[i], self.first[i + 1]
        return [self.data[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; empty when there are fewer than k values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_WORD_BASE, len(hashes)), out=total[1:])
    return mixed((total[k:] - total[:n]) * powers(inverse(_WORD_BASE), n))


def windows(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the k-word windows that stay in one document, and their hashes."""
    rolled = rolling(hashes, k)
    if not len(rolled):
        return np.zeros(0, np.int64), rolled
    end = np.repeat(words.first[1:], words.counts)[: len(rolled)]
    at = np.flatnonzero(np.arange(len(rolled)) + k <= end)
    return at, rolled[at]


ship(__name__)
