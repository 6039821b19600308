"""Words and their hashes for many texts at once, in numpy over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from rasterweave.llm.common import mix

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit value for each byte, capitals like small letters.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_STEPS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below n, grown as needed."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text boundaries (into the words) of the runs of ``[^\\x20\\x09-\\x0D]``."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _IS_WORD[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[edges] = inside[edges]
    end = inside[:-1] & ~inside[1:]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Spans:
    """64-bit hashes of any byte spans of a buffer: polynomial prefix sums, then mixing with the length."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[data] * powers[: len(data)], out=self.prefix[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
            return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(data).hashes(starts, ends)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text and the bounds of the texts among them; repeats stay.

    A text of 1 to 4 words gives one shingle, its whole sequence; a text without words gives none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(out_bounds[-1])
    with np.errstate(over="ignore"):
        total = np.zeros(len(first), dtype=np.uint64)
        last = np.repeat(bounds[1:], n)
        for k in range(SHINGLE):
            at = first + k
            there = at < last
            total += np.where(there, words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(0x5851F42D4C957F2D)) * _STEPS[k]
    return mix(total), out_bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text."""
    starts, ends, bounds = word_spans(data, offsets)
    hashes, out = shingle_hashes(span_hashes(data, starts, ends), bounds)
    return [np.unique(hashes[a:b]) for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True)]
