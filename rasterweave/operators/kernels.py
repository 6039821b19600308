"""numpy kernels of the tile engine: a band with its halo in, the band's filtered rows out."""

from __future__ import annotations

import numpy as np

from rasterweave.functions.catalog import Filter

#: Output rows computed at once, so that the partial sums stay in a core's cache.
BLOCK_ROWS = 16


def pad_columns(band: np.ndarray, pad: int, wrap: bool) -> np.ndarray:
    return np.pad(band, ((0, 0), (pad, pad), (0, 0)), mode="wrap" if wrap else "edge")


def correlate(padded: np.ndarray, kernel: Filter, rows: int, width: int) -> np.ndarray:
    """Weighted sums as float32 (exact: they are integers below 2**24 in size).

    Taps of a kernel row that mirror each other are folded: pixels are added before the multiplication.
    Equal rows of the kernel that mirror each other are folded the same way.
    """
    taps, size = kernel.taps, kernel.size
    out = np.empty((rows, width, padded.shape[2]), dtype=np.float32)
    for start in range(0, rows, BLOCK_ROWS):
        n = min(BLOCK_ROWS, rows - start)
        block = padded[start : start + n + size - 1].astype(np.float32)
        acc = np.zeros((n, width, padded.shape[2]), dtype=np.float32)
        done = np.zeros(size, dtype=bool)
        for i in range(size):
            if done[i] or not taps[i].any():
                continue
            line = block[i : i + n]
            j = size - 1 - i
            if j > i and np.array_equal(taps[i], taps[j]):
                line = line + block[j : j + n]
                done[j] = True
            _add_row(acc, line, taps[i], width)
        out[start : start + n] = acc
    return out


def _add_row(acc: np.ndarray, line: np.ndarray, weights: np.ndarray, width: int) -> None:
    size = len(weights)
    term = np.empty_like(acc)
    if size > 3 and len(set(weights.tolist())) == 1:
        running = np.cumsum(line, axis=1, dtype=np.float64)
        total = running[:, size - 1 : size - 1 + width].copy()
        total[:, 1:] -= running[:, : width - 1]
        acc += total * weights[0]
        return
    for k in range((size + 1) // 2):
        m = size - 1 - k
        if m != k and weights[k] == weights[m]:
            if weights[k]:
                np.add(line[:, k : k + width], line[:, m : m + width], out=term)
                if weights[k] != 1:
                    np.multiply(term, np.float32(weights[k]), out=term)
                acc += term
            continue
        for q in {k, m}:
            if weights[q]:
                np.multiply(line[:, q : q + width], np.float32(weights[q]), out=term)
                acc += term


def saturate(acc: np.ndarray, kernel: Filter, rounding: str = "half_away") -> np.ndarray:
    """round half away from zero (or not at all), clamp, cast; the scaling is in double as the definition says."""
    scaled = acc.astype(np.float64) * kernel.factor + kernel.bias
    if rounding == "truncate":
        return np.clip(scaled, 0, 255).astype(np.uint8)
    return np.clip(np.copysign(np.floor(np.abs(scaled) + 0.5), scaled), 0, 255).astype(np.uint8)


def median(padded: np.ndarray, size: int, rows: int, width: int) -> np.ndarray:
    """The middle value of every size x size window, channel by channel, by partial selection."""
    out = np.empty((rows, width, padded.shape[2]), dtype=np.uint8)
    middle = size * size // 2
    for y in range(rows):
        strip = padded[y : y + size]
        windows = np.lib.stride_tricks.sliding_window_view(strip, size, axis=1)[:, :width]
        flat = np.moveaxis(windows, 0, 2).reshape(width, strip.shape[2], size * size)
        out[y] = np.partition(flat, middle, axis=2)[:, :, middle]
    return out


def filter_band(band: np.ndarray, kernel: Filter, rows: int, rounding: str = "half_away") -> np.ndarray:
    """``band`` holds ``rows`` rows and ``kernel.halo`` rows above and below; columns are padded here."""
    width = band.shape[1]
    wrap = kernel.taps is None
    padded = pad_columns(band, kernel.halo, wrap)
    if wrap:
        return median(padded, kernel.size, rows, width)
    return saturate(correlate(padded, kernel, rows, width), kernel, rounding)
