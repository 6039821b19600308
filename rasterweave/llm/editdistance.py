"""Edit distance within a bound for many pairs at once: banded, bit-parallel, one 64-bit word a pair.

The recurrences are those of Hyyro's bit-parallel algorithm on a band that moves down one row a column:
the top bit of a word is row ``column + bound``. Match bits are given inside the band only; a path with at
most ``bound`` edits never leaves it. Pairs go through the columns together with others of about their length,
and leave once their distance can't come back under the bound; the few that are longer than LONG bytes
follow the band's diagonals instead, from one difference to the next.
"""

from __future__ import annotations

import numpy as np

#: Pairs that go through the columns together, at most so many cells of them; pairs with longer texts go alone.
LANES, CELLS, LONG = 4096, 1 << 21, 2048
#: Columns after which pairs that are too far are dropped; bytes that a diagonal compares at once.
CHECK, STRIDE = 32, 1 << 16
_ONE = np.uint64(1)


def within(left: list[bytes], right: list[bytes], bound: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``bound``."""
    m = np.array([len(x) for x in left], dtype=np.int64)
    n = np.array([len(x) for x in right], dtype=np.int64)
    out = np.zeros(len(left), dtype=bool)
    near = np.abs(m - n) <= bound
    tiny, long_ = np.minimum(m, n) <= bound, np.maximum(m, n) > LONG
    for i in np.flatnonzero(near & tiny).tolist():
        out[i] = _plain(left[i], right[i]) <= bound
    for i in np.flatnonzero(near & long_ & ~tiny).tolist():
        out[i] = _diagonals(left[i], right[i], bound)
    rest = np.flatnonzero(near & ~tiny & ~long_)
    rest = rest[np.argsort(n[rest], kind="stable")]
    at = 0
    while at < len(rest):
        shortest = int(n[rest[at]])
        stop = min(int(np.searchsorted(n[rest], shortest + shortest // 4 + 8, "right")), at + max(1, min(LANES, CELLS // (shortest + 1))))
        lanes = rest[at:stop]
        out[lanes] = _lanes([left[i] for i in lanes], [right[i] for i in lanes], m[lanes], n[lanes], bound) <= bound
        at = stop
    return out


def _alike(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many bytes are the same from place i of a and j of b on."""
    n, at = min(len(a) - i, len(b) - j), 0
    while at < n:
        size = min(STRIDE, n - at)
        differ = a[i + at : i + at + size] != b[j + at : j + at + size]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at += size
    return max(n, 0)


def _diagonals(left: bytes, right: bytes, bound: int) -> bool:
    """For each number of edits and diagonal the furthest place that can be reached."""
    a, b = np.frombuffer(left, dtype=np.uint8), np.frombuffer(right, dtype=np.uint8)
    far: dict[int, int] = {}
    for edits in range(bound + 1):
        now = {}
        for d in range(-edits, edits + 1):  # place in b less place in a
            starts = [far[d] + 1] if d in far else []  # a byte replaced
            starts += [far[d - 1]] if d - 1 in far else []  # a byte of b more
            starts += [far[d + 1] + 1] if d + 1 in far else []  # a byte of a more
            i = min(max(starts, default=0), len(a))
            if 0 <= i + d <= len(b):
                now[d] = i + _alike(a, b, i, i + d)
        if now.get(len(b) - len(a), -1) == len(a):
            return True
        far = now
    return False


def _plain(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _matrix(texts: list[bytes], width: int, pad: int) -> np.ndarray:
    """Texts as rows of ints with ``pad`` cells of -1 before and enough after."""
    out = np.full((len(texts), width + 2 * pad), -1, dtype=np.int16)
    for i, t in enumerate(texts):
        out[i, pad : pad + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return out


def _lanes(left: list[bytes], right: list[bytes], m: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    columns = int(n.max())
    a = np.ascontiguousarray(_matrix(left, max(columns + k, int(m.max())), k).T)
    b = np.ascontiguousarray(_matrix(right, columns, 0).T)
    vp = np.full(len(left), (0xFFFFFFFFFFFFFFFF << (63 - k)) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    vn = np.zeros(len(left), dtype=np.uint64)
    distance = np.full(len(left), k, dtype=np.int64)
    final, own = distance.copy(), np.arange(len(left))
    with np.errstate(over="ignore"):
        for j in range(1, columns + 1):
            if j % CHECK == 0:  # along the slope a distance never falls, on the level at the end by one in each of 2 k columns at most
                stay = (j <= n) & (distance <= 3 * k)
                if not stay.all():
                    final[own[~stay]] = distance[~stay]
                    own, a, b, m, n, vp, vn, distance = own[stay], a[:, stay], b[:, stay], m[stay], n[stay], vp[stay], vn[stay], distance[stay]
                    if not len(own):
                        break
            text = b[j - 1]
            x = np.zeros(len(own), dtype=np.uint64)
            for d in range(-k, k + 1):  # row j + d of the pattern is cell j + d - 1, padded by k
                x |= (a[j + d - 1 + k] == text).astype(np.uint64) << np.uint64(63 - k + d)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            live = j <= n
            sloped = live & (j <= m - k)
            distance += sloped & ((d0 >> np.uint64(63)) == 0)
            level = live & ~sloped
            if level.any():
                bit = np.clip(63 - (j + k - m), 0, 63).astype(np.uint64)
                distance += level * (((hp >> bit) & _ONE).astype(np.int64) - ((hn >> bit) & _ONE).astype(np.int64))
            shifted = d0 >> _ONE
            vp = hn | ~(shifted | hp)
            vn = shifted & hp
    final[own] = distance
    return final
