"""Suffix order of a text on disk with its common prefixes, by external induced sorting.

A level takes a text of characters from 1 up (bytes at first, names below) that stands in a file. Leftmost
S-type suffixes are seeds. One round of induction (L-type suffixes rising, S-type ones falling) sorts and
names the stretches between seeds; if names repeat, the text of names is sorted by the same procedure, one
level down. From the seeds in their final order a second round gives the order of all suffixes; at the top
it carries along the prefix that each suffix shares with its neighbour, cut at DEPTH: an induced pair shares
one character more than the least value between its sources. Only neighbouring seeds, and the two suffixes
at the seam of types in a bucket, are compared on the bytes.

What waits stands in disk-backed priority queues. An entry is a tuple (position, preceding characters, tag,
character); tuples leave by bucket, and within a bucket by (character, arrival). A bucket is one character,
or a range of rare names small enough to be put in order in memory. A queue holds ``memory`` bytes, the rest
is in its file; text, names, seeds and results are files too, read in blocks. So a text may be far larger
than memory; what grows with it in memory is one number a bucket of names (of ROWS suffixes or more).
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Callable

import numpy as np

DEPTH = 50
#: Bytes of waiting tuples that the queues of a level hold together.
MEMORY = 2 << 20
#: Tuples, or characters, that are taken at once; rare names are put together to buckets of this many suffixes.
ROWS = 1 << 16
#: A name that stands more often has a bucket of its own.
FREQUENT = 4096
#: Texts of names up to this length are sorted in memory.
SMALL = 1 << 17
#: So few tuples that a bucket sends to itself are followed one by one.
FEW = 32
POSITION, BEFORE, TAG, CHAR = 0, 1, 2, 3
#: From these numbers on, the highest byte that isn't zero is the last, the last but one and so on.
_HIGHEST = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
ORDER, GROUP, PREFIX = "order", "group", "prefix"


def by_bucket(buckets: np.ndarray, count: int) -> np.ndarray:
    """Stable order of bucket numbers below ``count``; few buckets are sorted by digits."""
    return np.argsort(buckets.astype(np.uint8) if count <= 1 << 8 else buckets.astype(np.uint16) if count <= 1 << 16 else buckets, kind="stable")


def _heads(values: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin."""
    new = np.empty(len(values), dtype=bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _joined(parts: list[np.ndarray]) -> np.ndarray | None:
    return (np.concatenate(parts) if len(parts) > 1 else parts[0]) if parts else None


class Queue:
    """Tuples by bucket, first in first out (or last in first out), in memory up to a budget and in a file beyond it."""

    def __init__(self, buckets: int, width: int, memory: int, folder: str):
        self.parts: list[deque] = [deque() for _ in range(buckets)]
        self.held = np.zeros(buckets, dtype=np.int64)
        self.stored: list[deque] = [deque() for _ in range(buckets)]
        self.limit, self.width, self.total, self.spilled = max(1, memory // (8 * width)), width, 0, 0
        self.file = tempfile.TemporaryFile(dir=folder)

    def push(self, buckets: np.ndarray, rows: np.ndarray) -> None:
        """Adds tuples in their order; ``buckets`` need not be in order."""
        if len(rows):
            order = by_bucket(buckets, len(self.parts))
            self.push_sorted(buckets[order], np.take(rows, order, axis=0))

    def push_sorted(self, buckets: np.ndarray, rows: np.ndarray) -> None:
        """Adds tuples whose buckets rise."""
        edges = _heads(buckets)
        for b, x, y in zip(buckets[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
            self.parts[b].append(rows[x:y].copy())
            self.held[b] += y - x
        self.total += len(rows)
        if self.total > self.limit:
            for b in np.argsort(-self.held, kind="stable").tolist():
                if self.total <= self.limit // 2:
                    break
                self._spill(b)

    def _spill(self, b: int) -> None:
        at = self.file.seek(0, 2)
        for part in self.parts[b]:
            self.file.write(part.tobytes())
        n = int(self.held[b])
        self.stored[b].append((at, n))
        self.parts[b].clear()
        self.held[b] = 0
        self.total -= n
        self.spilled += n

    def _read(self, at: int, n: int) -> np.ndarray:
        rows = np.empty((n, self.width), dtype=np.int64)
        self.file.seek(at)
        if self.file.readinto(rows.data) != rows.nbytes:
            raise OSError("a queue's file is short")
        return rows

    def pop(self, b: int) -> np.ndarray | None:
        """The next ROWS tuples of a bucket, or all if it has fewer; None if it is empty."""
        stored, parts, taken, free = self.stored[b], self.parts[b], [], ROWS
        while free and stored:
            at, n = stored.popleft()
            k = min(n, free)
            if n > k:
                stored.appendleft((at + 8 * self.width * k, n - k))
            taken.append(self._read(at, k))
            free -= k
        while free and parts:
            part = parts.popleft()
            if len(part) > free:
                parts.appendleft(part[free:])
                part = part[:free]
            taken.append(self._released(b, part))
            free -= len(part)
        return _joined(taken)

    def pop_last(self, b: int) -> np.ndarray | None:
        """The last ROWS tuples of a bucket, or all if it has fewer, the last one first; None if it is empty."""
        stored, parts, taken, free = self.stored[b], self.parts[b], [], ROWS
        while free and parts:
            part = parts.pop()
            if len(part) > free:
                parts.append(part[:-free])
                part = part[-free:]
            taken.append(self._released(b, part)[::-1])
            free -= len(part)
        while free and stored:
            at, n = stored.pop()
            k = min(n, free)
            if n > k:
                stored.append((at, n - k))
            taken.append(self._read(at + 8 * self.width * (n - k), k)[::-1])
            free -= k
        return _joined(taken)

    def _released(self, b: int, part: np.ndarray) -> np.ndarray:
        self.held[b] -= len(part)
        self.total -= len(part)
        return part

    def all(self, b: int, last: bool) -> np.ndarray:
        taken = []
        while (rows := self.pop_last(b) if last else self.pop(b)) is not None:
            taken.append(rows)
        return np.concatenate(taken) if taken else np.zeros((0, self.width), dtype=np.int64)

    def close(self) -> None:
        self.file.close()


class Scratch:
    """Arrays in files of one folder, and how much the queues have spilled."""

    def __init__(self, memory: int = MEMORY, folder: str | None = None):
        self.holder = tempfile.TemporaryDirectory(prefix="suffixes-", dir=folder)
        self.folder, self.memory, self.made, self.spilled, self.levels = self.holder.name, memory, 0, 0, 0

    def array(self, n: int, kind: str) -> np.ndarray:
        self.made += 1
        return np.memmap(os.path.join(self.folder, f"{self.made}"), dtype=kind, mode="w+", shape=(n,)).view(np.ndarray) if n else np.zeros(0, dtype=kind)

    def places(self, n: int, upto: int) -> np.ndarray:
        return self.array(n, "int32" if upto < 2**31 else "int64")

    def close(self) -> None:
        self.holder.cleanup()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The least of ``values[after + 1 .. upto]`` for each pair, by powers of two."""
    size = upto - after
    level = np.frexp(size)[1] - 1
    out = np.empty(len(after), dtype=values.dtype)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[after[own] + 1], table[upto[own] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


class _Level:
    """One text and the two rounds of induction over it. ``starts``: the first character of each bucket."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, stop: int, scratch: Scratch):
        self.text, self.n, self.starts, self.scratch = text, len(text), starts, scratch
        self.ends = np.append(starts[1:], stop)
        self.plain = bool((self.ends - self.starts == 1).all())
        self.bits = np.uint64(8 * text.dtype.itemsize)
        self.count = 64 // int(self.bits)
        self.mask = np.uint64((1 << int(self.bits)) - 1)
        self.width = 3 if self.plain else 4
        # Eight bytes as one number, the last of them lowest.
        self.words = np.ndarray((self.n - 7,), dtype=">u8", buffer=text, strides=(1,)) if text.dtype == np.uint8 and self.n >= 8 and text.flags.c_contiguous else None

    def bucket(self, chars: np.ndarray) -> np.ndarray:
        if self.plain:  # every character has its own bucket
            return chars - self.starts[0]
        return np.searchsorted(self.starts, chars, "right") - 1

    def rows(self, positions: np.ndarray, chars: np.ndarray, tags: np.ndarray | int = 0) -> np.ndarray:
        made = np.zeros((len(positions), self.width), dtype=np.int64)
        made[:, POSITION], made[:, TAG] = positions, tags
        if not self.plain:
            made[:, CHAR] = chars
        return made

    def before(self, rows: np.ndarray) -> np.ndarray:
        """The character before each suffix (0: none); tuples that carry no more characters read some, in text order if the text exceeds the queues' memory."""
        carried = rows[:, BEFORE].view(np.uint64)
        bare = np.flatnonzero((carried == 0) & (rows[:, POSITION] > 0))
        if len(bare):
            if self.text.nbytes > self.scratch.memory:
                bare = bare[np.argsort(rows[bare, POSITION])]
            at = rows[bare, POSITION] - 1
            found = np.zeros(len(bare), dtype=np.uint64)
            far = at >= 7 if self.words is not None else np.zeros(len(at), dtype=bool)
            if far.any():
                found[far] = self.words[at[far] - 7]
            near = np.flatnonzero(~far)
            for k in range(self.count if len(near) else 0):
                char = self.text[np.maximum(at[near] - k, 0)].astype(np.uint64)
                char[at[near] < k] = 0
                found[near] |= char << (self.bits * np.uint64(k))
            carried[bare] = found
        return (carried & self.mask).astype(np.int64)

    def seeds(self) -> np.ndarray:
        """Positions of the leftmost S-type suffixes, in a file."""
        total, resolved = 0, -1
        file = tempfile.TemporaryFile(dir=self.scratch.folder)
        for a in range(0, self.n, ROWS):
            b = min(self.n, a + ROWS)
            own = np.asarray(self.text[a:b])
            if resolved < b:  # the first character after the block that is not its last one
                resolved = b
                while resolved < self.n and (far := np.flatnonzero(np.asarray(self.text[resolved : resolved + ROWS]) != own[-1])).size == 0:
                    resolved = min(self.n, resolved + ROWS)
                if resolved < self.n:
                    resolved += int(far[0])
            following = self.text[resolved] if resolved < self.n else 0
            ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            rising = np.append(own[ends[:-1]] < own[ends[:-1] + 1], own[-1] < following)
            is_s = np.repeat(rising, np.diff(np.concatenate([[-1], ends])))
            left = np.append(np.asarray(self.text[a - 1 : a]) if a else np.zeros(1, own.dtype), own[:-1])
            places = np.flatnonzero(is_s & (left > own)) + a
            file.write(places.astype(np.int64).tobytes())
            total += len(places)
        out = self.scratch.places(total, self.n)
        file.seek(0)
        for a in range(0, total, ROWS):
            out[a : a + ROWS] = np.frombuffer(file.read(8 * ROWS), dtype=np.int64)
        file.close()
        return out

    def compare(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Characters that suffixes share, at most DEPTH; bytes by eights where the text goes on for long enough."""
        shared = np.zeros(len(left), dtype=np.int64)
        live = np.arange(len(left))
        if self.words is not None:
            far = np.maximum(left, right) + DEPTH + 8 <= self.n
            live, near = np.flatnonzero(far), np.flatnonzero(~far)
            for k in range(0, DEPTH, 8):
                apart = self.words[left[live] + k] ^ self.words[right[live] + k]
                equal = 8 - np.searchsorted(_HIGHEST, apart, "right")
                shared[live] += equal
                live = live[equal == 8]
                if not len(live):
                    break
            np.minimum(shared, DEPTH, out=shared)
            live = near
        for k in range(DEPTH):
            a, b = left[live] + k, right[live] + k
            inside = (a < self.n) & (b < self.n)
            live, a, b = live[inside], a[inside], b[inside]
            live = live[self.text[a] == self.text[b]]
            if not len(live):
                break
            shared[live] += 1
        return shared

    def induce(self, fill: Callable[[Queue], None], mode: str, consume: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
        """Both phases from seeds; ``consume`` gets positions, values (group or prefix) and whether each is a seed, from the largest suffix down."""
        share = self.scratch.memory // 2
        make = lambda: Queue(len(self.starts), self.width, share, self.scratch.folder)
        self.groups, self.mode = 0, mode
        seeds, rising, done = make(), make(), make()
        fill(seeds)
        if self.n:
            end = np.array([self.n - 1])
            char = self.text[end].astype(np.int64)
            rising.push(self.bucket(char), self.rows(end, char, -1))
        self._phase(1, rising, seeds, lambda b, rows, values: done.push(np.full(len(rows), b), self._tagged(rows, values)), None)
        self.scratch.spilled += seeds.spilled + rising.spilled
        seeds.close()
        rising.close()
        falling = make()
        self._phase(-1, falling, done, None, consume)
        self.scratch.spilled += falling.spilled + done.spilled
        falling.close()
        done.close()

    def _tagged(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        rows = rows.copy()
        rows[:, TAG] = values
        return rows

    def _phase(self, sign: int, queue: Queue, others: Queue, keep: Callable | None, consume: Callable | None) -> None:
        """Pops all buckets in the order of ``sign``; the others (seeds, or L-type suffixes) follow a bucket's own tuples."""
        self.low = np.zeros(len(self.starts), dtype=np.uint8)
        buckets = range(len(self.starts)) if sign > 0 else range(len(self.starts) - 1, -1, -1)
        for b in buckets:
            if self.ends[b] - self.starts[b] > 1:
                self._range(b, sign, queue, others, keep, consume)
                continue
            char, last, source = int(self.starts[b]), -1, None
            while (rows := queue.pop(b)) is not None:
                before = self.before(rows)
                if self.mode == GROUP:
                    new = np.concatenate([[source is None or rows[0, TAG] != source], rows[1:, TAG] != rows[:-1, TAG]])
                    values = self.groups - 1 + np.cumsum(new)
                    source, self.groups = rows[-1, TAG], int(values[-1]) + 1
                else:
                    values = rows[:, TAG].copy()
                    if last < 0:
                        values[0] = 0
                last = int(rows[-1, POSITION])
                if keep:
                    keep(b, rows, values)
                if consume:
                    consume(rows[:, POSITION], values, before > char)
                self._send(queue, rows, values, before, before >= char if sign > 0 else (before <= char) & (before > 0))
            carried, first = 0, True
            while (rows := others.pop_last(b) if sign < 0 else others.pop(b)) is not None:
                before = self.before(rows)
                values = rows[:, TAG].copy()
                if self.mode == GROUP and sign > 0:
                    values[:] = self.groups
                elif self.mode == PREFIX:
                    if sign < 0:  # each shares with the larger one before it what that one has as its tag
                        values[1:], values[0] = rows[:-1, TAG], carried
                        carried = int(rows[-1, TAG])
                    if first:
                        values[0] = int(self.compare(np.array([last]), rows[:1, POSITION])[0]) if last >= 0 else 0
                first = False
                if consume:
                    consume(rows[:, POSITION], values, np.zeros(len(rows), dtype=bool))
                self._send(queue, rows, values, before, before > char if sign > 0 else (before < char) & (before > 0))
            if self.mode == GROUP and sign > 0 and not first:
                self.groups += 1

    def _send(self, queue: Queue, rows: np.ndarray, values: np.ndarray, before: np.ndarray, wanted: np.ndarray) -> None:
        """Queues the wanted predecessors of popped suffixes."""
        at = np.flatnonzero(wanted)
        buckets = self.bucket(before[at])
        order = by_bucket(buckets, len(self.starts))
        at, buckets = at[order], buckets[order]
        tags = self._prefixes(values.astype(np.uint8), at, buckets) if self.mode == PREFIX else values[at]
        if not len(at):
            return
        made = np.empty((len(at), self.width), dtype=np.int64)
        made[:, POSITION] = rows[at, POSITION] - 1
        made[:, BEFORE] = (rows[at, BEFORE].view(np.uint64) >> self.bits if self.count > 1 else np.zeros(len(at), np.uint64)).view(np.int64)
        made[:, TAG] = tags
        if not self.plain:
            made[:, CHAR] = before[at]
        queue.push_sorted(buckets, made)

    def _prefixes(self, prefix: np.ndarray, place: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What each sent one (places by bucket) shares with the one sent there before it.

        ``low`` is, for each bucket, the least prefix popped since something was sent there.
        """
        whole = prefix.min()
        if not len(place):
            self.low = np.minimum(self.low, whole)
            return np.zeros(0, dtype=np.int64)
        first = np.zeros(len(own), dtype=bool)
        first[_heads(own)] = True
        upto = np.minimum.accumulate(prefix)
        value = np.empty(len(own), dtype=np.uint8)
        value[first] = np.minimum(self.low[own[first]], upto[place[first]])
        rest = np.flatnonzero(~first)
        value[rest] = least_between(prefix, place[rest - 1], place[rest])
        final = np.append(first[1:], True)
        onward = np.append(np.minimum.accumulate(prefix[::-1])[::-1][1:], np.uint8(DEPTH))
        self.low = np.minimum(self.low, whole)
        self.low[own[final]] = onward[place[final]]
        return np.minimum(DEPTH, value.astype(np.int64) + 1)

    def _chains(self, rows: np.ndarray, before: np.ndarray, parents: np.ndarray, number: int, lo: int, hi: int, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """All that tuples of a bucket send to it, one chain after the other: tuples (numbered from ``number`` on), the
        characters before them, the numbers of their sources, and the length of the longest chain."""
        positions, chars, befores, above, tags, rounds = [], [], [], [], [], 0
        for position, tag, t, parent in zip(rows[:, POSITION].tolist(), rows[:, TAG].tolist(), before.tolist(), parents.tolist(), strict=True):
            start, inside = len(positions), True
            while inside:
                position -= 1
                char, t = t, int(self.text[position - 1]) if position else 0
                above.append(parent)
                parent = number + len(positions)
                positions.append(position)
                chars.append(char)
                befores.append(t)
                inside = lo <= t < hi and sign * t >= sign * char
            tags += [tag] * (len(positions) - start)
            rounds = max(rounds, len(positions) - start)
        return self.rows(np.array(positions), np.array(chars), np.array(tags)), np.array(befores), np.array(above), rounds

    def _range(self, b: int, sign: int, queue: Queue, others: Queue, keep: Callable | None, consume: Callable | None) -> None:
        """A bucket of several names: what it sends to itself is added first, then all of it is put in order.

        A tuple stands by (character, type, place of its source). Sources from earlier buckets come first, in
        the order of arrival; behind a source inside stands its own source, so chains are compared by doubling.
        """
        lo, hi = int(self.starts[b]), int(self.ends[b])
        roots, rest = queue.all(b, False), others.all(b, sign < 0)
        first = np.concatenate([roots, rest])
        if not len(first):
            return
        parts, befores, parents, at, fresh, deep = [first], [self.before(first)], [np.full(len(first), -1)], 0, len(roots), 0
        while True:  # ``fresh``: how many of the last part are tuples of the bucket itself
            part, t = parts[-1], befores[-1]
            c = part[:, CHAR]
            inside = np.flatnonzero((t >= lo) & (t < hi) & ((sign * t > sign * c) | ((t == c) & (np.arange(len(part)) < fresh))))
            if not len(inside):
                break
            if len(inside) <= FEW:  # mostly repeats, which go on for many rounds
                made, t, above, rounds = self._chains(part[inside], t[inside], at + inside, at + len(part), lo, hi, sign)
                parts.append(made)
                befores.append(t)
                parents.append(above)
                deep += rounds
                break
            made = part[inside]
            made[:, POSITION] -= 1
            made[:, BEFORE] = (made[:, BEFORE].view(np.uint64) >> self.bits).view(np.int64)
            made[:, CHAR] = t[inside]
            parts.append(made)
            befores.append(self.before(made))
            parents.append(at + inside)
            at, fresh, deep = at + len(part), len(made), deep + 1
        rows, before, parent = np.concatenate(parts), np.concatenate(befores), np.concatenate(parents)
        is_other = np.zeros(len(rows), dtype=bool)
        is_other[len(roots) : len(first)] = True
        second = np.full(len(rows), 1 << 36)
        for part, where in ((roots, slice(0, len(roots))), (rest, slice(len(roots), len(first)))):
            if self.mode == GROUP:  # equal sources stand together and are no order
                second[where] = np.cumsum(np.diff(part[:, TAG], prepend=0) != 0)
            else:
                second[where] = np.arange(len(part))
        high = 2 * (rows[:, CHAR] - lo if sign > 0 else hi - 1 - rows[:, CHAR]) + is_other << 40
        rank, order = _ranked(high + second, parent, deep)
        values = rows[:, TAG]
        if self.mode == GROUP:
            values = np.where(is_other & (sign < 0), values, self.groups + rank)
            self.groups += len(rows)
        rows, before, values, own = rows[order], before[order], values[order], ~is_other[order]
        if keep:
            keep(b, rows[own], values[own])
        if consume:
            consume(rows[:, POSITION], values, own & (before > rows[:, CHAR]))
        self._send(queue, rows, values, before, (before > 0) & ((before < lo) | (before >= hi)) & (sign * before > sign * rows[:, CHAR]))


def _ranked(keys: np.ndarray, parent: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by key, then by the parent's key and so on (-1: none, which comes first), at most ``deep`` parents up, and the order.

    A rank is the place of the first that is equal. Ranks are doubled; those that stand alone are final, only ties are sorted again.
    """
    n = len(keys)
    rank, order, tied, reach = np.zeros(n, dtype=np.int64), np.arange(n), np.arange(n), 0
    while True:
        items = order[tied]
        if reach:
            above = parent[items]
            keys = rank[items] * (n + 1) + np.where(above >= 0, rank[above] + 1, 0)
        by = np.argsort(keys)
        items, keys = items[by], keys[by]
        order[tied] = items
        heads = _heads(keys)
        sizes = np.diff(np.append(heads, len(items)))
        rank[items] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        if reach:
            parent = np.where(parent >= 0, parent[parent], -1)
        reach = max(1, 2 * reach)
        if reach > deep or not len(tied):
            break
    items = order[tied]  # equal ones stay in their order
    order[tied] = items[np.argsort(rank[items] * n + items)]
    return rank, order


def _in_memory(text: np.ndarray) -> np.ndarray:
    """Suffix order of a short text by doubled ranks."""
    following = np.arange(1, len(text) + 1)
    following[-1:] = -1
    return _ranked(np.asarray(text).astype(np.int64), following, len(text))[1]


class _Names:
    """Takes named seeds from the largest down: writes them, counts names, and cuts the names into buckets."""

    def __init__(self, folder: str):
        self.file, self.rows = tempfile.TemporaryFile(dir=folder), 0
        self.names, self.group = 0, None
        self.cuts: list[int] = []  # how many of the largest names stand before a cut
        self.open = self.total = 0
        self.frequent = False

    def __call__(self, positions: np.ndarray, values: np.ndarray, is_seed: np.ndarray) -> None:
        at, group = positions[is_seed], values[is_seed]
        if not len(at):
            return
        new = np.concatenate([[group[0] != self.group], group[1:] != group[:-1]])
        number = self.names + np.cumsum(new)  # from 1
        self.file.write(np.stack([at, number], axis=1).astype(np.int64).tobytes())
        self._count(int(number[0]), np.bincount(number - number[0]))
        self.rows, self.names, self.group = self.rows + len(at), int(number[-1]), group[-1]

    def _count(self, first: int, sizes: np.ndarray) -> None:
        """Cuts before and after frequent names, and where ROWS suffixes are reached; the last name may go on."""
        if first == self.names:
            sizes[0] += self.open
        elif self.names:
            first, sizes = self.names, np.append(self.open, sizes)
        self.open, sizes = int(sizes[-1]), sizes[:-1]
        frequent = np.concatenate([[self.frequent], sizes > FREQUENT])
        total = self.total + np.concatenate([[0], np.cumsum(sizes)])
        cut = frequent[1:] | frequent[:-1] | (total[1:] // ROWS != total[:-1] // ROWS)
        self.cuts += (np.flatnonzero(cut) + first - 1).tolist()
        self.total, self.frequent = int(total[-1]), bool(frequent[-1])

    def starts(self) -> np.ndarray:
        """First name of each bucket, names now counted from the least, from 1 on."""
        if self.frequent or self.open > FREQUENT:
            self.cuts.append(self.names - 1)
        cuts = np.unique(np.array([c for c in self.cuts if 0 < c < self.names], dtype=np.int64))
        return np.unique(np.append(1, self.names - cuts + 1))

    def text(self, seeds: np.ndarray, scratch: Scratch) -> np.ndarray:
        """The names in the order of the seeds' positions."""
        out = scratch.array(self.rows, "uint32")
        self.file.seek(0)
        while len(raw := np.frombuffer(self.file.read(16 * ROWS), dtype=np.int64).reshape(-1, 2)):
            raw = raw[np.argsort(raw[:, 0], kind="stable")]
            out[np.searchsorted(seeds, raw[:, 0])] = self.names - raw[:, 1] + 1
        return out

    def order(self, scratch: Scratch, upto: int) -> np.ndarray:
        """Seeds in rising order, if their names differ."""
        out = scratch.places(self.rows, upto)
        self.file.seek(0)
        at = self.rows
        while len(raw := np.frombuffer(self.file.read(16 * ROWS), dtype=np.int64).reshape(-1, 2)):
            out[at - len(raw) : at] = raw[::-1, 0]
            at -= len(raw)
        return out


def _sorted(level: _Level, scratch: Scratch, top: bool, consume: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    scratch.levels += 1
    seeds = level.seeds()

    def unsorted(queue: Queue) -> None:
        for a in range(0, len(seeds), ROWS):
            at = seeds[a : a + ROWS].astype(np.int64)
            char = level.text[at].astype(np.int64)
            queue.push(level.bucket(char), level.rows(at, char))

    names = _Names(scratch.folder)
    if len(seeds):
        level.induce(unsorted, GROUP, names)
    if names.names == names.rows:
        order = names.order(scratch, level.n)
    else:
        below = names.text(seeds, scratch)
        names.file.close()
        if len(below) <= SMALL:
            order = seeds[_in_memory(below)]
        else:
            order, at = scratch.places(len(seeds), level.n), [len(seeds)]

            def place(positions: np.ndarray, values: np.ndarray, is_seed: np.ndarray) -> None:
                order[at[0] - len(positions) : at[0]] = seeds[positions][::-1]
                at[0] -= len(positions)

            _sorted(_Level(below, names.starts(), names.names + 1, scratch), scratch, False, place)
    names.file.close()

    def in_order(queue: Queue) -> None:
        before = np.zeros(0, dtype=np.int64)
        for a in range(0, len(order), ROWS):
            at = order[a : a + ROWS].astype(np.int64)
            char = level.text[at].astype(np.int64)
            shared = 0
            if top:
                left = np.concatenate([before, at])[: len(at)] if len(before) else np.append(at[:1], at[:-1])
                shared = level.compare(left, at)
            queue.push(level.bucket(char), level.rows(at, char, shared))
            before = at[-1:]

    level.induce(in_order, PREFIX if top else ORDER, consume)


def sort_suffixes(text: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """All positions of ``text`` (uint8 from 1 up) in the order of their suffixes, and what each shares with the one before it, at most DEPTH bytes."""
    n = len(text)
    order, shared, at = scratch.places(n, n), scratch.array(n, "uint8"), [n]
    if not n:
        return order, shared

    def place(positions: np.ndarray, values: np.ndarray, is_seed: np.ndarray) -> None:
        # Going down, a value is shared with the larger neighbour, which stands after it.
        stop, k = at[0], len(positions)
        order[stop - k : stop] = positions[::-1]
        if stop < n:
            shared[stop] = values[0]
        shared[stop - k + 1 : stop] = values[1:][::-1]
        at[0] -= k

    _sorted(_Level(text, np.arange(1, 256), 256, scratch), scratch, True, place)
    return order, shared
