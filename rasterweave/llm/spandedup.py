"""Removal of byte spans that repeat from documents with a smaller doc_id, by suffix order.

A byte goes if a string of 50 bytes covers it that also starts in a document with a smaller doc_id.

1. Every window of 50 bytes is named by the least hash of its 24-byte strings, so equal windows bear equal
   names wherever they stand, and neighbouring windows mostly share one: a run. Names are counted over all
   documents (48-bit hashes, packed by slot; names that repeat within a batch are settled
   there, so a name that stands everywhere sends one entry a batch).
2. Runs whose name stands in two documents or more are cut out with their bytes and sent to the shard of
   their name; all other bytes can't repeat and are sent nowhere.
3. A run that is the only one of its name is decided by its documents. All other distinct runs of a shard are
   one text on disk; its suffixes are ordered by external induced sorting
   (:mod:`rasterweave.llm.suffixes`). Neighbours that share 50 bytes form a class; its smallest doc_id decides
   for every member whether the window goes: a run becomes stretches of windows with one deciding doc_id.
4. Places of runs go with them, but those of frequent runs (boilerplate) are dealt over many tasks, and the
   shard's decisions on these runs are sent there.
5. Spans of a document are merged.

Nothing is capped. Inputs: a null text is empty; texts under 50 bytes stay; rows that repeat a doc_id never
remove each other's bytes; a null doc_id takes no part and stays whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import bounded_batches, by_key, map_pieces, mix, pieces, saved, shared_folder, small, utf8, whole
from rasterweave.llm.suffixes import DEPTH, Scratch, sort_suffixes

NAME_BYTES = 24
REACH = DEPTH - NAME_BYTES + 1
#: Text for each slot of names and each shard of runs.
SLOT_BYTES, SHARD_BYTES = 32 << 20, 3 << 20
#: Bytes of runs that a task collects before it hands them on; a run with more places there is frequent.
HELD_BYTES, FREQUENT = 16 << 20, 64
#: Text for which the places of frequent runs are dealt one way more; ways at most.
FAN_BYTES, MOST_FAN = 1 << 30, 256
SORTED_ROWS, DECIDED_RUNS = 1 << 18, 1 << 14
#: Windows that are hashed at once.
BLOCK = 1 << 14
#: Bytes of the file in which runs that are read at once begin; what stands at a suffix that is no window.
READ_BYTES, NO_WINDOW = 1 << 16, np.int32(2**31 - 1)
_PACK = 6
QUERY, KNOWN, SETTLED = 0, 1, 2
RUNS, PLACES = 0, 1
DECISIONS, SPANS = 0, 2
JUDGED = "key long, kind int, runs binary, places binary"


def _least_hashes(data: np.ndarray) -> np.ndarray:
    """The least hash of the strings of NAME_BYTES in each window of DEPTH bytes, in blocks that a processor's cache holds."""
    data = np.ascontiguousarray(data)
    out = np.empty(len(data) - DEPTH + 1, dtype=np.uint64)
    for a in range(0, len(out), BLOCK):
        own = out[a : a + BLOCK]
        n = len(own) + REACH - 1
        words = np.ndarray((n + NAME_BYTES - 8,), dtype="<u8", buffer=data, offset=a, strides=(1,)).astype(np.uint64)
        hashes = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, NAME_BYTES, 8):
                hashes *= np.uint64(0x9E3779B97F4A7C15)
                hashes += words[k : k + n]
            hashes = mix(hashes * np.uint64(0xC2B2AE3D27D4EB4F))
        span = 1
        while 2 * span <= REACH:
            hashes = np.minimum(hashes[:-span], hashes[span:])
            span *= 2
        np.minimum(hashes[: len(own)], hashes[REACH - span :], out=own)
    return out


def window_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one window, text and 48-bit name of each run of equally named windows."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < DEPTH:
        return none, none, none, none.astype(np.uint64)
    least = _least_hashes(data)
    begins = np.empty(len(least), dtype=bool)
    begins[0] = True
    np.not_equal(least[1:], least[:-1], out=begins[1:])
    first = offsets[:-1]
    begins[first[first < len(least)]] = True
    starts = np.flatnonzero(begins)
    owner = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + DEPTH <= offsets[owner + 1]
    starts, owner = starts[valid], owner[valid]
    ends = np.append(starts[1:], len(least))
    ends = np.minimum(ends, offsets[owner + 1] - DEPTH + 1)
    return starts, ends, owner, least[starts] >> np.uint64(16)


def _packed(names: np.ndarray) -> bytes:
    """Names in 6 bytes each."""
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PACK]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // _PACK, 8), dtype=np.uint8)
    wide[:, :_PACK] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _PACK)
    return wide.view("<u8").ravel()


def _press(ids: np.ndarray, tags: np.ndarray, owner: np.ndarray, names: np.ndarray) -> bytes:
    """Documents, how many names each has, and the names; ``owner`` (into ids and tags) is in order."""
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    counts = np.diff(np.append(head, len(owner))).astype("<u4")
    used = owner[head]
    body = struct.pack("<II", len(used), len(names)) + ids[used].astype("<i8").tobytes() + tags[used].astype("<i8").tobytes() + counts.tobytes() + _packed(names)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpress(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, tags, owners of the names (into ids and tags), names, and the blob of each name."""
    ids, tags, counts, names, sizes = [], [], [], [], []
    open_ = zstandard.ZstdDecompressor()
    for blob in blobs:
        data = open_.decompress(blob.as_py())
        n, m = struct.unpack_from("<II", data)
        ids.append(np.frombuffer(data, "<i8", n, 8))
        tags.append(np.frombuffer(data, "<i8", n, 8 + 8 * n))
        counts.append(np.frombuffer(data, "<u4", n, 8 + 16 * n))
        names.append(_unpacked(data[8 + 20 * n :]))
        sizes.append(m)
    counts = np.concatenate(counts)
    return np.concatenate(ids), np.concatenate(tags), np.repeat(np.arange(len(counts)), counts), np.concatenate(names), np.repeat(np.arange(len(sizes)), sizes)


def _edges(values: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64), len(values))


def _by(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Stable order by two columns of numbers from 0 on, by one sort of their product where it fits."""
    n = len(major)
    width, high = int(minor.max(initial=0)) + 1, int(major.max(initial=0)) + 1
    return np.argsort((major * width + minor) * n + np.arange(n)) if high * width * n < 2**63 else np.lexsort((minor, major))


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _name_rows(slots: int):
    """A piece's names by slot: asked ones, those known to repeat, and by part those settled here."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        _, _, owner, names = window_runs(*utf8(batch.column("text")))
        if not len(names):
            return None
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
        both = np.sort(names << np.uint64(16) | owner.astype(np.uint64))  # a batch has at most BATCH_ROWS rows
        both = both[_edges(both)[:-1]]
        names, owner = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
        edges = _edges(names)
        first = edges[:-1]
        several = np.repeat(np.minimum.reduceat(ids[owner], first) != np.maximum.reduceat(ids[owner], first), np.diff(edges))
        lead = np.zeros(len(names), dtype=bool)
        lead[first] = True
        slot = (names % np.uint64(slots)).astype(np.int64)
        out: tuple[list, list, list] = ([], [], [])
        for flag, keep, where in ((QUERY, ~several, slot), (KNOWN, several & lead, slot), (SETTLED, several, slots + _part(ids, slots)[owner])):
            w, o, n = where[keep], owner[keep], names[keep]
            by = _by(w, o)
            w, o, n = w[by], o[by], n[by]
            cuts = _edges(w).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for column, value in zip(out, (int(w[a]), flag, _press(ids, tags, o[a:b], n[a:b])), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["slot", "flag", "names"])

    return rows


def _survivors(slots: int):
    """A slot's asked names that stand in two documents, by part of the document; settled ones pass."""

    def settle(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        if slot >= slots:
            return pa.table({"part": pa.array(np.full(table.num_rows, slot - slots, np.int32)), "names": table.column("names")})
        ids, tags, owner, names, row = _unpress(table.column("names"))
        flag = table.column("flag").to_numpy()[row]
        order = np.argsort(names)
        edges = _edges(names[order])
        doc = ids[owner[order]]
        lives = (np.minimum.reduceat(doc, edges[:-1]) != np.maximum.reduceat(doc, edges[:-1])) | (np.maximum.reduceat(flag[order], edges[:-1]) == KNOWN)
        keep = np.empty(len(names), dtype=bool)
        keep[order] = np.repeat(lives, np.diff(edges))
        keep &= flag == QUERY
        owner, names = owner[keep], names[keep]
        part = _part(ids, slots)[owner]
        by = _by(part, owner)
        owner, names, part = owner[by], names[by], part[by]
        cuts = _edges(part).tolist()
        made = [_press(ids, tags, owner[a:b], names[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"part": pa.array(part[cuts[:-1]].astype(np.int32)), "names": pa.array(made, pa.binary())})

    return settle


def _found(table: pa.Table) -> pa.Table:
    """A part's repeating names to one row a document."""
    ids, tags, owner, names, _ = _unpress(table.column("names"))
    order = np.lexsort((names, tags[owner], ids[owner]))
    i, t, names = ids[owner][order], tags[owner][order], names[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])), len(i))
    made = [_packed(names[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(i[edges[:-1]]), "tag": pa.array(t[edges[:-1]]), "found": pa.array(made, pa.binary())})


class _Cut:
    """Collects the repeating runs of a task's pieces; equal ones are kept once until ``rows`` hands them out."""

    def __init__(self, shards: int):
        self.shards = shards
        self.distinct: dict[bytes, int] = {}
        self.held, self.shard, self.names, self.found, self.docs, self.rows_before = 0, [], [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        """doc_id, tag, text, found (names that repeat)."""
        data, offsets = utf8(batch.column("text"))
        starts, ends, owner, names = window_runs(data, offsets)
        found = batch.column("found").to_pylist()
        known, row = _unpacked(b"".join(found)), np.repeat(np.arange(len(found)), [len(f) // _PACK for f in found])
        key = np.sort(known | row.astype(np.uint64) << np.uint64(48))
        mine = names | owner.astype(np.uint64) << np.uint64(48)
        at = np.minimum(np.searchsorted(key, mine), max(0, len(key) - 1))
        keep = (key[at] == mine) if len(key) else np.zeros(len(mine), dtype=bool)
        starts, ends, owner, names = starts[keep], ends[keep], owner[keep], names[keep]
        if not len(starts):
            return
        raw, ids, tags = data.tobytes(), batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        shard, distinct, before = (mix(names) % np.uint64(self.shards)).astype(np.int64), self.distinct, len(self.distinct)
        index = np.array([distinct.setdefault(raw[x : y + DEPTH - 1], len(distinct)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
        new = np.flatnonzero(index >= before)
        own = np.empty(len(distinct) - before, dtype=np.int64)
        own[index[new] - before] = shard[new]
        self.shard.append(own)
        own = np.empty(len(distinct) - before, dtype=np.uint64)
        own[index[new] - before] = names[new]
        self.names.append(own)
        self.found.append((index, owner + self.rows_before, starts - offsets[owner]))
        self.docs.append((ids, tags))
        self.rows_before += len(ids)
        self.held += int((ends - starts).sum()) + 40 * len(starts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows of (key, kind, runs, places): a shard's runs with their places, and places of frequent runs, dealt evenly."""
        if not self.found:
            return
        runs, shard, names = list(self.distinct), np.concatenate(self.shard), np.concatenate(self.names)
        index, row, starts = (np.concatenate(c) for c in zip(*self.found, strict=True))
        ids, tags = (np.concatenate(c) for c in zip(*self.docs, strict=True))
        place = np.empty(len(ids), dtype=np.int64)
        place[np.lexsort((tags, ids))] = np.arange(len(ids))
        order = _by(shard[index], place[row])
        ids, tags = ids[row], tags[row]
        smallest = np.full(len(runs), np.iinfo(np.int64).max)
        np.minimum.at(smallest, index, ids)
        frequent = np.bincount(index, minlength=len(runs)) > FREQUENT
        lengths = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        press, out = zstandard.ZstdCompressor(level=3), []
        places = lambda own, number: _columns(press, (number, "<u4"), (ids[own], "<i8"), (tags[own], "<i8"), (starts[own], "<u4"))
        local = np.empty(len(runs), dtype=np.int64)
        for is_hot in (False, True):
            chosen = order[frequent[index[order]] == is_hot]
            where = shard[index[chosen]]
            edges = _edges(where)
            stands = {int(where[a]): chosen[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
            every = np.argsort(shard, kind="stable")
            cuts = _edges(shard[every])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own, at = every[a:b], int(shard[every[a]])
                here = stands.get(at, np.zeros(0, dtype=np.int64))
                if is_hot:
                    own = own[frequent[own]]
                    if not len(own):
                        continue
                local[own] = np.arange(len(own))
                body = places(here, local[index[here]])
                if is_hot:
                    out.append((at, PLACES, _columns(press, (_marks(runs[k] for k in own.tolist()).view("u1"), "u1")), body))
                else:
                    head = _columns(press, (names[own], "<u8"), (lengths[own], "<u4"), (smallest[own], "<i8"), (frequent[own], "u1"), (np.frombuffer(b"".join([runs[k] for k in own.tolist()]), dtype=np.uint8), "u1"))
                    out.append((at, RUNS, head, body))
        self.distinct = {}
        self.held, self.shard, self.names, self.found, self.docs, self.rows_before = 0, [], [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "kind", "runs", "places"])


def _marks(runs: Iterator[bytes]) -> np.ndarray:
    """128 bits for each run: what equal runs are known by."""
    return np.frombuffer(b"".join([hashlib.blake2b(r, digest_size=16).digest() for r in runs]), dtype="V16")


def _columns(press: zstandard.ZstdCompressor, *columns: tuple[np.ndarray, str]) -> bytes:
    """Columns of numbers, each behind its length in bytes."""
    made = [values.astype(kind).tobytes() for values, kind in columns]
    return press.compress(b"".join(struct.pack("<Q", len(m)) + m for m in made))


def _read_columns(body: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for kind in kinds:
        (size,) = struct.unpack_from("<Q", data, at)
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _cut_runs(shards: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Cut(shards)
        for batch in batches:
            for piece in pieces(batch):
                cut.add(piece)
                if cut.held > HELD_BYTES:
                    yield from cut.rows()
        yield from cut.rows()

    return each


def _judge(parts: int, fan: int):
    """A shard's runs to spans that go, by part of the document, and to decisions on its frequent runs."""

    def judge(key: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Scratch() as scratch, tempfile.TemporaryFile(dir=scratch.folder) as texts, tempfile.TemporaryFile(dir=scratch.folder) as places:
            sizes, columns = [], []
            for batch in batches:
                for kind, runs, place in zip(*(batch.column(c).to_pylist() for c in ("kind", "runs", "places")), strict=True):
                    if kind == PLACES:  # these only pass
                        sub = int(mix(np.array([zlib.crc32(place)], dtype=np.uint64))[0] % np.uint64(fan))
                        yield _judged([key * fan + sub], [PLACES], [runs], [place])
                        continue
                    names, lengths, smallest, frequent, text = _read_columns(runs, "<u8", "<u4", "<i8", "u1", "u1")
                    ends, body = np.cumsum(lengths, dtype=np.int64), text.tobytes()
                    columns.append((_marks(body[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)), names, lengths, smallest, frequent))
                    texts.write(body)
                    places.write(place)
                    sizes.append((len(names), len(place)))
            if not sizes:
                return
            marks, names, lengths, smallest, frequent = (np.concatenate(c) for c in zip(*columns, strict=True))
            del columns
            halves = marks.view("<u8").reshape(-1, 2)
            order = np.lexsort((halves[:, 1], halves[:, 0]))
            new = np.concatenate([[True], (halves[order][1:] != halves[order][:-1]).any(axis=1)])
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.cumsum(new) - 1
            lead = order[new]  # one row for each distinct run
            least = np.minimum.reduceat(smallest[order], np.flatnonzero(new))
            hot = np.maximum.reduceat(frequent[order], np.flatnonzero(new)) > 0
            # A window stands in runs of its name only: where a name has one run, that run's documents are the window's.
            _, of, runs_of = np.unique(names[lead], return_inverse=True, return_counts=True)
            several = np.flatnonzero(runs_of[of] > 1)
            counts, when, who = np.ones(len(lead), dtype=np.int64), np.zeros(len(lead), dtype=np.int64), least
            if len(several):
                inner, inner_when, inner_who = _decisions(texts, np.cumsum(lengths, dtype=np.int64) - lengths, lengths, lead[several], least[several], scratch)
                counts[several] = np.diff(inner)
                first = np.cumsum(counts) - counts
                at = np.repeat(first[several] - inner[:-1], counts[several]) + np.arange(inner[-1])
                when, who = np.zeros(int(counts.sum()), dtype=np.int64), np.repeat(least, counts)
                when[at], who[at] = inner_when, inner_who
            head = np.concatenate([[0], np.cumsum(counts)])
            size = lengths[lead].astype(np.int64)
            if hot.any():
                press, own = zstandard.ZstdCompressor(level=1), np.flatnonzero(hot)
                counts = np.diff(head)[own]
                at = np.repeat(head[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                yield _judged([key], [DECISIONS], [_columns(press, (marks[lead[own]].view("u1"), "u1"), (size[own], "<u4"), (counts, "<u4"), (when[at], "<u4"), (who[at], "<i8"))], [b""])
            places.seek(0)
            first = 0
            for n, width in sizes:
                index, ids, tags, starts = _read_columns(places.read(width), "<u4", "<i8", "<i8", "<u4")
                yield from _going(number[first : first + n][index], ids, tags, starts, head, when, who, size, parts)
                first += n

    return judge


def _judged(key: list, kind: list, runs: list, places: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(runs, pa.binary()), pa.array(places, pa.binary())], ["key", "kind", "runs", "places"])


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _decisions(texts: object, begin: np.ndarray, lengths: np.ndarray, lead: np.ndarray, least: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct run (``lead``): where its stretches begin among all, the first window of each, and the
    smallest doc_id in which the windows of the stretch stand. The runs are one text, whose suffixes are sorted on disk."""
    size = lengths[lead].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    text, decides = scratch.array(int(offsets[-1]), "uint8"), scratch.array(int(offsets[-1]), "int32")
    text[offsets[1:] - 1] = 1
    docs, rank = np.unique(least, return_inverse=True)
    rank, begins = rank.astype(np.int32), begin[lead]
    order = np.argsort(begins)
    for own in np.split(order, np.flatnonzero(np.diff(begins[order] // READ_BYTES)) + 1):  # in the order of the file
        first = int(begins[own[0]])
        texts.seek(first)
        held = np.frombuffer(texts.read(int(begins[own[-1]] + size[own[-1]]) - first), dtype=np.uint8)
        inner = _ranges(size[own])
        to = np.repeat(offsets[own], size[own]) + inner
        text[to] = held[np.repeat(begins[own] - first, size[own]) + inner] + np.uint8(2)  # UTF-8 bytes end at 244
        decides[to] = np.where(inner <= np.repeat(size[own] - DEPTH, size[own]), np.repeat(rank[own], size[own]), NO_WINDOW)
    decides[offsets[1:] - 1] = NO_WINDOW
    order, shared = sort_suffixes(text, scratch)
    at = 0
    while at < len(order):  # blocks end between classes of suffixes that share DEPTH bytes: all are windows, or none is
        stop = min(len(order), at + SORTED_ROWS)
        while stop < len(order):
            apart = np.flatnonzero(shared[stop : stop + SORTED_ROWS] < DEPTH)
            stop = min(len(order), stop + (int(apart[0]) if len(apart) else SORTED_ROWS))
            if len(apart):
                break
        places = order[at:stop]
        new = shared[at:stop] < DEPTH
        new[0] = True
        first = np.flatnonzero(new)
        decides[places] = np.repeat(np.minimum.reduceat(decides[places], first), np.diff(np.append(first, len(places))))
        at = stop
    heads, when, who = [np.zeros(1, dtype=np.int64)], [], []
    total = 0
    for a in range(0, len(size), DECIDED_RUNS):
        windows = size[a : a + DECIDED_RUNS] - DEPTH + 1
        first = np.cumsum(windows) - windows
        place = np.repeat(offsets[a : a + len(windows)], windows) + _ranges(windows)
        values = decides[place]
        new = np.concatenate([[True], values[1:] != values[:-1]])
        new[first] = True
        new = np.flatnonzero(new)
        own = np.searchsorted(first, new, "right") - 1
        when.append(new - first[own])
        who.append(docs[values[new]])
        counts = np.bincount(own, minlength=len(windows))
        heads.append(total + np.cumsum(counts))
        total += len(new)
    return np.concatenate(heads), np.concatenate(when), np.concatenate(who)


def _going(run: np.ndarray, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, head: np.ndarray, when: np.ndarray, who: np.ndarray, size: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The stretches of places whose documents are not the first, as packed spans by part of the document."""
    counts = np.diff(head)[run]
    owner = np.repeat(np.arange(len(run)), counts)
    at = np.repeat(head[run] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    goes = np.flatnonzero(ids[owner] > who[at])
    owner, at = owner[goes], at[goes]
    last = at + 1 == head[run[owner] + 1]
    upto = np.where(last, size[run[owner]] - DEPTH + 1, when[np.minimum(at + 1, len(when) - 1)])
    first, stop = starts[owner].astype(np.int64) + when[at], starts[owner].astype(np.int64) + upto + DEPTH - 1
    part = _part(ids[owner], parts)
    order = np.lexsort((first, tags[owner], ids[owner], part))
    owner, first, stop, part = owner[order], first[order], stop[order], part[order]
    edges = _edges(part)
    press, out = zstandard.ZstdCompressor(level=1), []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = owner[x:y]
        out.append(press.compress(b"".join(v.astype(k).tobytes() for v, k in ((ids[own], "<i8"), (tags[own], "<i8"), (first[x:y], "<u4"), (stop[x:y], "<u4")))))
    if out:
        yield _judged(part[edges[:-1]].tolist(), [SPANS] * len(out), [b""] * len(out), out)


def _settle_frequent(parts: int):
    """Decisions on a shard's frequent runs, then the places of these runs, to spans."""

    def settle(key: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            for kind, runs, place in zip(*(batch.column(c).to_pylist() for c in ("kind", "runs", "places")), strict=True):
                if kind == DECISIONS:
                    marks, size, counts, when, who = _read_columns(runs, "V16", "<u4", "<u4", "<u4", "<i8")
                    number = {m: k for k, m in enumerate(marks.tolist())}
                    known = (np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), when.astype(np.int64), who, size.astype(np.int64))
                    continue
                (marks,) = _read_columns(runs, "V16")
                own = np.array([number[m] for m in marks.tolist()])
                index, ids, tags, starts = _read_columns(place, "<u4", "<i8", "<i8", "<u4")
                yield from _going(own[index], ids, tags, starts, *known, parts)

    return settle


def _gather(table: pa.Table) -> pa.Table:
    """A part's packed windows to one row a document: doc_id, tag, spans (start, end pairs, u32, merged)."""
    columns: list[list[np.ndarray]] = [[], [], [], []]
    press = zstandard.ZstdDecompressor()
    for blob in table.column("places"):
        data = press.decompress(blob.as_py())
        n, at = len(data) // 24, 0
        for column, kind in zip(columns, ("<i8", "<i8", "<u4", "<u4"), strict=True):
            column.append(np.frombuffer(data, kind, n, at))
            at += column[-1].nbytes
    ids, tags, first, stop = (np.concatenate(c) for c in columns)
    order = np.lexsort((first, tags, ids))
    ids, tags, first, stop = ids[order], tags[order], first[order].astype(np.int64), stop[order].astype(np.int64)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    # Spans of one document that touch become one: ends reach over earlier documents by an offset for each.
    shift = np.cumsum(new) << 33
    reach = np.maximum.accumulate(stop + shift)
    starts = np.concatenate([[True], (first + shift)[1:] > reach[:-1]])
    head = np.flatnonzero(starts)
    spans = np.stack([first[head], np.maximum.reduceat(stop, head)], axis=1).astype("<u4")
    edges = np.append(np.flatnonzero(new[head]), len(head))
    blobs = [spans[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    docs = head[edges[:-1]]
    return pa.table({"doc_id": pa.array(ids[docs]), "tag": pa.array(tags[docs]), "spans": pa.array(blobs, pa.binary())})


def removed_mask(length: int, spans: bytes | None) -> np.ndarray:
    pairs = np.frombuffer(spans or b"", dtype="<u4").reshape(-1, 2).astype(np.int64)
    change = np.zeros(length + 1, dtype=np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _result(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = utf8(batch.column("text"))
    rows = []
    for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
        gone = removed_mask(b - a, spans)
        edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) > 0 and gone[0])
        rows.append((b - a, int(gone.sum()), int(edges), hashlib.sha256(data[a:b][~gone].tobytes()).hexdigest()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, tag, text), and doc_id, tag, spans of those that lose bytes."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"), text.alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots, shards = max(8, -(-total // SLOT_BYTES)), max(8, -(-total // SHARD_BYTES))
    named = texts.where("doc_id is not null and text is not null")
    names = map_pieces(named, _name_rows(slots), "slot int, flag int, names binary")
    repeating = by_key(names, "slot", 2 * slots, whole(_survivors(slots)), "part int, names binary")
    survivors = saved(by_key(repeating, "part", slots, whole(_found), "doc_id long, tag long, found binary"), folder, "survivors")
    touched = survivors.select("doc_id", "tag")
    chosen = texts.join(small(touched, 64), ["doc_id", "tag"], "left_semi").join(survivors, ["doc_id", "tag"])
    bounded_batches(spark)
    runs = chosen.mapInArrow(_cut_runs(shards), "shard long, kind int, runs binary, places binary")
    fan = int(min(MOST_FAN, max(2, -(-total // FAN_BYTES))))
    judged = saved(by_key(runs, "shard", shards, _judge(slots, fan), JUDGED), folder, "judged")
    going = judged.where(F.col("kind") == SPANS)
    frequent = judged.where(F.col("kind") == DECISIONS)
    if not frequent.isEmpty():
        sent = frequent.withColumn("key", F.explode(F.sequence(F.col("key") * fan, F.col("key") * fan + fan - 1)))
        both = sent.unionByName(judged.where(F.col("kind") == PLACES))
        going = going.unionByName(by_key(both, "key", shards, _settle_frequent(slots), JUDGED, "kind"))
    spans = saved(by_key(going.withColumnRenamed("key", "part"), "part", slots, whole(_gather), "doc_id long, tag long, spans binary"), folder, "spans")
    return texts, spans


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts, spans = repeated_spans(docs)
    joined = texts.join(small(spans, 64, "spans"), ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return map_pieces(joined, _result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
