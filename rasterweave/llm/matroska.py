"""Matroska media columns: a writer for 8-bit audio and a parser to packet tables.

The parser walks EBML elements with variable-length ids and sizes (unknown sizes too), reads clusters,
simple blocks and block groups, undoes all lacings (none, Xiph, fixed, EBML), and gives one row a frame:
track, cluster, timestamp, byte range, key flag; cues give seek points. It never copies frames: a payload
is read through the table's byte ranges.

A text's bytes, padded by 255 to a positive multiple of 576, are the samples of one track of unsigned
8-bit PCM; frames hold 576 samples, blocks lace up to 8 frames, clusters hold up to 64.

Inputs: a null text is empty (one frame of padding); equal texts give equal media; rows that repeat or have
a null doc_id are treated like any other; extra columns are ignored; media that is null or broken gives
no packets in PERMISSIVE mode and raises otherwise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import map_pieces, utf8

# Element ids and constants of the format.
EBML, EBML_VERSION, EBML_READ, EBML_ID_LENGTH, EBML_SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH, LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS = 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367
LEVEL_ONE = frozenset((INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS))

FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, SAMPLE_RATE, SCALE_NS = 576, 8, 8, 8000, 1_000_000
FRAME_MS = FRAME * 1000 // SAMPLE_RATE


def _id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def _size(value: int, length: int | None = None) -> bytes:
    """A variable-length size; the all-ones value is kept for unknown sizes."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def _element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def _uint(kind: int, value: int) -> bytes:
    return _element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: str) -> bytes:
    """Flags, lace header and frames of a block, without track and timestamp."""
    if len(frames) == 1:
        return b"\x80" + frames[0]
    count = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "fixed":
        return b"\x84" + count + b"".join(frames)
    if lacing == "xiph":
        return b"\x82" + count + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]) + b"".join(frames)
    head = _size(sizes[0])
    for before, now in zip(sizes, sizes[1:-1], strict=False):
        change = now - before
        n = next(k for k in range(1, 9) if abs(change) < (1 << 7 * k - 1) - 1)
        head += _size(change + (1 << 7 * n - 1) - 1, n)
    return b"\x86" + count + head + b"".join(frames)


def mux(payload: bytes, lacing: str = "fixed") -> bytes:
    """A file with one track of unsigned 8-bit PCM; the payload is a multiple of 576 bytes."""
    head = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_ID_LENGTH, 4) + _uint(EBML_SIZE_LENGTH, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
    frames = len(payload) // FRAME
    info = _element(INFO, _uint(SCALE, SCALE_NS) + _element(DURATION, struct.pack(">d", frames * FRAME_MS)) + _element(MUXER, b"rasterweave") + _element(WRITER, b"rasterweave"))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    per_cluster = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, frames, per_cluster):
        body = [_uint(TIMESTAMP, first * FRAME_MS)]
        for k in range(first, min(first + per_cluster, frames), FRAMES_A_BLOCK):
            n = min(FRAMES_A_BLOCK, frames - k)
            lace = [payload[(k + i) * FRAME : (k + i + 1) * FRAME] for i in range(n)] if lacing != "fixed" or n == 1 else None
            block = _laced(lace, lacing) if lace else b"\x84" + bytes([n - 1]) + payload[k * FRAME : (k + n) * FRAME]
            body.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", (k - first) * FRAME_MS) + block))
        cues.append(_element(CUE, _uint(CUE_TIME, first * FRAME_MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(_element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    whole = b"".join(parts)
    return head + _id(SEGMENT) + _size(len(whole), 8) + whole


class MediaError(ValueError):
    """Bytes that do not parse."""


@dataclass
class Media:
    """What a file holds; packets are (track, cluster, timestamp, offset, size, key), times in scale units."""

    doc_type: str = ""
    scale: int = SCALE_NS
    segment: int = 0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """A variable-length number: value, next place, whether all value bits are ones."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise MediaError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + length], "big")
    value = raw & (1 << 7 * length) - 1
    return (raw if keep_marker else value), at + length, value == (1 << 7 * length) - 1


def elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Children in a byte range: id, start of the element, start and end of its body.

    A body of unknown size reaches to the next element that cannot be its child, found by its own walk.
    """
    while at < end:
        start = at
        kind, at, _ = _number(data, at, True)
        if parent == CLUSTER and kind in LEVEL_ONE:
            return
        size, at, unknown = _number(data, at, False)
        stop = at + size
        if unknown:
            stop = end if kind != CLUSTER else max((e for _, _, _, e in elements(data, at, end, CLUSTER)), default=at)
        if stop > end:
            raise MediaError(f"element {kind:X} at byte {start} is cut off")
        yield kind, start, at, stop
        at = stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the frames' byte ranges of a block."""
    track, at, _ = _number(data, at, False)
    if at + 3 > end:
        raise MediaError(f"block cut off at byte {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    if lacing == 2:
        if (end - at) % n:
            raise MediaError(f"fixed lace at byte {at} does not divide")
        size = (end - at) // n
        return track, relative, flags, [(at + k * size, size) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            size, at, _ = _number(data, at, False)
            if k:
                size = sizes[-1] + size - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError(f"lace at byte {at} is longer than its block")
    starts = at + np.cumsum([0, *sizes[:-1]])
    return track, relative, flags, list(zip(starts.tolist(), sizes, strict=True))


def _value(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def demux(data: bytes) -> Media:
    """Parses a whole file."""
    out = Media()
    for kind, _, at, end in elements(data, 0, len(data)):
        if kind == EBML:
            for k, _, a, e in elements(data, at, end):
                if k == DOC_TYPE:
                    out.doc_type = data[a:e].rstrip(b"\0").decode(errors="replace")
        elif kind == SEGMENT:
            out.segment = at
            for part in elements(data, at, end, SEGMENT):
                _segment_part(data, out, *part)
    if out.doc_type not in ("matroska", "webm"):
        raise MediaError("no Matroska header")
    return out


def _segment_part(data: bytes, out: Media, kind: int, start: int, at: int, end: int) -> None:
    if kind == INFO:
        for k, _, a, e in elements(data, at, end):
            if k == SCALE:
                out.scale = _value(data, a, e)
    elif kind == TRACKS:
        for child, _, a, e in elements(data, at, end):
            if child != TRACK:  # checksums and fillers stand among them
                continue
            track: dict = {}
            for k, _, x, y in elements(data, a, e):
                if k in (TRACK_NUMBER, TRACK_TYPE):
                    track["number" if k == TRACK_NUMBER else "type"] = _value(data, x, y)
                elif k == CODEC:
                    track["codec"] = data[x:y].rstrip(b"\0").decode(errors="replace")
                elif k == AUDIO:
                    for q, _, u, v in elements(data, x, y):
                        if q == RATE:
                            track["rate"] = {8: struct.Struct(">d"), 4: struct.Struct(">f")}[v - u].unpack(data[u:v])[0] if v - u in (4, 8) else 0.0
                        elif q in (CHANNELS, DEPTH):
                            track["channels" if q == CHANNELS else "depth"] = _value(data, u, v)
            out.tracks.append(track)
    elif kind == CLUSTER:
        number, base = len(out.clusters), 0
        out.clusters.append(start - out.segment)
        for k, _, a, e in elements(data, at, end, CLUSTER):
            if k == TIMESTAMP:
                base = _value(data, a, e)
            elif k == SIMPLE_BLOCK:
                _add_block(data, out, number, base, a, e, None)
            elif k == BLOCK_GROUP:
                inner = list(elements(data, a, e))
                key = not any(q == REFERENCE for q, *_ in inner)
                for q, _, x, y in inner:
                    if q == BLOCK:
                        _add_block(data, out, number, base, x, y, key)
    elif kind == CUES:
        for child, _, a, e in elements(data, at, end):
            if child != CUE:
                continue
            when = 0
            for k, _, x, y in elements(data, a, e):
                if k == CUE_TIME:
                    when = _value(data, x, y)
                elif k == CUE_POSITIONS:
                    got = {q: _value(data, u, v) for q, _, u, v in elements(data, x, y)}
                    out.cues.append((when, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))


def _add_block(data: bytes, out: Media, cluster: int, base: int, at: int, end: int, key: bool | None) -> None:
    track, relative, flags, frames = _frames(data, at, end)
    step = FRAME_MS if len(frames) > 1 else 0  # laced PCM frames follow each other
    for k, (offset, size) in enumerate(frames):
        out.packets.append((track, cluster, base + relative + k * step, offset, size, bool(flags & 0x80) if key is None else key))


def payload_of(text: bytes) -> bytes:
    """Text bytes and as many bytes 255 as reach a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def features(payload: bytes, media: Media) -> str:
    """Frames, clusters, cues, mean, root mean square, peak and zero crossings of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"frames={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};peak={int(np.abs(x).max())};crossings={crossings}"


def to_media(docs: DataFrame, lacing: str = "fixed") -> DataFrame:
    """doc_id, media: every text as a file in a column."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        made = [mux(payload_of(raw[a:b]), lacing) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "media"])

    return map_pieces(_texts(docs), each, "doc_id long, media binary")


def packets(media: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """doc_id, track, cluster, timestamp_ns, position, size, is_key: one row a frame, in file order."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = [], []
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            try:
                parsed = demux(data if data is not None else b"")
            except (MediaError, IndexError, struct.error):
                if mode != "PERMISSIVE":
                    raise
                continue
            ids += [doc_id] * len(parsed.packets)
            rows += [(t, c, w * parsed.scale, o, s, k) for t, c, w, o, s, k in parsed.packets]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "track", "cluster", "timestamp_ns", "position", "size", "is_key"])

    return map_pieces(media.select(F.col("doc_id").cast("long").alias("doc_id"), "media"), each, "doc_id long, track int, cluster int, timestamp_ns long, position long, size long, is_key boolean", "media")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def media_digests(docs: DataFrame) -> DataFrame:
    """Per document: sizes and digests of the payload as read back from the media, and features."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            stored = mux(payload_of(raw[a:b]))
            parsed = demux(stored)
            back = b"".join([stored[p[3] : p[3] + p[4]] for p in parsed.packets])
            out.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, parsed)))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], ["doc_id", *names])

    return map_pieces(_texts(docs), each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
