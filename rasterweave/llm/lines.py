"""Line deduplication by a segment-partition edit join.

A line's form is the line without white space at its ends, A-Z in lower case, as bytes. Lines with forms
of ``least`` bytes or more are compared; shorter ones always stay. The registered query and the pipeline
compare every line that is not empty (``least`` 1); without it MIN_BYTES holds. A line goes if an earlier
line, by (doc_id, line number), has a form within BOUND edits: the first of any set of close lines stays.

Forms are met once each, by 128 bits of hash (64 of them cryptographic), with the place where they stand
first. A form of length L is cut into BOUND + 1 segments; any form within BOUND edits holds one of them at a
place that the length difference bounds. Keys are 64-bit hashes of (length, segment number, bytes): every form
indexes its segments and probes with those substrings of its own that can match an indexed form of its length
or up to BOUND less. A key that more than FREQUENT forms index (a template) is refined: two edits change at
most 2 BOUND bits of the parities of a form's bytes, so of 2 BOUND + 1 groups of these bits one is the same in
both forms, and forms meet by (key, group, its bits). Pairs that meet must also agree in all but 2 BOUND
parities; those that do are verified on the bytes by banded bit-parallel edit distance. Forms too short for
BOUND + 1 segments meet others at hubs: keys that two forms share, from opposite sides, only if they are
within BOUND edits. Places of forms that stand very often get their verdict from a broadcast table and are
dealt evenly; all others meet the first place of their form in a join.

Inputs: a null text has no line and stays null; an empty line always stays; rows that repeat a doc_id
are ordered as one document with its lines side by side, so equal rows do not empty each other; a row with
a null doc_id is left as it is; extra columns are kept by :func:`deduplicated`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import bounded_batches, map_pieces, saved, shared_folder, small, utf8
from rasterweave.llm.editdistance import within
from rasterweave.llm.words import Spans

BOUND, MIN_BYTES = 2, 32
SEGMENTS = BOUND + 1
#: Bits of the parities, dealt to 2 BOUND + 1 groups; a key that more forms index is refined by them.
PARITY_BITS, GROUPS, FREQUENT = 60, 2 * BOUND + 1, 256
#: A form is common if it makes up this share of all lines: there are never more than its inverse.
COMMON_SHARE, COMMON_LEAST, DEALT = 1e-5, 100, 4096
#: Forms shorter than SEGMENTS can be close to forms of up to this many bytes.
TINY = SEGMENTS - 1 + BOUND
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The parity bit of a byte: small letters and digits have one each, all others share the rest.
_BIT = np.arange(256) % 24 + 36
_BIT[ord("a") : ord("z") + 1] = np.arange(26)
_BIT[ord("0") : ord("9") + 1] = np.arange(26, 36)
_MASKS = [sum(1 << b for b in range(g, PARITY_BITS, GROUPS)) for g in range(GROUPS)]


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the trimmed lines of all texts, the text and the number of each."""
    breaks = np.flatnonzero(data == 0x0A)
    per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    owner = np.repeat(np.arange(len(per)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    first = number == 0
    starts, ends = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    starts[first] = offsets[:-1]
    starts[~first] = breaks + 1
    last = np.append(first[1:], True) if len(first) else first
    ends[last] = offsets[1:]
    ends[~last] = breaks
    solid = np.flatnonzero(~_WHITE[data])
    if len(solid):
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
        full = b >= a
        starts = np.where(full, solid[np.minimum(a, len(solid) - 1)], starts)
        ends = np.where(full, solid[np.maximum(b, 0)] + 1, starts)
    else:
        ends = starts.copy()
    return starts, ends, owner, number


def segment(length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i (from 0) of forms of these lengths: as even as can be, long ones last."""
    size, more = length // SEGMENTS, length % SEGMENTS
    short = SEGMENTS - more
    return size * i + np.maximum(0, i - short), size + (i >= short)


def probes() -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of all substrings that must be looked up; own segments first."""
    own = [(0, i, 0) for i in range(SEGMENTS)]
    rest = []
    for less in range(BOUND + 1):
        for i in range(SEGMENTS):
            low = max(-i, less - (BOUND - i))
            high = min(i, less + (BOUND - i))
            rest += [(less, i, s) for s in range(low, high + 1) if (less, i, s) not in own]
    return own + rest


PROBES = probes()


def _line_hashes(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Spans]:
    """Starts, ends, text and number of the lines that are compared, and both hashes of their forms."""
    starts, ends, owner, number = line_spans(data, offsets)
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    spans, raw = Spans(data), _LOWER[data].tobytes()
    check = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return starts, ends, owner[keep], number[keep], spans.hashes(starts, ends).view(np.int64), np.frombuffer(check, dtype=np.int64), spans


def _parities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bit b: whether the bytes of this bit stand an odd number of times in the form."""
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << _BIT[_LOWER[data]].astype(np.uint64), out=running[1:])
    return (running[ends] ^ running[starts]).view(np.int64)


def _tiny(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Length and bytes of forms of up to TINY bytes as one number; null for longer ones."""
    length = ends - starts
    packed = length.copy()
    for k in range(TINY):
        packed = packed << 8 | (_LOWER[data[np.minimum(starts + k, len(data) - 1)]] * (k < length) if len(data) else 0)
    return pa.array(packed, mask=length > TINY)


def hubs(form: bytes) -> set[tuple[int, int]]:
    """(side, key) of a form of up to TINY bytes: it is within two edits of a form shorter than SEGMENTS exactly
    if one of them has a key on side 0 and the other has it on side 1."""
    n, out = len(form), set()
    if n <= 2:  # all of these are close to each other
        out |= {(0, 0), (1, 0)}
    if n == 1:  # close to the forms of three bytes that hold it
        out.add((0, 1 << 16 | form[0]))
    if n == 2:  # close to those of three bytes that hold a byte of it at a fitting place, of four that hold both in order
        out |= {(0, 2 << 16 | form[0]), (0, 3 << 16 | form[1]), (0, 4 << 16 | form[0] << 8 | form[1])}
    if n == 3:
        out |= {(1, 1 << 16 | x) for x in form} | {(1, 2 << 16 | x) for x in form[:2]} | {(1, 3 << 16 | x) for x in form[1:]}
    if n == 4:
        out |= {(1, 4 << 16 | x << 8 | y) for k, x in enumerate(form) for y in form[k + 1 :]}
    return out


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for k, packed in enumerate(batch.column("tiny").to_pylist()):
            made += [(k, side, key) for side, key in hubs((packed & (1 << 8 * TINY) - 1).to_bytes(TINY)[: packed >> 8 * TINY])]
        rows = batch.take(pa.array([k for k, _, _ in made], pa.int64()))
        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("form", "check", "doc_id", "line")], pa.array([s for _, s, _ in made], pa.int32()), pa.array([key for _, _, key in made], pa.int32())], ["form", "check", "doc_id", "line", "side", "key"])


def _forms(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """doc_id, line, form, check, parity, keys, tiny: the lines of a piece; keys are null where a segment would be empty."""
    data, offsets = utf8(batch.column("text"))
    starts, ends, owner, number, hashes, check, spans = _line_hashes(data, offsets, least)
    length = ends - starts
    keys = np.zeros((len(starts), len(PROBES)), dtype=np.uint64)
    none = np.zeros(keys.shape, dtype=bool)
    with np.errstate(over="ignore"):
        for k, (less, i, shift) in enumerate(PROBES):
            none[:, k] = length - less < SEGMENTS
            at, size = segment(np.maximum(length - less, 0), i)
            begin = starts + np.clip(at + shift, 0, length - size)
            raw = spans.hashes(begin, begin + size) + (length - less).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i) * np.uint64(0xD1342543DE82EF95)
            keys[:, k] = (raw ^ raw >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * len(PROBES)), pa.array(keys.reshape(-1).view(np.int64), mask=none.reshape(-1)))
    ids = batch.column("doc_id").take(pa.array(owner))
    return pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(hashes), pa.array(check), pa.array(_parities(data, starts, ends)), flat, _tiny(data, starts, ends)], ["doc_id", "line", "form", "check", "parity", "keys", "tiny"])


def _places(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    _, _, owner, number, hashes, check, _ = _line_hashes(*utf8(batch.column("text")), least)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(hashes), pa.array(check)], ["doc_id", "line", "form", "check"])


def _bytes(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """form, check, bytes of the lines that the column ``wanted`` names."""
    data, offsets = utf8(batch.column("text"))
    starts, ends, owner, number, hashes, check, _ = _line_hashes(data, offsets, least)
    wanted = [set(w) for w in batch.column("wanted").to_pylist()]
    keep = np.array([int(n) in wanted[o] for o, n in zip(owner.tolist(), number.tolist(), strict=True)], dtype=bool)
    raw = _LOWER[data].tobytes()
    made = [raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array(check[keep]), pa.array(made, pa.binary())], ["form", "check", "body"])


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    good = within(batch.column("left").to_pylist(), batch.column("right").to_pylist(), BOUND)
    kept = batch.filter(pa.array(good))
    return pa.RecordBatch.from_arrays([kept.column(c) for c in ("a", "a_check", "b", "b_check")], ["a", "a_check", "b", "b_check"])


def close_forms(forms: DataFrame, texts: DataFrame, folder: str, least: int) -> DataFrame:
    """a, a_check, b, b_check: different forms within BOUND edits, both of SEGMENTS bytes or more."""
    index = forms.select(F.col("form").alias("a"), F.col("parity").alias("pa"), F.explode(F.slice("keys", 1, SEGMENTS)).alias("k")).where("k is not null")
    probe = forms.select(F.col("form").alias("b"), F.col("parity").alias("pb"), F.posexplode("keys").alias("p", "k")).where("k is not null").select("b", "pb", "k", (F.col("p") < SEGMENTS).alias("own"))
    crowded = small(saved(index.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT).select("k", F.lit(True).alias("refined")), folder, "crowded"), 40)

    def refined(table: DataFrame, parity: str) -> DataFrame:
        groups = [F.struct(F.lit(g + 1).alias("g"), F.col(parity).bitwiseAND(F.lit(mask)).alias("bits")) for g, mask in enumerate(_MASKS)]
        plain = F.array(F.struct(F.lit(0).alias("g"), F.lit(0).cast("long").alias("bits")))
        return table.join(crowded, "k", "left").withColumn("r", F.explode(F.when(F.col("refined"), F.array(*groups)).otherwise(plain))).select(*table.columns, "r.g", "r.bits").drop("r")

    alike = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 2 * BOUND
    met = refined(index, "pa").join(refined(probe, "pb"), ["k", "g", "bits"]).where((F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b"))) & alike)
    pairs = saved(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, "pairs")
    ends = pairs.select(F.col("a").alias("form")).union(pairs.select(F.col("b").alias("form"))).distinct()
    stand = forms.select("form", "doc_id", "line").join(ends, "form", "left_semi").groupBy("doc_id").agg(F.collect_set("line").alias("wanted"))
    chosen = texts.join(small(saved(stand, folder, "wanted"), 40, "wanted"), "doc_id")
    bodies = map_pieces(chosen, partial(_bytes, least=least), "form long, check long, body binary").groupBy("form", "check").agg(F.min("body").alias("body"))
    left, right = (bodies.select(F.col("form").alias(e), F.col("check").alias(f"{e}_check"), F.col("body").alias(side)) for e, side in (("a", "left"), ("b", "right")))
    both = pairs.join(left, "a").join(right, "b").select("a", "a_check", "b", "b_check", "left", "right")
    return map_pieces(both, _verified, "a long, a_check long, b long, b_check long", "left")


def near_tiny(forms: DataFrame) -> DataFrame:
    """form, check, first: the first place of forms at the other side of a hub. The hubs are below 66 000 a side, so their table is broadcast."""
    bounded_batches(forms.sparkSession)
    at = forms.where("tiny is not null").select("form", "check", "doc_id", "line", "tiny").mapInArrow(_hubs, "form long, check long, doc_id long, line int, side int, key int")
    least = at.groupBy("key", (1 - F.col("side")).alias("side")).agg(F.min(F.struct("doc_id", "line")).alias("first"))
    return at.select("form", "check", "side", "key").join(F.broadcast(least), ["side", "key"]).groupBy("form", "check").agg(F.min("first").alias("first"))


def removals(docs: DataFrame, folder: str | None = None, least: int = MIN_BYTES) -> DataFrame:
    """doc_id, drop (numbers of the lines that go, from 0), gone (the same as a byte 1 at these places): documents that lose a line."""
    folder = folder or shared_folder(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    least = max(1, least)
    lines = map_pieces(texts, partial(_forms, least=least), "doc_id long, line int, form long, check long, parity long, keys array<long>, tiny long")
    forms = saved(lines.groupBy("form", "check").agg(F.min(F.struct("doc_id", "line", "parity", "keys", "tiny")).alias("s"), F.count("*").alias("n")).select("form", "check", "n", "s.*"), folder, "forms")
    close = saved(close_forms(forms, texts, folder, least), folder, "close")
    place = F.struct("doc_id", "line").alias("first")
    both = close.union(close.select("b", "b_check", "a", "a_check")).toDF("form", "check", "other", "other_check")
    met = both.join(forms.select(F.col("form").alias("other"), F.col("check").alias("other_check"), place), ["other", "other_check"]).select("form", "check", "first")
    if least < SEGMENTS:
        met = met.union(near_tiny(forms))
    near = met.groupBy("form", "check").agg(F.min("first").alias("near"))
    firsts = forms.select("form", "check", "n", place).join(near, ["form", "check"], "left").select("form", "check", "n", F.least("first", F.coalesce("near", "first")).alias("first"))
    total = forms.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(COMMON_LEAST, COMMON_SHARE * total)
    common = firsts.where(often).select("form", "check", F.col("first").alias("common"))  # at most 1 / COMMON_SHARE rows
    every = map_pieces(texts, partial(_places, least=least), "doc_id long, line int, form long, check long")
    told = every.join(F.broadcast(common), ["form", "check"], "left")
    dealt = told.withColumn("deal", F.when(F.col("common").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", "line"), F.lit(DEALT))).cast("int"))
    undealt = F.when(F.col("n") < 0, 1).otherwise(0)  # no literal: a constant key would be taken out of the join
    rest = firsts.where(~often).select("form", "check", undealt.cast("int").alias("deal"), "first")
    gone = dealt.join(rest, ["form", "check", "deal"], "left").where(F.coalesce("common", "first") < F.struct("doc_id", "line"))
    drops = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("drop"))
    # Lines before a number that stay, then the one that goes: a string in time linear in the lines.
    gap = F.transform("drop", lambda d, k: F.concat(F.repeat(F.lit("0"), d - F.when(k == 0, F.lit(-1)).otherwise(F.get("drop", k - 1)) - 1), F.lit("1")))
    return saved(drops.withColumn("gone", F.array_join(gap, "").cast("binary")), folder, "drop")


def kept_text(text: str | None, drop: list[int] | None) -> str | None:
    """The lines that stay, joined again."""
    if text is None or not drop:
        return text
    gone = set(drop)
    return "\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone])


def _cut(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([kept_text(t, d) for t, d in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True)], pa.string())


def _with_drops(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """own (a struct of all columns), doc_id, text, drop, gone."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return packed.join(small(drops, 48, "drop", "gone"), "doc_id", "left")


def deduplicated(docs: DataFrame, folder: str | None = None, least: int = MIN_BYTES, emptied: bool = True) -> DataFrame:
    """The documents with the lines that stay as their text.

    A document that loses all its lines that are not empty stays, or goes with ``emptied=False``. A column ``n_chars`` is set to the new length.
    """
    joined = _with_drops(docs, removals(docs, folder, least))
    goes = lambda k: F.coalesce(F.substring("gone", k + 1, F.lit(1)) == F.lit(b"1"), F.lit(False))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: ~goes(k)), "\n")
    out = joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    if not emptied:
        out = out.where(F.col("gone").isNull() | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("own.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns])


def digests(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers), kept_sha256: what deduplication does to each document."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drops = removals(chosen, least=least)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lists = batch.column("text").to_pylist(), [d or [] for d in batch.column("drop").to_pylist()]
        counts = [0 if t is None else t.count("\n") + 1 for t in texts]
        shas = [hashlib.sha256((t or "").encode()).hexdigest() for t in _cut(batch).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([len(d) for d in lists], pa.int64()), pa.array([",".join(map(str, d)) for d in lists]), pa.array(shas)], ["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"])

    return map_pieces(_with_drops(chosen, drops).select("doc_id", "text", "drop"), each, "doc_id long, n_lines long, n_removed long, removed string, kept_sha256 string")
