"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash of 16 bytes cuts every text at places that depend on content alone, so texts that share a
passage share its chunks, and a chunk is encoded once (a bounded cache in each worker and within a
batch). A chunk's tokens hold up to the ends of the chunk, where a word may be cut. So each join is
repaired: the stretch between the last sure boundary before it and the first one after it is encoded
again, and accepted when both its ends are token ends in the chunks around it; else it grows to the next
sure boundary and is encoded again, until they agree. A sure boundary is a space or line feed after a
character that is not white space, or one of ``,.;:!?`` after an ASCII letter: no token of the
pre-tokenizer holds the one after the other, so a token starts there whatever stands before, and no
special token holds any of these. A text with few sure boundaries (no spaces, scripts of three bytes a
character) is encoded whole.

What stands between two sure boundaries, mostly a word, has the same tokens everywhere. So a new chunk is
put together from its words, and the library gets only those that are not in a second bounded cache, many
in one string. Nothing is cut if the tokenizer file does not keep the rules that this rests on.

Decoding joins the tokens' bytes and reads them as UTF-8 with replacement, as the library's decoder does.

Inputs: a null text is empty; special tokens in a text become their ids, as in the library; rows that
repeat, and those with a null doc_id, are encoded like any other; other columns are ignored by
:func:`digests` and kept by :func:`with_tokens`.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import map_pieces, mix, utf8

#: A cut at one in this many places; bytes of keys and ids that a worker's cache holds.
CHUNK_BYTES, CACHE_BYTES = 1024, 24 << 20
HASH_BYTES = 16
#: Bytes that are hashed at once.
BLOCK_BYTES = 1 << 16
#: The same of the cache of words; a longer word is not kept; new words in one string.
WORD_CACHE_BYTES, WORD_BYTES, STRING_WORDS = 48 << 20, 64, 128
#: What an entry of a cache takes beside key and ids, about.
ENTRY_BYTES = 160
#: A text is cut only if its joins are expected to be this share of it at most.
SPARED = 0.25
#: Chunks that are put together at once; strings that the library gets at once.
CHUNK_ROWS, ENCODE_ROWS = 1024, 64
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[0x20, 0x0A]] = True
#: Marks that no token of the pre-tokenizer holds after a letter.
STOPS = ",.;:!?"
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(STOPS.encode())] = True


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def chunks_hold(file: dict) -> bool:
    """Whether a tokenizer file keeps the rules that the sure boundaries rest on: byte-level words by the usual
    pattern, nothing normalised, no merging left to chance, no added token that holds or eats white space or holds one of STOPS."""
    words = file.get("pre_tokenizer") or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
    added = all(not any(c.isspace() or c in STOPS for c in t["content"]) and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in file.get("added_tokens") or [])
    model = file.get("model") or {}
    return plain and added and file.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not model.get("dropout")


class Codec:
    """A tokenizer file with chunk reuse; one a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.divisible = chunks_hold(json.load(f))
        self.library.no_truncation()
        self.library.no_padding()
        symbols = _byte_of_symbol()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in added else bytes(symbols[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.cache: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}
        self.words: dict[bytes, bytes] = {}
        self.older_words: dict[bytes, bytes] = {}
        self.held = self.held_words = 0
        self.encoded = self.reused = self.repaired = self.grown = 0

    def _encode(self, wanted: list[bytes]) -> None:
        """Puts the ids of what is not in the cache there."""
        for w in wanted:
            if w not in self.cache and w in self.older:
                self.cache[w] = self.older.pop(w)
        fresh = list(dict.fromkeys(w for w in wanted if w not in self.cache))
        self.reused += len(wanted) - len(fresh)
        self.encoded += len(fresh)
        for at in range(0, len(fresh), CHUNK_ROWS):
            part = fresh[at : at + CHUNK_ROWS]
            for key, ids in zip(part, self._by_words(part) if self.divisible else self._library(part), strict=True):
                self.cache[key] = ids
                self.held += len(key) + 4 * len(ids) + 200

    def _library(self, wanted: list[bytes]) -> Iterator[np.ndarray]:
        for at in range(0, len(wanted), ENCODE_ROWS):
            for made in self.library.encode_batch_fast([w.decode() for w in wanted[at : at + ENCODE_ROWS]], add_special_tokens=False):
                yield np.array(made.ids, dtype="<u4")

    def _by_words(self, wanted: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that are not empty, put together from those of their words."""
        if self.held_words > WORD_CACHE_BYTES // 2:  # as in the cache of chunks
            self.older_words, self.words, self.held_words = self.words, {}, 0
        raw = b"".join(wanted)
        data = np.frombuffer(raw, dtype=np.uint8)
        starts = np.cumsum([0, *[len(w) for w in wanted]])
        mark = np.zeros(len(raw) + 1, dtype=bool)
        mark[sure_places(data)] = mark[starts] = True
        places = np.flatnonzero(mark)
        codes = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode().indices.to_numpy()
        first = np.zeros(codes.max() + 1, dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        begins, ends = places[first], places[first + 1]
        words = [raw[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
        ids = list(map(self.words.get, words))
        missed = [k for k, i in enumerate(ids) if i is None]
        for k in missed:
            ids[k] = self.older_words.pop(words[k], None)
        fresh = np.array([k for k in missed if ids[k] is None], dtype=np.int64)
        joins = _BREAKS[data[begins[fresh]]] & visible(data)[ends[fresh] - 1]
        joined, alone = fresh[joins].tolist(), fresh[~joins].tolist()
        # words that begin at white space and end before it stay apart in one string
        groups = [joined[k : k + STRING_WORDS] for k in range(0, len(joined), STRING_WORDS)] + [[k] for k in alone]
        for group, made in zip(groups, self._library([b"".join([words[k] for k in g]) for g in groups]), strict=True):
            bounds = np.cumsum([len(words[k]) for k in group])
            stops = (4 * (np.searchsorted(np.cumsum(self.lengths[made]), bounds) + 1)).tolist()
            packed = made.tobytes()
            for k, i, j in zip(group, [0, *stops], stops, strict=False):
                ids[k] = packed[i:j]
        for k in missed:
            if len(words[k]) <= WORD_BYTES and self.held_words <= WORD_CACHE_BYTES:
                self.words[words[k]] = ids[k]
                self.held_words += len(words[k]) + len(ids[k]) + ENTRY_BYTES
        at = np.searchsorted(places, starts).tolist()
        spread = list(map(ids.__getitem__, codes.tolist()))
        return [np.frombuffer(b"".join(spread[i:j]), dtype="<u4") for i, j in zip(at, at[1:], strict=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of every text."""
        if self.held > CACHE_BYTES // 2:  # what isn't met again before the next turn is forgotten
            self.older, self.cache, self.held = self.cache, {}, 0
        cuts, sure = cut_places(data), sure_places(data)
        raw = data.tobytes()
        plans, wanted = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            inner = cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b, "left")].tolist()
            if inner and not self._divides(sure, a, b, len(inner)):
                inner = []
            edges = [a, *inner, b]
            safe = [a, *sure[np.searchsorted(sure, a, "right") : np.searchsorted(sure, b, "left")].tolist(), b]
            chunks = [raw[x:y] for x, y in zip(edges, edges[1:], strict=False)] if b > a else []
            spans = []
            for c in inner:
                lo, hi = safe[bisect_right(safe, c) - 1], safe[bisect_left(safe, c)]
                if spans and lo < spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                elif hi > lo:
                    spans.append((lo, hi))
                # a cut at a sure boundary needs no repair
            plans.append((a, b, edges, safe, chunks, spans))
            wanted += chunks
            wanted += [raw[x:y] for x, y in spans]
        self._encode(wanted)
        return [self._joined(raw, *plan) for plan in plans]

    def _divides(self, sure: np.ndarray, a: int, b: int, cuts: int) -> bool:
        """Whether chunks save work: joins reach from one sure boundary to the next, and are short where those are dense."""
        if not self.divisible:
            return False
        places = np.concatenate([[a], sure[np.searchsorted(sure, a, "right") : np.searchsorted(sure, b, "left")], [b]])
        gaps = np.diff(places).astype(np.float64)
        return cuts * float((gaps * gaps).sum()) / (b - a) <= SPARED * (b - a)

    def _joined(self, raw: bytes, a: int, b: int, edges: list[int], safe: list[int], chunks: list[bytes], spans: list[tuple[int, int]]) -> np.ndarray:
        if not chunks:
            return np.zeros(0, dtype=np.uint32)
        while True:
            parts, at, grown = [], a, None
            for lo, hi in [*spans, (b, b)]:
                kept = self._between(at, lo, edges, chunks)
                if kept is None:
                    grown = (at, lo)
                    break
                parts += kept
                if hi > lo:
                    parts.append(self.cache[raw[lo:hi]])
                at = hi
            if grown is None:
                self.repaired += len(spans)
                return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
            # No agreement at an end of this gap: the spans beside it grow by one sure boundary each.
            self.grown += 1
            spans = self._wider(spans, grown, safe, a, b)
            self._encode([raw[x:y] for x, y in spans])

    def _between(self, lo: int, hi: int, edges: list[int], chunks: list[bytes]) -> list[np.ndarray] | None:
        """The chunks' own tokens from byte lo to hi; None if either is inside a token."""
        out = []
        k = bisect_right(edges, lo) - 1
        while k < len(chunks) and edges[k] < hi:
            ids = self.cache[chunks[k]]
            ends = np.cumsum(self.lengths[ids])
            x, y = max(lo, edges[k]) - edges[k], min(hi, edges[k + 1]) - edges[k]
            i = int(np.searchsorted(ends, x)) + 1 if x else 0
            j = int(np.searchsorted(ends, y)) + 1
            if (x and ends[i - 1] != x) or ends[j - 1] != y:
                return None
            out.append(ids[i:j])
            k += 1
        return out

    @staticmethod
    def _wider(spans: list[tuple[int, int]], gap: tuple[int, int], safe: list[int], a: int, b: int) -> list[tuple[int, int]]:
        made: list[tuple[int, int]] = []
        for lo, hi in spans:
            if hi == gap[0] and hi < b:
                hi = safe[bisect_right(safe, hi)]
            if lo == gap[1] and lo > a:
                lo = safe[bisect_left(safe, lo) - 1]
            if made and lo <= made[-1][1]:
                made[-1] = (made[-1][0], max(hi, made[-1][1]))
            else:
                made.append((lo, hi))
        return made

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places at which a hash of the 16 bytes before is one in CHUNK_BYTES, never inside a character."""
    data = np.ascontiguousarray(data)
    at = [np.zeros(0, dtype=np.int64)]
    for start in range(0, len(data) - HASH_BYTES, BLOCK_BYTES):
        block = data[start : start + BLOCK_BYTES + HASH_BYTES - 1]
        words = np.ndarray((len(block) - 7,), dtype="<u8", buffer=block, strides=(1,))
        with np.errstate(over="ignore"):
            rolled = mix(words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:])
        at.append(np.flatnonzero(rolled % np.uint64(CHUNK_BYTES) == 0) + (start + HASH_BYTES))
    at = np.concatenate(at)
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def visible(data: np.ndarray) -> np.ndarray:
    """Whether a byte ends a character that is no white space, for sure (ASCII, or of two bytes from U+00C0 on)."""
    ends = (data > 0x20) & (data < 0x7F)
    ends[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    return ends


def sure_places(data: np.ndarray) -> np.ndarray:
    """Places of a space or line feed after a character that is no white space, and of STOPS after an ASCII letter."""
    after, letters = data[1:], ((data[:-1] | 0x20) - np.uint8(ord("a"))) < 26
    return np.flatnonzero(visible(data)[:-1] & ((after == 0x20) | (after == 0x0A)) | letters & _STOPS[after]) + 1


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec of a file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, after a real decoding of the ids."""
    path = path or default_vocabulary()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        ids = own.encode(*utf8(batch.column("text")))
        shas = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        texts = [hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(shas), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_pieces(chosen, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, and ``tokens`` (array of ints): what a training run reads. Columns that are not there are null."""
    path = path or default_vocabulary()
    have = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(path).encode(*utf8(batch.column("text")))
        bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
        counts = pa.array(np.diff(bounds).astype(np.int64))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "source", "lang")], counts, tokens], ["doc_id", "source", "lang", "n_tokens", "tokens"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *have, F.col("text").cast("string").alias("text"))
    return map_pieces(chosen, each, "doc_id long, source string, lang string, n_tokens long, tokens array<int>")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the texts that the ids stand for."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def back(ids):  # noqa: ANN001, ANN202
        own = codec(path)
        return ids.map(lambda i: own.decode(np.asarray(i if i is not None else [], dtype=np.uint32)))

    return tokens.select("doc_id", back("tokens").alias("text"))
