"""Language identification by a byte convolutional network.

Bytes are embedded, filters of widths 2, 3 and 4 run over fixed windows of 256 bytes, each filter's
maximum over the window is kept, and a softmax layer names the language. The network is trained in numpy
on windows of labelled texts: at most TRAIN_DOCS documents a language and TRAIN_WINDOWS windows a document,
chosen by hash over all labelled rows (the documented bound of the fit). Prediction covers every byte of
every text: its windows are scored in batches and their probabilities averaged by length.

For prediction, embedding and filters are folded into tables of byte pairs, so a position costs three
table rows instead of a product; the result is the same network.

Inputs: a null text or one without a letter is ``und`` with score 0; with no labelled text at all every row
is ``und``; rows with a null doc_id are predicted like all others and are never used for training; rows equal
in language, doc_id and text are trained on once, rows that only share a doc_id are rows of their own; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import bounded_batches, map_pieces, pieces, saved, shared_folder, small, utf8

WINDOW, PAD = 256, 0
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 12, 8
TRAIN_DOCS, TRAIN_WINDOWS = 500, 4
#: The hash bound lets so many times TRAIN_DOCS through.
SPARE = 1.3
EPOCHS, RATE, DECAY = 8, 0.004, 1e-5
#: Windows that are scored at once; their partial sums stay in a core's cache.
CHUNK = 64
UNKNOWN = "und"
#: Score from which on a filter accepts a text.
LEAST_SCORE = 0.3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


@dataclass
class Network:
    """Parameters; ``kernels[w]`` is (width, DEPTH, FILTERS)."""

    languages: list[str]
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by pair (first two bytes of all widths), by third byte of width 3, by last pair of width 4."""
        part = lambda w, k: self.embedding @ self.kernels[w][k]  # noqa: E731  (256, FILTERS)
        pair = lambda w, k: (part(w, k)[:, None, :] + part(w, k + 1)[None, :, :]).reshape(65536, FILTERS)
        first = np.concatenate([pair(0, 0) + self.biases[0], pair(1, 0) + self.biases[1], pair(2, 0) + self.biases[2]], axis=1)
        return tuple(np.ascontiguousarray(t, dtype=np.float32) for t in (first, part(1, 2), pair(2, 2)))

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Softmax output of (n, WINDOW) byte windows."""
        first, third, last = tables
        out = np.empty((len(windows), len(self.languages)))
        for at in range(0, len(windows), CHUNK):
            x = windows[at : at + CHUNK].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            sums = first.take(pairs, axis=0)
            sums[:, :-1, FILTERS : 2 * FILTERS] += third.take(x[:, 2:], axis=0)
            sums[:, :-2, 2 * FILTERS :] += last.take(pairs[:, 2:], axis=0)
            sums[:, -1, FILTERS:] = -np.inf  # positions at which a wider filter would leave the window
            sums[:, -2, 2 * FILTERS :] = -np.inf
            z = np.maximum(sums.max(axis=1), 0) @ self.weights + self.offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + CHUNK] = z / z.sum(axis=1, keepdims=True)
        return out


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, padded; the text of each, and how many of its bytes are text."""
    lengths = np.diff(offsets)
    n = -(-lengths // WINDOW)
    first = np.concatenate([[0], np.cumsum(n)])
    flat = np.full(int(first[-1]) * WINDOW, PAD, dtype=np.uint8)
    folded = _FOLD[data]
    for at, a, b in zip((first[:-1] * WINDOW).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[at : at + b - a] = folded[a:b]
    owner = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(len(owner)) - first[owner]
    used = np.minimum(WINDOW, lengths[owner] - within * WINDOW)
    windows = flat.reshape(-1, WINDOW)
    return windows, owner, used


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross entropy; gradients by hand: the maximum passes them to one position a filter."""
    rng = np.random.default_rng(seed)
    scaled = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    net = Network(languages, scaled(256, DEPTH), [scaled(w, DEPTH, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], scaled(FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32))
    params = [net.embedding, *net.kernels, *net.biases, net.weights, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            grads = _gradients(net, windows[chosen], labels[chosen])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g = g + DECAY * p
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    n = len(x)
    e = net.embedding[x]
    pooled, where = [], []
    for kernel, bias, w in zip(net.kernels, net.biases, WIDTHS, strict=True):
        p = x.shape[1] - w + 1
        a = sum(e[:, k : k + p] @ kernel[k] for k in range(w)) + bias
        where.append(a.argmax(axis=1))
        pooled.append(np.take_along_axis(a, where[-1][:, None, :], axis=1)[:, 0])
    h = np.concatenate(pooled, axis=1)
    active = np.maximum(h, 0)
    z = active @ net.weights + net.offset
    z = np.exp(z - z.max(axis=1, keepdims=True))
    d = z / z.sum(axis=1, keepdims=True)
    d[np.arange(n), labels] -= 1
    d = (d / n).astype(np.float32)
    dh = (d @ net.weights.T) * (h > 0)
    de = np.zeros_like(net.embedding)
    dk, db = [], []
    rows = np.arange(n)[:, None]
    for i, (kernel, w) in enumerate(zip(net.kernels, WIDTHS, strict=True)):
        g = dh[:, i * FILTERS : (i + 1) * FILTERS]
        out = np.empty_like(kernel)
        for k in range(w):
            bytes_ = x[rows, where[i] + k]
            out[k] = np.einsum("nfd,nf->df", net.embedding[bytes_], g)
            np.add.at(de, bytes_.ravel(), (g[:, :, None] * kernel[k].T[None]).reshape(-1, DEPTH))
        dk.append(out)
        db.append(g.sum(axis=0))
    return [de, *dk, *db, active.T @ d, d.sum(axis=0)]


def held_out(doc_id: Column) -> Column:
    """Rows never used for training: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Network | None:
    """A network from the labelled rows that are not held out; None if there are none."""
    order = F.xxhash64("doc_id", "text")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("order", order)
    # Rows under a hash bound that leaves somewhat more than TRAIN_DOCS distinct ones a language; the driver takes the first of them.
    counts = saved(labelled.groupBy("lang").agg(F.approx_count_distinct("order", 0.05).alias("n")), shared_folder(docs.sparkSession), "languages")
    bound = F.least(F.lit(1.0), F.lit(SPARE * TRAIN_DOCS) / F.col("n"))
    under = labelled.join(small(counts, 64, "lang"), "lang").where(F.pmod("order", F.lit(1 << 32)) < bound * (1 << 32))
    sample = under.groupBy("lang", "doc_id", "order").agg(F.min("text").alias("text"))

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made, owner, used = cut_windows(*utf8(batch.column("text")))
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        per = np.bincount(owner, minlength=batch.num_rows)[owner] if len(owner) else owner
        step = np.maximum(1, per // TRAIN_WINDOWS)
        keep = (rank % step == 0) & (rank // step < TRAIN_WINDOWS) & (used >= 8)
        columns = [batch.column(c).take(pa.array(owner[keep])) for c in ("lang", "order", "doc_id")]
        return pa.RecordBatch.from_arrays([*columns, pa.array([w.tobytes() for w in made[keep]], pa.binary())], ["lang", "order", "doc_id", "win"])

    rows = sorted((r["lang"], r["order"] % (1 << 32), r["doc_id"], bytes(r["win"])) for r in map_pieces(sample, windows, "lang string, order long, doc_id long, win binary").collect())
    if not rows:
        return None
    taken: dict[str, dict] = {}
    chosen = [r for r in rows if len(taken.setdefault(r[0], {})) < TRAIN_DOCS or r[1:3] in taken[r[0]] if taken[r[0]].setdefault(r[1:3], True)]
    chosen = sorted((r[0], r[2], r[3]) for r in chosen)
    languages = sorted(taken)
    x = np.frombuffer(b"".join(r[2] for r in chosen), dtype=np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([languages.index(r[0]) for r in chosen]), languages)


def _predictions(net: Network | None, tables: tuple | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language (-1: none) and score of each text."""
    n = len(texts)
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], dtype=bool)
    if net is None or not lettered.any():
        return np.full(n, -1), np.zeros(n)
    windows, owner, used = cut_windows(*utf8(texts))
    total = np.zeros((n, len(net.languages)))
    np.add.at(total, owner, net.probabilities(windows, tables) * used[:, None])
    mean = total / np.maximum(1, np.bincount(owner, weights=used, minlength=n))[:, None]
    return np.where(lettered, mean.argmax(axis=1), -1), np.where(lettered, np.clip(mean.max(axis=1), 0, 1), 0.0)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score, and the text's other columns left out; one row a document."""
    tables: list = []
    names = np.array([*(net.languages if net else []), UNKNOWN], dtype=object)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if net is not None and not tables:
            tables.append(net.tables())
        label, score = _predictions(net, tables[0] if tables else None, batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[label], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_pieces(chosen, each, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, all their columns kept, whose text has a language: not ``und``, and a score of ``least`` or more.

    Without any labelled text there is no network, and every row stays.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = fit(typed)
    if net is None:  # nothing was learnt that could speak against a text
        return docs
    bounded_batches(docs.sparkSession)
    tables: list = []

    def verdict(texts: pa.Array) -> pa.Array:
        if not tables:
            tables.append(net.tables())
        parts = [_predictions(net, tables[0], piece.column(0)) for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"]))]
        return pa.array(np.concatenate([(label >= 0) & (score >= least) for label, score in parts]) if parts else [], pa.bool_())

    return docs.where(F.arrow_udf(verdict, "boolean")(F.col("text").cast("string")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict(typed, fit(typed))
