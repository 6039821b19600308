"""Licence scan: a trained paragraph classifier, then template comparison.

A paragraph is a line; lines that follow each other without an empty one are also read as one, so that a
statement may be wrapped. Its words give hashed 1-, 2- and 3-grams; a multinomial logistic regression names a
licence family or ``unknown``. It is trained in numpy on licence sentences (names in common phrasings, SPDX
lines, lines of the standard notices), on sentences that only sound like licences, on licences of no family
here, and on paragraphs of the corpus: the SAMPLE_PARAGRAPHS least by hash among the lines of about SAMPLE_DOCS
documents, of each its first SAMPLE_CHARS characters (the documented bound of the fit). A temperature is
fitted on phrasings, foreign licences and paragraphs that were not trained on, so that probabilities are
calibrated, and the family threshold is raised there until no held-out unknown paragraph passes. A prediction
counts when a template of its family agrees: shared word 3-grams over the smaller of the two sets reach AGREE.

Paragraphs longer than UNIT words are scored in overlapping units; every run of words known from the
templates, and an SPDX tag with its first word, is a unit of its own. A paragraph has every family that passes
in any unit, except where all its evidence is part of a more probable statement of another family; names that
follow a statement closely ("or the MIT License") pass on their own. A wrapped statement counts at the line
where it begins. Every paragraph of every text is scored. Inputs: a null or empty text has no licence; very
long lines are cut into units, not shortened; repeated rows and null doc_ids are treated like any other;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import map_pieces, mix, utf8
from rasterweave.llm.lines import line_spans
from rasterweave.llm.words import span_hashes, word_spans

SLOTS, ORDERS = 1 << 14, 3
UNIT, STEP = 64, 32
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 300, 1200, 600
AGREE, LEAST_GRAMS = 0.5, 2
#: Words that may stand between a statement and a further name ("or, at your option, the").
LISTED = 5
UNKNOWN = "unknown"

#: Names under which a family is cited.
NAMES = {
    "agpl": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "Affero General Public License"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 License"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "New BSD License", "BSD-3-Clause license", "modified BSD license"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution License"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "cc0": ("CC0 1.0 Universal", "CC0 1.0 Public Domain Dedication", "Creative Commons Zero", "CC0-1.0"),
    "epl": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "EPL-2.0"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0", "GPLv2", "GNU General Public License"),
    "isc": ("ISC License", "ISC licence"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "LGPL-3.0", "LGPLv2.1"),
    "mit": ("MIT License", "MIT license", "Expat License", "MIT/X11 license"),
    "mpl": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "gfdl": ("GNU Free Documentation License", "GNU Free Documentation License, Version 1.3", "GFDL-1.3"),
    "ms-pl": ("Microsoft Public License", "MS-PL", "Microsoft Public License (Ms-PL)"),
    "boost": ("Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"),
    "zlib": ("zlib License", "zlib/libpng License"),
    "artistic": ("Artistic License 2.0", "Perl Artistic License", "Artistic-2.0"),
}
#: Identifiers that stand behind an SPDX tag.
SPDX = {
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"), "apache": ("Apache-2.0", "Apache-1.1"), "bsd": ("BSD-3-Clause", "BSD-2-Clause", "0BSD"),
    "cc-by": ("CC-BY-4.0", "CC-BY-3.0"), "cc-by-nc": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"), "cc-by-sa": ("CC-BY-SA-4.0", "CC-BY-SA-3.0"), "cc0": ("CC0-1.0",), "epl": ("EPL-2.0", "EPL-1.0"),
    "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "GPL-2.0+"), "isc": ("ISC",), "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT", "MIT-0"), "mpl": ("MPL-2.0", "MPL-1.1"), "unlicense": ("Unlicense",), "gfdl": ("GFDL-1.3-or-later",), "ms-pl": ("MS-PL",), "boost": ("BSL-1.0",), "zlib": ("Zlib",), "artistic": ("Artistic-2.0",),
}
TAG = "SPDX-License-Identifier:"
#: Licences of none of the families: the first half is trained on as unknown, the second half held out.
FOREIGN = ("Open Software License 3.0", "Python Software Foundation License", "Sleepycat License", "Academic Free License v3.0", "European Union Public Licence", "the Apache Software Foundation terms", "the house licence of the MIT Press", "Open Government Licence", "Nokia Open Source License", "Common Development and Distribution License", "SIL Open Font License 1.1", "Server Side Public License", "Business Source License 1.1", "Elastic License 2.0", "PostgreSQL License", "Universal Permissive License", "IBM Public License", "Vim License", "a commercial licence of the vendor", "Open Data Commons Database License")
#: Lines of the families' standard notices.
NOTICES = {
    "apache": ("you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "See the License for the specific language governing permissions and limitations under the License"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}
LEADS = ("Licensed under", "Released under", "This work is licensed under", "Distributed under", "Published under", "Available under", "This software is released under the terms of", "This project is licensed under", "Use of this code is governed by", "Licence:", "License:")
#: Phrasings that are never trained on: calibration and tests use them.
HELD_LEADS = ("Made available under", "The source is covered by", "Shared under", "You may copy this work under", "Code license:", "Legal terms:")
TAILS = ("", ".", "", ".", " (the \"License\").", "; see LICENSE for details.", ", all other rights reserved.", " by its authors.")
#: Sentences that only sound like licences.
LOOKALIKES = ("She renewed her driving licence under the new rules.", "The apache helicopter was released in version 2.0 of the game.", "MIT students published the paper under the supervision of their professor.", "The general public was free to use the library.", "The eclipse was available to the public.", "This work is done under pressure.", "The doctor was licensed to practise in two states.", "Released in 2004, the album sold well.", "A fishing license is required under state law.", "Mozilla published a statement to the public.", "The software is provided by the vendor as is usual.", "Creative commons rooms are available to all students.", "Terms of the agreement were not released.", "Use of this room is governed by the house rules.", "Under the bridge the work is distributed by hand.", "The license plate was issued in version two.")


def _rest(n: int, rng: random.Random) -> list[str]:
    parts = ("the", "of", "and", "work", "under", "terms", "use", "on", "in", "is", "rights", "file", "see", "for", "code", "free", "public", "with", "notice", "copy")
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(2, 14))) for _ in range(n)]


def examples(seed: int, rounds: int, held: bool = False) -> tuple[list[str], list[str]]:
    """Made sentences and their families; ``held``: in phrasings, and with foreign licences, that are never trained on."""
    rng = random.Random(seed)
    leads, half = HELD_LEADS if held else LEADS, len(FOREIGN) // 2
    texts, labels = [], []

    def add(text: str, label: str) -> None:
        texts.append(text)
        labels.append(label)

    def sentence(name: str) -> str:
        lead = rng.choice(leads)
        article = "the " if not lead.endswith(":") and name[0] not in "Cat" and rng.random() < 0.8 else ""
        return f"{lead} {article}{name}{rng.choice(TAILS)}"

    for _ in range(rounds):
        for family, names in NAMES.items():
            for name in names:
                add(sentence(name), family)
        for family, names in SPDX.items():
            for name in names:
                add(f"{rng.choice(('//', '#', '*', ''))} {TAG} {name}", family)
        for family, lines in NOTICES.items():
            for line in lines:
                add(line + rng.choice(("", ".", ":", ",")), family)
        for name in FOREIGN[half:] if held else FOREIGN[:half]:
            add(sentence(name), UNKNOWN)
            add(sentence(name), UNKNOWN)
        for line in [*LOOKALIKES, *_rest(20, rng)]:
            add(line, UNKNOWN)
    return texts, labels


def _slots(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, ORDERS): the slot of the n-gram that begins at each word, -1 where it would leave its paragraph."""
    n = len(hashes)
    last = np.repeat(bounds[1:], np.diff(bounds))
    out = np.full((n, ORDERS), -1, dtype=np.int32)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDERS):
            at = np.arange(n) + k
            ok = at < last
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(at, n - 1)]) if n else total
            out[ok, k] = (total[ok] % np.uint64(SLOTS)).astype(np.int32)
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and paragraph bounds among them; punctuation at a word's ends is left out of its hash."""
    starts, ends, bounds = word_spans(data, offsets)
    if len(starts):
        edge = np.zeros(256, dtype=bool)
        edge[[ord(c) for c in ".,;:!?()[]\"'/*#<>-"]] = True
        inner = np.concatenate([[0], np.cumsum(~edge[data])])
        kept = inner[ends] > inner[starts]  # comment marks are no words
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        starts, ends = starts[kept], ends[kept]
        for _ in range(3):
            ends = ends - (edge[data[ends - 1]] & (ends - starts > 1))
            starts = starts + (edge[data[starts]] & (ends - starts > 1))
    return span_hashes(data, starts, ends), bounds


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, bounds of the lines among them, the text of each line, and bounds of lines that stand together."""
    _, _, owner, number = line_spans(data, offsets)
    breaks = np.flatnonzero(data == 0x0A) + 1
    begin = np.empty(len(owner), dtype=np.int64)
    begin[number == 0], begin[number > 0] = offsets[:-1], breaks
    hashes, bounds = _words(data, np.append(begin, len(data)))
    alone = np.concatenate([[True], (number[1:] == 0) | (np.diff(bounds)[:-1] == 0)]) if len(number) else np.zeros(0, dtype=bool)
    return hashes, bounds, owner, np.append(bounds[:-1][alone], bounds[-1])


@dataclass
class Classifier:
    families: list[str]
    weights: np.ndarray
    offset: np.ndarray
    temperature: float
    threshold: float
    templates: dict[str, list[np.ndarray]]
    names: dict[bytes, str]

    def __post_init__(self) -> None:
        self.own = {f: np.unique(np.concatenate(t)) for f, t in self.templates.items()}
        self.grams = np.unique(np.concatenate(list(self.own.values())))
        self.tag = _hashed([TAG])[0][0]
        self.sizes = sorted({len(n) // 8 for n in self.names}, reverse=True)

    def scores(self, slots: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the units ``starts`` to ``ends`` (words)."""
        padded = np.vstack([self.weights, np.zeros(len(self.families), np.float32)])
        per_word = padded[slots].sum(axis=1, dtype=np.float64)
        running = np.vstack([np.zeros(len(self.families)), np.cumsum(per_word, axis=0)])
        grams = np.concatenate([[0], np.cumsum((slots >= 0).sum(axis=1))])
        z = (running[ends] - running[starts]) / np.sqrt(np.maximum(1, grams[ends] - grams[starts]))[:, None] + self.offset
        z = np.exp((z - z.max(axis=1, keepdims=True)) / self.temperature)
        return z / z.sum(axis=1, keepdims=True)

    def agreement(self, grams: np.ndarray, family: str) -> float:
        best = 0.0
        for t in self.templates[family]:
            least = min(len(grams), len(t))
            if least >= LEAST_GRAMS:
                best = max(best, len(np.intersect1d(grams, t, assume_unique=True)) / least)
            elif least and len(t) == len(grams):
                best = max(best, float(np.array_equal(grams, t)))
        return best

    def paragraphs(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, str, float]]:
        """(paragraph, family, probability) of the families that a unit names and a template agrees with."""
        return [(k, family, value) for k, family, value, _ in self.found(hashes, bounds)]

    def found(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, str, float, int]]:
        """The same with the word at which a family's evidence begins."""
        slots = _slots(hashes, bounds)
        lengths = np.diff(bounds)
        n = np.where(lengths > 0, np.maximum(1, -(-(lengths - UNIT) // STEP) + 1), 0)
        owner = np.repeat(np.arange(len(lengths)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = bounds[:-1][owner] + within * STEP
        ends = np.minimum(starts + UNIT, bounds[1:][owner])
        more, to = self.statements(hashes, bounds)
        starts, ends = np.append(starts, more), np.append(ends, to)
        owner = np.append(owner, np.searchsorted(bounds, more, "right") - 1)
        if not len(starts):
            return []
        p = self.scores(slots, starts, ends)
        p[:, self.families.index(UNKNOWN)] = 0
        hits = []
        for u in np.flatnonzero(p.max(axis=1) >= self.threshold).tolist():
            for k in np.flatnonzero(p[u] >= self.threshold).tolist():
                family = self.families[k]
                if self.agreement(gram_set(hashes[starts[u] : ends[u]]), family) >= AGREE:
                    hits.append((-float(p[u, k]), int(starts[u]), int(ends[u]), family, int(owner[u])))
        found: dict[tuple[int, str], tuple[float, int]] = {}
        claimed: dict[int, str] = {}
        for value, start, end, family, k in sorted(hits):
            words = self.evidence(hashes, start, end, family)
            if all(claimed.get(w, family) != family for w in words):  # a part of another family's statement
                continue
            for w in words:
                claimed.setdefault(w, family)
            found.setdefault((k, family), (-value, min(words)))
            for name, at, to in self.listed(hashes, max(words) + 1, int(bounds[k + 1])):
                score = float(self.scores(slots[at:to], np.array([0]), np.array([to - at]))[0, self.families.index(name)])
                if score >= self.threshold:
                    found.setdefault((k, name), (score, at))
        return [(k, f, *v) for (k, f), v in sorted(found.items())]

    def statements(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of words whose 3-grams stand in any template, and of SPDX tags with a word."""
        last = np.repeat(bounds[1:], np.diff(bounds))
        tags = np.flatnonzero(hashes == self.tag)
        tags = tags[tags + 2 <= last[tags]]
        if len(hashes) < 3:
            return tags, tags + 2
        known = np.concatenate([[False], np.isin(grams_at(hashes), self.grams) & (np.arange(2, len(hashes)) < last[:-2]), [False]])
        change = np.diff(known.astype(np.int8))
        return np.append(np.flatnonzero(change == 1), tags), np.append(np.flatnonzero(change == -1) + 2, tags + 2)

    def evidence(self, hashes: np.ndarray, start: int, end: int, family: str) -> list[int]:
        """Places of the words whose 3-grams stand in a template of the family; all words if there are none."""
        if end - start >= 3:
            at = np.flatnonzero(np.isin(grams_at(hashes[start:end]), self.own[family])) + start
            if len(at):
                return sorted({w for i in at.tolist() for w in (i, i + 1, i + 2)})
        return list(range(start, end))

    def listed(self, hashes: np.ndarray, at: int, end: int) -> list[tuple[str, int, int]]:
        """Family, start and end of the names that go on with a statement: each within LISTED words of the last."""
        out = []
        while True:
            more = [(at + gap, at + gap + n) for gap in range(LISTED + 1) for n in self.sizes if at + gap + n <= end and hashes[at + gap : at + gap + n].tobytes() in self.names]
            if not more:
                return out
            a, e = more[0]
            out.append((self.names[hashes[a:e].tobytes()], a, e))
            at = e


def grams_at(hashes: np.ndarray) -> np.ndarray:
    """The 3-gram that begins at each word but the last two."""
    with np.errstate(over="ignore"):
        return mix(hashes[:-2] * np.uint64(3) + mix(hashes[1:-1]) * np.uint64(5) + mix(mix(hashes[2:])))


def gram_set(hashes: np.ndarray) -> np.ndarray:
    """The set of word 3-grams; of fewer words, their whole sequence."""
    if len(hashes) < 3:
        return np.unique(mix(np.cumsum(hashes, dtype=np.uint64)[-1:])) if len(hashes) else hashes
    return np.unique(grams_at(hashes))


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _words(*utf8(pa.array(texts, pa.string())))


def _design(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised counts by slot (dense; a few thousand rows) of texts cut to their first unit."""
    hashes, bounds = _hashed(texts)
    slots = _slots(hashes, bounds)
    x = np.zeros((len(texts), SLOTS), dtype=np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own = slots[a : min(b, a + UNIT)].ravel()
        own = own[own >= 0]
        np.add.at(x[i], own, 1 / np.sqrt(max(1, len(own))))
    return x, np.flatnonzero(x.any(axis=0))


def fit(corpus: list[str]) -> Classifier:
    """From made sentences and unlabelled paragraphs (those that speak of licences are left out)."""
    plain = [t for t in corpus if "licen" not in t.lower()]
    families = [*sorted(NAMES), UNKNOWN]
    texts, labels = examples(1, 8)
    cut = len(plain) * 2 // 3
    texts, labels = texts + plain[:cut], labels + [UNKNOWN] * cut
    x, used = _design(texts)
    x = x[:, used]
    y = np.array([families.index(k) for k in labels])
    w, b = np.zeros((len(used), len(families)), np.float32), np.zeros(len(families), np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(150):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        mw = 0.9 * mw + x.T @ p + 1e-5 * w
        mb = 0.9 * mb + p.sum(axis=0)
        w, b = w - 6.0 * mw, b - 6.0 * mb
    full = np.zeros((SLOTS, len(families)), np.float32)
    full[used] = w
    held, answers = examples(2, 4, held=True)
    held, answers = held + plain[cut:], answers + [UNKNOWN] * (len(plain) - cut)
    hx, _ = _design(held)
    z, hy = hx @ full + b, np.array([families.index(k) for k in answers])
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: _loss(z / t, hy))
    p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    p /= p.sum(axis=1, keepdims=True)
    wrong = p[hy == len(families) - 1, :-1].max(axis=1, initial=0.0)
    threshold = float(min(0.95, max(0.5, wrong.max(initial=0.0) + 1e-6)))
    templates: dict[str, list[np.ndarray]] = {f: [] for f in NAMES}
    sentences = [(f, f"{lead} {article}{name}") for f, names in NAMES.items() for name in names for lead in LEADS for article in ("", "the ")]
    sentences += [(f, f"{TAG} {name}") for f, names in SPDX.items() for name in names]
    sentences += [(f, line) for f, lines in NOTICES.items() for line in lines] + [(f, name) for f, names in NAMES.items() for name in names]
    hashes, bounds = _hashed([s for _, s in sentences])
    for (f, _), a, e in zip(sentences, bounds[:-1], bounds[1:], strict=True):
        templates[f].append(gram_set(hashes[a:e]))
    cited = [(f, name) for table in (SPDX, NAMES) for f, names in table.items() for name in names]
    hashes, bounds = _hashed([name for _, name in cited])
    names = {hashes[a:e].tobytes(): f for (f, _), a, e in zip(cited, bounds[:-1], bounds[1:], strict=True)}
    return Classifier(families, full, b, temperature, threshold, templates, names)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    top = z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] - z[np.arange(len(y)), y]).mean())


def sample_paragraphs(docs: DataFrame) -> list[str]:
    """The SAMPLE_PARAGRAPHS lines with the least hashes among those of about SAMPLE_DOCS documents, chosen by hash; beginnings of SAMPLE_CHARS."""
    n = docs.count()
    if not n:
        return []
    picked = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < SAMPLE_DOCS)).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = picked.where(F.length(F.trim("line")) > 0).select(F.xxhash64("doc_id", "line").alias("h"), F.substring("line", 1, SAMPLE_CHARS).alias("line"))
    return [r["line"] for r in lines.orderBy("h", "line").limit(SAMPLE_PARAGRAPHS).collect()]


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licenses, families (sorted, joined by commas), hits (``line:family``, joined)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = classifier or fit(sample_paragraphs(texts))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("text"))
        hashes, bounds, owner, blocks = _paragraphs(data, offsets)
        first = np.searchsorted(owner, np.arange(batch.num_rows))
        count = np.bincount(owner, minlength=batch.num_rows)
        empty = np.diff(offsets) == 0
        hits: list[list[tuple[int, str]]] = [[] for _ in range(batch.num_rows)]
        found = {(k, family) for k, family, _ in model.paragraphs(hashes, bounds)}
        inside = {(int(np.searchsorted(blocks, bounds[k], "right")), family) for k, family in found}
        for k, family, _, word in model.found(hashes, blocks):
            if (int(np.searchsorted(blocks, blocks[k], "right")), family) not in inside:  # wrapped: no single line has it
                found.add((int(np.searchsorted(bounds, word, "right")) - 1, family))
        for k, family in sorted(found):
            hits[owner[k]].append((int(k - first[owner[k]]), family))
        columns = [np.where(empty, 0, count), [len(h) for h in hits], [",".join(sorted({f for _, f in h})) for h in hits], [",".join(f"{k}:{f}" for k, f in h) for h in hits]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_paragraphs", "n_licenses", "families", "hits"])

    return map_pieces(texts, each, "doc_id long, n_paragraphs long, n_licenses long, families string, hits string")
