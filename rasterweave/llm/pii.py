"""Personal data: rules that always hold, and candidates chosen by boosted trees.

Base spans follow fixed patterns (email, ip, card with its check digit, phone). High-recall generators
propose more, overlapping spans: long numbers (groups and joins of neighbouring groups, beside base spans), obfuscated addresses, assigned secrets, bank accounts,
colon-separated hex. Each candidate is described by its format and its context (words and characters
around it); boosted trees, trained here on made-up texts with known answers, give a probability that is
calibrated on texts not trained on, and a threshold for each kind is set there for the wanted precision.
Accepted candidates that do not touch a base span are added, best first.

The thresholds hold for made-up texts of the generators' kind; measured figures on other texts stand in the README.

Offsets are code points, ends exclusive. Inputs: a null or empty text has no span; very long texts are
scanned in linear time; rows that repeat or have a null doc_id are treated like any other; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.boosting import Boosted
from rasterweave.llm.common import map_pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "id", "secret")
PRECISION, TRAIN_TEXTS = 0.97, 6000
CONTEXT = 24

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9](?:.*[0-9])?", re.DOTALL)

# Generators: kind and pattern; the group, if there is one, is the span.
_RUN = re.compile(r"[0-9(](?:[ ./()-]{0,2}[0-9])+")
_GROUP = re.compile(r"[^ /]+")
LEAST_DIGITS, MOST_DIGITS = 7, 25
_ASSIGNED = re.compile(r"[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,})")
_SPOKEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]?\b(?:at|AT)\b[\])]?\s?[A-Za-z0-9-]{1,63}\s?[\[(]?\b(?:dot|DOT)\b[\])]?\s?[A-Za-z]{2,24}\b")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

#: Words that speak for a kind when they stand before a span.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "card": ("card", "visa", "credit", "debit", "account", "cc"),
    "id": ("ssn", "passport", "social", "tax", "licence", "license", "national"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth"),
    "email": ("mail", "contact", "write", "reach"),
    "iban": ("iban", "bank", "transfer", "account"),
    "ip": ("ip", "ipv", "address", "host", "addr", "client", "from", "peer"),
    "plain": ("version", "isbn", "order", "page", "pages", "figure", "sha", "commit", "ratio", "build", "time", "serial", "part", "model"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the fixed patterns: leftmost, not overlapping within a kind, failures dropped."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text) is None:
        return found
    if "." in text:
        for m in _DOTTED.finditer(text):
            if m.group().count(".") >= 3:
                found += [(m.start() + a, m.start() + b, "ip") for a, b in _quads(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _quads(run: str) -> list[tuple[int, int]]:
    """Four numbers in a row joined by single dots; those with a part over 255 are passed over whole."""
    out, at, parts = [], 0, []
    for part in run.split("."):
        parts = [*parts, (at, at + len(part))] if part else []
        if len(parts) == 4:
            numbers = [run[a:b].lstrip("0") for a, b in parts]
            if all(len(n) <= 3 and int(n or "0") <= 255 for n in numbers):
                out.append((parts[0][0], parts[3][1]))
            parts = []
        at += len(part) + 1
    return out


def _alphanumeric(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _numbers(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Groups between spaces and slashes and joins of neighbouring groups, of LEAST_DIGITS to MOST_DIGITS digits."""
    groups = []
    for m in _GROUP.finditer(text, start, end):
        inside = _DIGITS.search(m.group())
        if inside is None:
            continue
        a, b = m.start() + inside.start(), m.start() + inside.end()
        a -= text[a - 1] == "(" and a > m.start()
        first = not (a and _alphanumeric(text[a - 1]))
        last = not (b < len(text) and _alphanumeric(text[b]))
        groups.append((a, b, sum(map(str.isdigit, text[a:b])), first, last))
    out = []
    for i, (a, _, _, first, _) in enumerate(groups):
        digits = 0
        for _, b, n, _, last in groups[i : i + MOST_DIGITS] if first else ():
            digits += n
            if digits > MOST_DIGITS:
                break
            if last and digits >= LEAST_DIGITS:
                out.append((a, b, "card" if digits >= 13 else "phone" if digits >= 10 else "id"))
    return out


def candidates(text: str, base: list[tuple[int, int, str]] | tuple = ()) -> list[tuple[int, int, str]]:
    """What the generators propose; spans may overlap. Of runs of numbers, what is left beside the base spans."""
    found = []
    if _DIGIT.search(text) is not None:
        cuts, k = sorted((a, b) for a, b, _ in base), 0
        for m in _RUN.finditer(text):
            at = m.start()
            while k < len(cuts) and cuts[k][1] <= at:
                k += 1
            j = k
            while j < len(cuts) and cuts[j][0] < m.end():
                found += _numbers(text, at, max(at, cuts[j][0]))
                at = max(at, cuts[j][1])
                j += 1
            found += _numbers(text, at, max(at, m.end()))
        found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret") for m in _ASSIGNED.finditer(text)]
        found += [(m.start(), m.end(), "ip") for m in _COLONS.finditer(text)]
    if "dot" in text or "DOT" in text:
        found += [(m.start(), m.end(), "email") for m in _SPOKEN.finditer(text)]
    return found


def describe(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a span as numbers."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    letters = sum(c.isalpha() for c in span)
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    words = re.findall(r"[a-z_]+", before)
    n = len(span)
    groups = re.findall(r"[0-9]+", span)
    counts = np.array([span.count(c) for c in set(span)], dtype=float)
    entropy = float(-(counts / n * np.log2(counts / n)).sum()) if n else 0.0
    row = [float(KINDS.index(kind)), n, len(digits), letters, len(digits) / max(1, n), letters / max(1, n), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), entropy]
    row += [float(luhn(digits)) if digits else -1.0, float(all(c in string.hexdigits for c in span)), float("(" in span), span.count("-"), span.count("."), span.count(" "), span.count("/"), span.count(":")]
    row += [float(digits[:1] == "0"), float(digits[:1] in ("4", "5", "3")), float(any(c.isupper() for c in span)), float(any(c.islower() for c in span))]
    row += [float(bool(set(words) & set(cues))) for cues in CUES.values()]
    row += [float(before[-1:] in ("", " ", "\n")), float(before[-1:] in ('"', "'")), float(before[-1:] in "#/_.,-" and bool(before)), float(after[:1] in ("", " ", "\n", ".", ",")), float(after[:1] in ('"', "'")), float(bool(re.search(r"[0-9]", after[:6]))), float(bool(re.search(r"[0-9]", before[-6:])))]
    row += [float(kind == k) for k in KINDS]
    return row


@dataclass
class Model:
    trees: Boosted
    thresholds: dict[str, float]

    def added(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        proposed = candidates(text, base)
        if not proposed:
            return []
        probability = self.trees.probability(np.array([describe(text, *c) for c in proposed]))
        taken, out = [(a, b) for a, b, _ in base], []
        for k in sorted(range(len(proposed)), key=lambda k: (-probability[k], proposed[k])):
            a, b, kind = proposed[k]
            if probability[k] >= self.thresholds[kind] and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append(proposed[k])
        return out


# --- made-up texts with known answers ---------------------------------------------------------


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(string.digits) for _ in range(n))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("th", "er", "an", "in", "on", "re", "ti", "es", "la", "un", "de", "sch", "ou", "ei")) for _ in range(rng.randint(1, 4)))


def _private(rng: random.Random) -> tuple[str, str, str]:
    """A private value, the words that may stand before it, and what follows."""
    kind = rng.choice(("card", "card", "phone", "id", "secret", "secret", "email", "iban", "ip"))
    if kind == "ip":
        zeros = rng.random() < 0.5
        parts = [rng.choice((f"{rng.randint(0, 65535):04x}" if zeros else f"{rng.randint(0, 65535):x}", "0" if not zeros else "0000")) if k > 1 else f"{rng.randint(4096, 65535):x}" for k in range(8)]
        return ":".join(parts), rng.choice((f"{rng.choice(CUES['ip'])} ", f"{_word(rng)} ")), " "
    cue = rng.choice(CUES[kind]) if rng.random() < 0.5 else _word(rng)
    if kind == "card":
        raw = rng.choice("0123456789") + _digits(rng, 15)
        return (" ".join(raw[k : k + 4] for k in range(0, 16, 4)) if rng.random() < 0.25 else raw), f"{cue} ", " "
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}")), f"{cue} ", " "
    if kind == "id":
        return f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}", f"{rng.choice(CUES['id'])} ", " "
    if kind == "secret":
        n = rng.choice((20, 32, 40, 64, 180, 400))
        return "".join(rng.choice("0123456789abcdef" if rng.random() < 0.7 else string.ascii_letters + string.digits) for _ in range(n)), rng.choice((f'{rng.choice(CUES["secret"])} = "', f"{rng.choice(CUES['secret'])}: ", f"{rng.choice(CUES['secret'])}=")), '" '
    if kind == "email":
        return f"{_word(rng)} {rng.choice(('at', '[at]', '(at)'))} {_word(rng)} {rng.choice(('dot', '[dot]'))} {rng.choice(('com', 'org', 'net', 'de'))}", f"{cue} ", " "
    return f"{rng.choice(('DE', 'FR', 'ES', 'GB'))}{_digits(rng, 2)}" + "".join(" " + _digits(rng, 4) for _ in range(rng.randint(3, 5))), f"{cue} ", " "


def _harmless(rng: random.Random) -> tuple[str, str, str]:
    """A value of similar shape that is nobody's."""
    cue = rng.choice(CUES["plain"])
    return rng.choice((
        lambda: (f"{_digits(rng, 3)}-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}", "isbn ", " "),
        lambda: (f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{_word(rng)} ", " "),
        lambda: (f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1900, 2030)}", f"{_word(rng)} ", " "),
        lambda: (_digits(rng, rng.randint(7, 12)), f"{cue} ", " "),
        lambda: (f"{rng.randint(1, 9)}.{_digits(rng, rng.randint(7, 20))}", f"{cue} ", " "),
        lambda: (" ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(5, 9))), f"{_word(rng)} ", " "),
        lambda: ("".join(_word(rng) for _ in range(4)), f"{_word(rng)}: ", " "),
        lambda: (f"//{_word(rng)}.{_word(rng)}.org/{_word(rng)}", "https:", " "),
        lambda: (f"//{_word(rng)}.org/" + rng.choice("/-_").join(_word(rng) for _ in range(rng.randint(20, 60))), "https:", " "),
        lambda: ("".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{rng.choice(('sha', 'commit'))}: ", " "),
        lambda: (f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", "time ", " "),
        lambda: (":".join(f"{rng.randint(0, 255):02x}" for _ in range(rng.choice((6, 6, 8)))), f"{rng.choice(('mac', 'fingerprint', _word(rng)))} ", " "),
        lambda: (":".join(str(rng.randint(0, 59)) for _ in range(rng.randint(6, 8))), f"{rng.choice(('ratio', 'times', 'laps', _word(rng)))} ", " "),
        lambda: (f"{_word(rng)} at {_word(rng)} dot {_word(rng)}{_word(rng)}", "the polka ", " "),
        lambda: (f"{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}", f"{cue} ", " "),
    ))()


def examples(count: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, answers and kinds of the generators' candidates in made-up texts."""
    rng = random.Random(seed)
    rows, answers, kinds = [], [], []
    for _ in range(count):
        text, values = " ".join(_word(rng) for _ in range(4)) + " ", []
        for k in range(rng.choice((1, 1, 1, 1, 2, 3))):  # several stand side by side, some beside an address
            private = rng.random() < 0.5
            value, before, after = (_private if private else _harmless)(rng)
            if rng.random() < 0.1:
                before = (before if k == 0 else "") + ".".join(str(rng.randint(0, 255)) for _ in range(4)) + " "
            elif k and value[0] in "(0123456789":
                before = rng.choice(("", "", before))
            text += before
            values.append((len(text), len(text) + len(value), private))
            text += value + after
        text += " ".join(_word(rng) for _ in range(4))
        for a, b, kind in candidates(text, [s for s in base_spans(text) if s[2] == "ip"]):
            if any(b > x and a < y for x, y, _ in values):
                rows.append(describe(text, a, b, kind))
                answers.append(float(any(private and a >= x - 1 and b <= y + 1 and b - a >= 0.8 * (y - x) for x, y, private in values)))
                kinds.append(kind)
    return np.array(rows), np.array(answers), kinds


_models: list[Model] = []


def model() -> Model:
    """The trained model; a job trains it once, on the driver, and sends it with its functions."""
    if not _models:
        x, y, _ = examples(TRAIN_TEXTS, 11)
        trees = Boosted().fit(x, y)
        x, y, kinds = examples(TRAIN_TEXTS // 2, 12)
        trees.calibrate(x, y)
        p = trees.probability(x)
        thresholds = {}
        for kind in KINDS:
            own = np.array([k == kind for k in kinds])
            thresholds[kind] = _threshold(p[own], y[own])
        _models.append(Model(trees, thresholds))
    return _models[0]


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least probability from which on the precision is as wanted; above one if there is none."""
    if not len(p):
        return 2.0
    order = np.argsort(-p, kind="stable")
    precision = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    return max(0.5, float(p[order[good[-1]]])) if len(good) else 2.0


def find(text: str | None, trained: Model | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans in order."""
    if not text:
        return [], []
    base = base_spans(text)
    every = base + (trained or model()).added(text, base)
    return base, sorted(every, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping ones the first holds."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find(text)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, digest of the base spans, all spans."""
    trained = model()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base, every = find(text, trained)
            kinds = [k for _, _, k in base]
            rows.append((*[kinds.count(k) for k in BASE_KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        names = [*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"]
        types = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], ["doc_id", *names])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_pieces(chosen, each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
