import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import time

import numpy as np
import pytest

import corpus_pipeline
from rasterweave.llm import lines, minhash, queries, spandedup, suffixes
from rasterweave.llm.components import components
from rasterweave.llm.editdistance import _plain, within

from .conftest import SCHEMA, odd_rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_against_all_pairs(spark, odd, nothing):
    got = minhash.near_duplicates(odd).collect()
    rows = [r for r in odd_rows() if r[0] is not None]
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is not None:
            assert r["n_shingles"] == len(sets[r["doc_id"]])
            assert r["component_id"] == root(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted({root(i) for i in sets})
    assert minhash.near_duplicates(nothing).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    """The same rule for all: one row an id stays, rows without an id stay, and which one stays is no chance."""
    words = [f"word{k}" for k in range(40)]
    rows = [(1, " ".join(words), "b"), (1, " ".join(words), "a"), (2, " ".join(words[1:]), "c"), (3, "x", "z"), (3, "y", "z"), (3, "y", "a"), (None, "x", "q"), (None, "x", "q"), (None, None, None)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, own string").repartition(parts)
        kept = sorted(map(tuple, minhash.one_of_each(df).collect()), key=str)
        assert kept == sorted([rows[1], (3, "x", "z"), *rows[6:]], key=str)


def test_strays_of_a_large_group_are_linked(spark):
    """A chain: each text is close to its neighbours only, and all share buckets with a distant centre."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in range(i):
            words[(7 * k) % 60] = f"c{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    sets = {i: shingles(t) for i, t in rows}
    for i in range(39):
        if 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1]):
            assert got[i] == got[i + 1]


def test_components(spark, tmp_path):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 99), (7, 7), (99, 98)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges, str(tmp_path), "c").collect()}
    assert got == {**{k: 0 for k in range(1, 51)}, 99: 98, 100: 98}


def test_edit_distance_and_probes():
    rng = np.random.default_rng(1)
    left, right = [], []
    for _ in range(400):
        a = bytes(rng.choice(list(b"abc"), rng.integers(0, 30)).tolist())
        b = bytearray(a)
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = bytes(rng.choice(list(b"abc"), rng.integers(0, 2)).tolist())
        left.append(a)
        right.append(bytes(b))
    for bound in (1, 2, 3):
        assert within(left, right, bound).tolist() == [_plain(a, b) <= bound for a, b in zip(left, right, strict=True)]
    assert len(lines.PROBES) == 12


def test_long_pairs_do_not_slow_others():
    """Lanes hold pairs of about one length; the longest pairs follow diagonals."""
    rng = random.Random(8)
    long_ = bytes(rng.choice(b"abcdefgh") for _ in range(1_000_000))
    left = [b"some line of the usual length, number %d" % k for k in range(500)] + [long_, long_, long_]
    right = [x.replace(b"usual", b"usual!") for x in left[:500]] + [long_[:7] + b"x" + long_[8:-3] + long_[-2:], long_[1:] + b"h", b"xyz" + long_[3:]]
    began = time.monotonic()
    got = within(left, right, 2)
    assert time.monotonic() - began < 3 and got[:500].all() and got[500:].tolist() == [True, True, False]


def removed_lines(rows):
    places = []
    for i, text in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        for k, line in enumerate(text.split("\n")):
            form = line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)}).encode()
            if len(form) >= lines.MIN_BYTES:
                places.append((i, k, form))
    return {(i, k) for i, k, f in places if any((j, m) < (i, k) and abs(len(f) - len(g)) <= 2 and _plain(f, g) <= 2 for j, m, g in places)}


def test_lines_against_all_pairs(spark, nothing):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog tonight.\nshort\nAnother line that nobody else has written yet, really."),
        (2, "The quick brown fox jumps over the lazy dog tonight!\nshort"),
        (3, "  the QUICK brown fox jumps over a lazy dog tonight.  \n\nA line far from all the others in this little table."),
        (4, "The quick brown fox jumped over two lazy dogs tonight."),
        (5, None), (6, ""), (7, "The quick brown fox jumps over the lazy dog tonight."), (7, "The quick brown fox jumps over the lazy dog tonight."),
        (None, "The quick brown fox jumps over the lazy dog tonight."),
        (8, "x" * 90), (9, "x" * 91), (10, "x" * 94), (11, "Another line that nobody else has writen yet, realy."),
    ]
    df = spark.createDataFrame([(*r, 3, "d", 1) for r in rows], "doc_id long, text string, n_chars int, drop string, `form` int")
    want = removed_lines(rows)
    got = {(r["doc_id"], int(k)) for r in lines.digests(df).collect() for k in r["removed"].split(",") if k}
    assert got == want and (2, 0) in want and (3, 0) not in {(4, 0)}
    kept = lines.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[2] == "short" and texts[5] is None and texts[None].startswith("The quick")
    assert lines.digests(nothing).count() == 0


def test_lines_on_odd_rows(odd):
    want = removed_lines(odd_rows())
    got = {(r["doc_id"], int(k)) for r in lines.digests(odd).collect() for k in r["removed"].split(",") if k}
    assert got == want


def close_lines(rows):
    """Lines that go if every line that is not empty is compared."""
    places = []
    for i, text in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        for k, line in enumerate(text.split("\n")):
            form = line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)}).encode()
            if form:
                places.append((i, k, form))
    return {(i, k) for i, k, f in places if any((j, m) < (i, k) and abs(len(f) - len(g)) <= 2 and _plain(f, g) <= 2 for j, m, g in places)}


@pytest.mark.parametrize("refine", [False, True])
def test_templates_and_common_lines(spark, monkeypatch, refine):
    """Many lines of one template share a segment; one line stands in every document; columns bear the names of the work."""
    if refine:
        monkeypatch.setattr(lines, "FREQUENT", 4)
        monkeypatch.setattr(lines, "COMMON_LEAST", 20)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(9))
    rows = []
    for k in range(120):
        line = f"posted by the member {word()} of this forum"
        near = line[:24] + "#" + line[25:]
        rows.append((k, f"{line}\nAll rights reserved.\n{rng.choice((near, near[:30] + near[32:], word()))}\n" + "\n".join([word()] * (k % 3))))
    df = spark.createDataFrame([(*r, 1, b"x", "z", 5) for r in rows], "doc_id long, text string, drop int, gone binary, own string, __id int")
    want = close_lines(rows)
    got = {(r["doc_id"], int(k)) for r in lines.digests(df, least=1).collect() for k in r["removed"].split(",") if k}
    assert got == want
    if refine:
        texts = {r["doc_id"]: r for r in lines.deduplicated(df, least=1).collect()}
        for i, text in rows:
            assert texts[i]["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in want)
            assert (texts[i]["drop"], bytes(texts[i]["gone"]), texts[i]["own"], texts[i]["__id"]) == (1, b"x", "z", 5)


def test_hubs_against_edit_distance():
    forms = [bytes(f) for n in range(1, 5) for f in itertools.product(b"abcd", repeat=n)]
    keys = {f: lines.hubs(f) for f in forms}
    for f in forms:
        for g in forms:
            if min(len(f), len(g)) < lines.SEGMENTS and f != g:
                assert any((1 - side, key) in keys[g] for side, key in keys[f]) == (_plain(f, g) <= 2), (f, g)


@pytest.mark.parametrize("order", [1, -1])
def test_short_lines_against_all_pairs(spark, odd, order):
    """Forms of every length from one byte on, short ones first or last."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n)) for n in (*range(1, 14), *range(1, 60, 2)) for _ in range(5)]
    texts += [t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :] for t in texts[30::2]] + [f"  {t.upper()} \n\n{t}x" for t in texts[40:60]]
    rows = [(order * k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = close_lines(rows)
    got = {(r["doc_id"], int(k)) for r in lines.digests(df, least=1).collect() for k in r["removed"].split(",") if k}
    assert got == want and len(want) < len(texts)
    got = {(r["doc_id"], int(k)) for r in lines.digests(odd, least=1).collect() for k in r["removed"].split(",") if k}
    assert got == close_lines(odd_rows())


def test_registered_query_and_stage_take_short_lines(spark, tmp_path):
    rows = [(1, "short\nThe quick brown fox jumps over the lazy dog tonight."), (2, "quite another\n\nShort ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    removed = {r["doc_id"]: r["removed"] for r in queries.queries()["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert removed == {1: "", 2: "2"}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == {1: rows[0][1], 2: "quite another\n"}


def plain_order(text):
    """Suffixes in order, and what each shares with the one before it, at most 50 bytes."""
    b = text.tobytes()
    order = sorted(range(len(b)), key=lambda i: b[i:])
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return order, [0] * (len(b) > 0) + [common(b[i : i + 50], b[j : j + 50]) for i, j in itertools.pairwise(order)]


@pytest.mark.parametrize("memory", [200, 4000, 1 << 20])
def test_suffix_order(monkeypatch, memory):
    """Recursion over several levels, ranges and single buckets, queues on disk and in memory."""
    rng = np.random.default_rng(2)
    deepest = spilled = 0
    for rows, small, frequent in ((16, 8, 3), (64, 16, 16), (1 << 16, 1 << 12, 4096)):
        monkeypatch.setattr(suffixes, "ROWS", rows)
        monkeypatch.setattr(suffixes, "SMALL", small)
        monkeypatch.setattr(suffixes, "FREQUENT", frequent)
        for n in (0, 1, 2, 7, 200, 900):
            for letters in (1, 2, 5, 250):
                text = rng.integers(1, letters + 1, n).astype(np.uint8)
                text[n // 2 : n // 2 + n // 4] = text[: n // 4]  # a long repeat
                for made in (text, np.tile(text[: max(1, n // 9)], 9) if n else text):
                    with suffixes.Scratch(memory) as scratch:
                        order, shared = (x.tolist() for x in suffixes.sort_suffixes(made, scratch))
                        deepest, spilled = max(deepest, scratch.levels), spilled + scratch.spilled
                    assert (order, shared) == plain_order(made)
    assert deepest >= 4 and (spilled > 0) == (memory < 1 << 20)


def test_suffixes_beyond_memory():
    """A text whose tuples are many times what the process may hold: they wait on disk, and the order is right."""
    code = """
import resource, numpy as np
from rasterweave.llm import suffixes
suffixes.ROWS = 1 << 12
rng = np.random.default_rng(4)
words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(2000)]
text = np.frombuffer(b" ".join(words[k] for k in rng.integers(0, 2000, 450_000)), dtype=np.uint8)
with suffixes.Scratch(1 << 18) as scratch:
    held = scratch.array(len(text), "uint8")
    held[:] = text
    del words
    used = int(open("/proc/self/statm").read().split()[5]) * resource.getpagesize()  # data and stack
    resource.setrlimit(resource.RLIMIT_DATA, (used + (20 << 20), -1))
    order, shared = suffixes.sort_suffixes(held, scratch)
    raw = text.tobytes()
    at = rng.integers(1, len(text), 20_000)
    for i, j, n in zip(order[at - 1].tolist(), order[at].tolist(), shared[at].tolist()):
        assert raw[i : i + 400] < raw[j : j + 400] and raw[i : i + n] == raw[j : j + n] and (n == 50 or raw[i + n : i + n + 1] != raw[j + n : j + n + 1])
    assert 24 * len(text) > 3 * (20 << 20) and scratch.spilled > len(text) and scratch.levels > 2
    seen = np.zeros(len(text), dtype=bool)
    seen[order] = True
    assert seen.all()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("last", [False, True])
def test_queue_takes_spilled_tuples_together(monkeypatch, last):
    """What was spilled in many chunks is taken ROWS at a time, in order, not chunk by chunk."""
    monkeypatch.setattr(suffixes, "ROWS", 100)
    with suffixes.Scratch() as scratch:
        queue = suffixes.Queue(2, 3, 8 * 3 * 20, scratch.folder)
        for a in range(0, 250, 5):
            rows = np.stack([np.arange(a, a + 5)] * 3, axis=1)
            queue.push(np.arange(5) % 2, rows)
        taken = []
        while (rows := queue.pop_last(0) if last else queue.pop(0)) is not None:
            taken.append(rows[:, 0].tolist())
        assert queue.spilled > 100 and [len(t) for t in taken] == [100, 50]
        wanted = [k for k in range(250) if k % 5 % 2 == 0]
        assert sum(taken, []) == (wanted[::-1] if last else wanted)
        queue.close()


@pytest.mark.parametrize("few", [0, 2, 32])
def test_long_repeats_in_a_bucket_take_few_steps(monkeypatch, few):
    """Chains of equal names in a bucket: the same order however they are followed, and not a step in numpy for each link."""
    monkeypatch.setattr(suffixes, "FEW", few, raising=False)
    monkeypatch.setattr(suffixes, "SMALL", 16)
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(1, 6, 300), np.tile([3, 1, 2], 400), rng.integers(1, 6, 300), np.tile([2, 4, 1, 1], 300), rng.integers(1, 6, 50)]).astype(np.uint8)
    calls, before = [], suffixes._Level.before
    monkeypatch.setattr(suffixes._Level, "before", lambda level, rows: calls.append(len(rows)) or before(level, rows))
    with suffixes.Scratch() as scratch:
        order, shared = (x.tolist() for x in suffixes.sort_suffixes(text, scratch))
        assert scratch.levels > 1
    assert (order, shared) == plain_order(text)
    assert few < 32 or len(calls) < 400


def test_window_names_across_blocks(monkeypatch):
    """Windows hashed in blocks bear the same names as those hashed at once, also where texts end."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 49, 50, 51, 700, 0, 3, 130)]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    runs = []
    for block in (1, 7, 64, 1 << 14):
        monkeypatch.setattr(spandedup, "BLOCK", block)
        runs.append([x.tolist() for x in spandedup.window_runs(data, offsets)])
    assert runs[0] == runs[1] == runs[2] == runs[3]
    starts, ends, owner, names = runs[0]
    windows = [(o, w) for a, b, o in zip(starts, ends, owner, strict=True) for w in range(a - offsets[o], b - offsets[o])]
    assert windows == [(o, w) for o, t in enumerate(texts) for w in range(len(t) - 49)]
    assert all(x != y or p != q for x, y, p, q in zip(names, names[1:], owner, owner[1:]))


def test_shards_spill_at_production_settings(spark):
    """A shard of the given documents does not fit the queues' memory."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").limit(2500)
    raw = "\n".join(r["text"] for r in docs.select("text").collect()).encode()[: 4 << 20]
    with suffixes.Scratch() as scratch:
        suffixes.sort_suffixes(np.frombuffer(raw, dtype=np.uint8) + np.uint8(2), scratch)
        assert scratch.spilled > 0 and 24 * len(raw) > suffixes.MEMORY


def test_frequent_runs_are_dealt_out(spark, monkeypatch):
    """One passage in every document, one in some: the places of frequent runs go their own way, with the same result."""
    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    often, seldom = fresh(40), fresh(30)
    rows = [(k, fresh(6) + " " + often[k % 3 :] + " " + fresh(4) + (seldom if k % 50 == 7 else "")) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(spandedup, "FREQUENT", 10)
    assert sorted(map(tuple, spandedup.digests(df).collect())) == sorted(defined_spans(rows))


def defined_spans(rows):
    first = {}
    for i, text in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        b = text.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if r[0] is not None and first[b[k : k + 50]] < r[0]:
                gone[k : k + 50] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        want.append((r[0], len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return want


def test_spans_against_the_definition(spark, odd, nothing):
    want = defined_spans(odd_rows())
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    got = [tuple(r) for r in spandedup.digests(odd).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert spandedup.digests(nothing).count() == 0
    assert SCHEMA
