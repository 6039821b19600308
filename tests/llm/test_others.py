import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterweave.llm import bpe, langid, licenses, matroska, mixing, pii, queries, topk
from rasterweave.llm.common import utf8

from .conftest import odd_rows

SF = "/root/testdata/sf0.001"


def test_language_held_out(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and got.where("score < 0 or score > 1").count() == 0
    rows = langid.identify(odd).collect()
    assert len(rows) == len(odd_rows())
    texts = {r[0]: r[1] for r in odd_rows()}
    for r in rows:
        if not any(map(str.isalpha, texts[r["doc_id"]] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0) or r["doc_id"] is None
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_network_tables_equal_network():
    rng = np.random.default_rng(0)
    net = langid.train(rng.integers(0, 256, (64, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 64), ["a", "b"])
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    e = net.embedding[x]
    h = [(sum(e[:, k : k + langid.WINDOW - w + 1] @ net.kernels[i][k] for k in range(w)) + net.biases[i]).max(axis=1) for i, w in enumerate(langid.WIDTHS)]
    z = np.maximum(np.concatenate(h, axis=1), 0) @ net.weights + net.offset
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x, net.tables()), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_bpe_equals_library(spark, odd, nothing, monkeypatch):
    codec = bpe.Codec(bpe.default_vocabulary())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "é", "漢", "'s", "'ll", "12", "!", "<|endoftext|>", "<|endo", "　", "word", "😀", "\t", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["", "x" * 4000, "漢字" * 800, " " * 2000]
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 7)
    monkeypatch.setattr(bpe, "SPARED", float("inf"))  # every text is cut, so that joins are repaired everywhere
    for text, ids in zip(texts, codec.encode(*utf8(pa.array(texts))), strict=True):
        want = codec.library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and codec.decode(ids) == codec.library.decode(want, skip_special_tokens=False) == text
    assert codec.reused > 0 and codec.repaired > 0
    monkeypatch.undo()
    texts = {r[0]: r[1] or "" for r in odd_rows() if r[0] is not None}
    got = bpe.digests(odd).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is not None:
            ids = codec.library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.with_tokens(odd)).collect()}
    assert all(back[i] == t for i, t in texts.items()) and bpe.digests(nothing).count() == 0


def test_bpe_words_reach_the_library_once(monkeypatch):
    """New chunks are put together from known words; with caches that turn over and words of all kinds ids stay the library's."""
    import json

    codec, rng, sent = bpe.Codec(bpe.default_vocabulary()), random.Random(3), []
    library = codec.library

    class Spy:
        def encode_batch_fast(self, texts, **options):
            sent.extend(len(t) for t in texts)
            return library.encode_batch_fast(texts, **options)

    def equal(texts):
        return [i.tolist() for i in codec.encode(*utf8(pa.array(texts)))] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    codec.library = Spy()
    words = ["".join(rng.choice("abcdeéñж") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    long = [" ".join(rng.choice(words) + rng.choice(["", ",", ".\n"]) for _ in range(5000)) for _ in range(3)]
    assert equal(long) and sum(sent) < sum(map(len, long)) / 5
    cuts = bpe.cut_places(utf8(pa.array(long))[0]).tolist()
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 100)
    assert bpe.cut_places(utf8(pa.array(long))[0]).tolist() == cuts and cuts
    parts = [" ", "  ", "\n", " \n", "\t", "\x85", "\xa0", "\u2003", "\u3000", "\u0301", "a", "Bc", "é", "ñ", "ж", "漢", "😀", "'s", "'", ",", ".", "?!", "12", "\x7f", "x" * 70, "<|endoftext|>", "<|endo", "|>", " the", " é"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    for changes in ({}, {"WORD_CACHE_BYTES": 3000}, {"WORD_CACHE_BYTES": 0, "STRING_WORDS": 2}, {"CHUNK_BYTES": 7, "SPARED": float("inf"), "CHUNK_ROWS": 5}):
        for name, value in changes.items():
            monkeypatch.setattr(bpe, name, value)
        codec.cache, codec.older = {}, {}
        assert all(equal(odd[k : k + 50]) for k in range(0, len(odd), 50))
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        file = json.load(f)
    token = {"id": len(file["model"]["vocab"]), "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    assert bpe.chunks_hold(file | {"added_tokens": [*file["added_tokens"], token | {"content": "ab"}]})
    assert not any(bpe.chunks_hold(file | {"added_tokens": [*file["added_tokens"], token | {"content": c}]}) for c in ("a b", "a\nb", "a,b"))


def test_licences(spark, odd, nothing):
    model = licenses.fit([f"the river {k} ran under the old bridge and on" for k in range(60)])
    texts, labels = licenses.examples(9, 2)
    found = {k: f for k, f, _ in model.paragraphs(*licenses._hashed(texts))}
    right = np.mean([found.get(k, licenses.UNKNOWN) == y for k, y in enumerate(labels)])
    assert right > 0.85 and not [k for k, y in enumerate(labels) if y == licenses.UNKNOWN and k in found]
    df = spark.createDataFrame([(1, "some prose\nReleased under the MIT License.\nmore prose"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "the licence plate was old")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_licenses"], r["families"], r["hits"]) for r in licenses.scan(df).collect()}
    assert got == {1: (3, 1, "mit", "1:mit"), 2: (1, 1, "cc-by-nc", "0:cc-by-nc"), 3: (0, 0, "", ""), 4: (0, 0, "", ""), 5: (1, 0, "", "")}
    assert licenses.scan(odd).count() == len(odd_rows()) and licenses.scan(nothing).count() == 0


def test_every_licence_of_a_paragraph():
    model = licenses.fit([f"the river {k} ran under the old bridge and on" for k in range(60)])
    filler = "the river ran under the old bridge and on to the sea " * 9
    texts = {
        "Licensed under the MIT License or the Apache License 2.0": {"mit", "apache"},
        "Licensed under the Apache License, Version 2.0 or the MIT License": {"mit", "apache"},
        "Released under the MIT License. " + filler + "Licensed under CC BY-NC 4.0. " + filler + "This work is licensed under the Mozilla Public License 2.0.": {"mit", "cc-by-nc", "mpl"},
        "Released under the GNU Affero General Public License, version 3": {"agpl"},
        filler + "Released under the GNU Lesser General Public License": {"lgpl"},
        filler: set(),
    }
    got = [set() for _ in texts]
    for k, family, _ in model.paragraphs(*licenses._hashed(list(texts))):
        got[k].add(family)
    assert got == list(texts.values())


@pytest.mark.parametrize("lacing", ["fixed", "xiph", "ebml"])
@pytest.mark.parametrize("size", [0, 1, 576, 577, 40000])
def test_matroska_round_trip(lacing, size):
    payload = matroska.payload_of(random.Random(size).randbytes(size))
    data = matroska.mux(payload, lacing)
    media = matroska.demux(data)
    assert b"".join(data[o : o + s] for _, _, _, o, s, _ in media.packets) == payload and len(payload) % 576 == 0 < len(payload)
    assert [p[2] for p in media.packets] == [k * matroska.FRAME_MS for k in range(len(media.packets))]
    assert [c[2] for c in media.cues] == media.clusters and media.tracks[0]["codec"] == "A_PCM/INT/LIT"


def test_matroska_unknown_sizes_and_faults():
    frames = [bytes([k]) * s for k, s in enumerate((1, 300, 0, 255, 70000, 256, 9))]
    block = lambda how: b"\x81\x00\x05" + matroska._laced(frames, how)
    cluster = lambda how: matroska._id(matroska.CLUSTER) + b"\xff" + matroska._uint(matroska.TIMESTAMP, 100) + matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, block(how)))
    head = matroska._element(matroska.EBML, matroska._element(matroska.DOC_TYPE, b"webm"))
    data = head + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster("xiph") + cluster("ebml")
    media = matroska.demux(data)
    assert [data[o : o + s] for _, _, _, o, s, _ in media.packets] == frames * 2
    assert [p[1] for p in media.packets] == [0] * 7 + [1] * 7 and media.packets[0][2] == 105 and media.packets[0][5]
    for broken in (b"", b"\x00", data[:40], b"RIFF" * 9):
        with pytest.raises((matroska.MediaError, IndexError)):
            matroska.demux(broken)


def test_media_columns(odd, nothing):
    texts = {r[0]: (r[1] or "").encode() for r in odd_rows() if r[0] is not None}
    got = matroska.media_digests(odd).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is not None:
            p = matroska.payload_of(texts[r["doc_id"]])
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    media = matroska.to_media(odd.where("doc_id = 0"))
    assert matroska.packets(media).agg(F.sum("size")).first()[0] == len(matroska.payload_of(texts[0]))
    assert matroska.packets(media.withColumn("media", F.lit(None).cast("binary"))).count() == 0 and matroska.media_digests(nothing).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(120)]
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0]), (250, [float("nan")] * 4), (300, [1.0]), (None, [1.0] * 4), (7, [2.0] * 4)]
    df = spark.createDataFrame([(*v, 1, "q") for v in vectors], "vec_id long, embedding array<double>, id int, asked string")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors[:120] + vectors[-1:]]
    for k in (5, 500):
        want = []
        for i, v in good:
            if i % 50 == 0:
                best = sorted(((-int(v @ w), j) for j, w in good if j != i))[:k]
                want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, k).collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("huge", [[], [3e5], [3e5, -2.5e13, 1e15, 7e200, 1.5e308]])
def test_top_k_is_exact_for_every_finite_vector(spark, huge):
    """One or more huge components, ties among them, and lengths that are rare: as whole numbers say."""
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.integers(-900, 900, 6) / 256 + rng.random(6) / 300]) for i in range(90)]
    vectors += [(200 + i, [x, 0.5, 0.0, -1.0, 2.0, 0.25 * (i % 2)]) for i, x in enumerate(huge * 3)]
    vectors += [(350, [huge[-1] if huge else 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (402, [3.0, 1.0]), (403, [])]
    exact = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in vectors}
    want = []
    for i in exact:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(exact[i], w, strict=True)), j) for j, w in exact.items() if j != i and len(w) == len(exact[i]) > 0)[:5]
            want += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(best)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)


def test_pii_base_and_added(odd, nothing):
    def brute(text):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("01259..@@+-- ()aé%\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("1" * 200_000 + "." * 9) == [] and pii.base_spans("a" * 100_000 + "@") == []
    x, y, kinds = pii.examples(1500, 77)
    p = pii.model().trees.probability(x)
    flagged = np.array([v >= pii.model().thresholds[k] for v, k in zip(p, kinds, strict=True)])
    assert y[flagged].mean() > 0.95 and flagged[y == 1].mean() > 0.85
    text = 'mail bob@x.org, 4012888888881881 or token = "abcdef0123456789abcdef01"'
    base, every = pii.find(text)
    assert [k for _, _, k in base] == ["email", "card"] and [k for _, _, k in every] == ["email", "card", "secret"]
    assert "bob@x.org" not in pii.redact(text) and pii.redact(None) is None
    assert pii.find("The river ran under 12 old bridges in 1999, 3 of 4.") == ([], [])
    assert pii.scan(odd).count() == len(odd_rows()) and pii.scan(nothing).count() == 0


def test_pii_numbers_side_by_side():
    for text, private in (
        ("192.168.1.10 555-123-4567", ["192.168.1.10", "555-123-4567"]),
        ("call 555-123-4567 192.168.1.10 for help", ["555-123-4567", "192.168.1.10"]),
        ("phone 555-123-4567 555-987-6543 in the morning", ["555-123-4567", "555-987-6543"]),
        ("phone 555-123-4567 555-987-6543 555-222-8181", ["555-123-4567", "555-987-6543", "555-222-8181"]),
        ("10.0.0.7 ssn 123-45-6789 10.0.0.8", ["10.0.0.7", "123-45-6789", "10.0.0.8"]),
        ("call (555) 123-4567 10.1.2.3", ["(555) 123-4567", "10.1.2.3"]),
    ):
        base = pii.base_spans(text)
        proposed = {text[a:b] for a, b, _ in base + pii.candidates(text, base)}
        assert set(private) <= proposed
        assert [text[a:b] for a, b, _ in pii.find(text)[1]] == private
    assert len(pii.candidates("1 2/" * 20_000)) <= 40_000 * pii.MOST_DIGITS


@pytest.mark.parametrize("n", [20, 128, 129, 300, 5000])
def test_pii_secrets_are_whole(n):
    rng = random.Random(n)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(n))
    for text in (f'token = "{secret}" and more', f"password: {secret}"):
        at = text.index(secret)
        assert (at, at + n, "secret") in pii.find(text)[1]
        assert secret[-12:] not in pii.redact(text)


def test_mixing(odd, nothing):
    rows = mixing.shares(odd).collect()
    assert len(rows) == len(odd_rows())
    total = sum(r["size"] for r in rows)
    by_target = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target.setdefault((r["target"], r["source_size"]), []).append(r["taken"])
    assert abs(sum(t for t, _ in by_target) - 1.5 * total) < 1e-6
    for (target, size), taken in by_target.items():
        assert abs(sum(taken) - target) <= 1 and target <= 2 * size
    assert sorted(map(str, mixing.shares(odd.repartition(7)).collect())) == sorted(map(str, rows))
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert mixing.shares(nothing).count() == 0 and mixing.mixture(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.shares(odd, cut="x")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_pipeline(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encode":
            assert out.columns == odd.columns, name
        docs = out.cache()
        assert docs.count() > 0
    assert set(docs.columns) >= {"doc_id", "tokens"}


def plain_mix(rows):
    """(doc_id, text, source) rows as often as the mix takes them: random order by key, whole epochs, then up to the nearer side of the cut."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    size = {s: sum(words(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= weight[s] * level}
        target |= {s: 2.0 * size[s] for s in full} or {s: weight[s] * level for s in open_}
        open_ -= full or open_
    out = []
    for s in sources:
        budget, at = int(target[s] + 0.5), 0
        epochs = budget // size[s] if size[s] else 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            n = words(r[1])
            left = max(0, min(n, budget - epochs * size[s] - at))
            out += [r] * (1 if n == 0 else epochs + (2 * left >= n))
            at += n
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    """The whole of run() on a small table; the network's verdicts are taken from the first query."""
    import pyarrow.parquet as pq

    from .test_dedup import close_lines, shingles

    table = pq.read_table(f"{SF}/documents.parquet").slice(0, 120)
    pq.write_table(table, str(tmp_path / "documents.parquet"))
    rows = list(zip(*[table[c].to_pylist() for c in ("doc_id", "text", "source")], strict=True))
    said = {r["doc_id"]: r for r in queries.queries()["op1_language_id"](spark, str(tmp_path)).collect()}
    rows = [r for r in rows if said[r[0]]["lang_pred"] != "und" and said[r[0]]["score"] >= langid.LEAST_SCORE]
    gone = close_lines(rows)
    cut = {r[0]: r[1] if all((r[0], k) not in gone for k in range(r[1].count("\n") + 1)) else "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0], k) not in gone) for r in rows}
    rows = [(i, cut[i], s) for i, t, s in rows if cut[i] == t or cut[i].strip()]
    sets, root = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    mixed = plain_mix([r for r in rows if root[r[0]] == r[0]])
    codec = bpe.Codec(bpe.default_vocabulary())
    want = sorted((i, tuple(codec.library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in mixed)
    got = sorted((r["doc_id"], tuple(r["tokens"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(gone) > 0 and len({i for i, _ in want}) < len(want)


def test_language_fit_is_bounded(spark, odd, monkeypatch):
    """One row that stands thousands of times is trained on once; without labels nothing is thrown away."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id")))
    again = docs.unionByName(docs.where("text is not null").limit(1).select(F.col("doc_id"), "text", "lang", F.explode(F.array_repeat(F.lit(1), 3000)).alias("x")).drop("x"))
    seen = []
    monkeypatch.setattr(langid, "train", lambda x, y, names, seed=7: seen.append((x.tobytes(), tuple(y), tuple(names))))
    langid.fit(docs)
    langid.fit(again)
    assert seen[0] == seen[1]
    monkeypatch.setattr(langid, "TRAIN_DOCS", 5)
    langid.fit(again)
    assert 0 < len(seen[2][1]) <= 5 * langid.TRAIN_WINDOWS * len(seen[2][2])
    assert langid.accepted(odd.withColumn("lang", F.lit(None).cast("string"))).count() == len(odd_rows())


def test_tokenizer_files_that_do_not_hold(tmp_path):
    """Other pre-tokenizers, normalizers or tokens with spaces: texts are encoded whole, still as the library does."""
    import json

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        file = json.load(f)
    assert bpe.chunks_hold(file)
    text = ("Some words of a long text that is cut. Others follow it, and so on. " * 400).strip()
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": file["pre_tokenizer"] | {"use_regex": False}}, {"added_tokens": [*file["added_tokens"], {"id": len(file["model"]["vocab"]), "content": "of a", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]}):
        assert not bpe.chunks_hold(file | change)
        path = tmp_path / "other.json"
        path.write_text(json.dumps(file | change), encoding="utf-8")
        codec = bpe.Codec(str(path))
        assert codec.encode(*utf8(pa.array([text])))[0].tolist() == codec.library.encode(text, add_special_tokens=False).ids
    codec = bpe.Codec(bpe.default_vocabulary())
    dense = "".join(random.Random(1).choice("漢字仮名交文") for _ in range(30_000))
    assert codec.encode(*utf8(pa.array([dense])))[0].tolist() == codec.library.encode(dense, add_special_tokens=False).ids and codec.encoded == 1


def test_licence_phrasings_not_trained_on():
    """Held-out phrasings and foreign licences; SPDX tags behind comment marks; statements wrapped over lines."""
    model = licenses.fit([f"the river {k} ran under the old bridge and on" for k in range(60)])
    texts, labels = licenses.examples(31, 3, held=True)
    found = {}
    for k, family, _ in model.paragraphs(*licenses._hashed(texts)):
        found.setdefault(k, set()).add(family)
    known = [k for k, y in enumerate(labels) if y != licenses.UNKNOWN]
    assert np.mean([labels[k] in found.get(k, ()) for k in known]) > 0.8
    assert not [texts[k] for k, y in enumerate(labels) if k in found and found[k] != {y}]
    for text, family in (("// SPDX-License-Identifier: MIT", "mit"), (" * SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("GNU Free Documentation License", "gfdl"), ("Microsoft Public License", "ms-pl")):
        assert [f for _, f, _ in model.paragraphs(*licenses._hashed([text]))] == [family]
    assert not model.paragraphs(*licenses._hashed(["Apache Software Foundation terms"]))


def test_wrapped_licences(spark):
    notice = licenses.NOTICES["mit"][0].split()
    wrapped = "\n".join(" * " + " ".join(notice[k : k + 5]) for k in range(0, len(notice), 5))
    df = spark.createDataFrame([(1, f"/*\n{wrapped}\n */\nint main() {{}}"), (2, "Licensed under the\nMIT License and so on"), (3, "Licensed under the\n\nsea")], "doc_id long, text string")
    model = licenses.fit([f"the river {k} ran under the old bridge and on" for k in range(60)])
    got = {r["doc_id"]: (r["families"], r["hits"]) for r in licenses.scan(df, model).collect()}
    assert got[1][0] == got[2][0] == "mit" and got[2][1] == "0:mit" and got[3] == ("", "")


def test_matroska_of_other_writers(spark):
    """Checksums and fillers among tracks and cues, and names that are not UTF-8."""
    data = matroska.mux(matroska.payload_of(b"x" * 3000))
    filler, crc = matroska._element(0xEC, b"\0" * 9), matroska._element(0xBF, b"abcd")
    head = matroska._element(matroska.EBML, matroska._element(matroska.DOC_TYPE, b"matroska"))
    parts = {kind: data[a:b] for kind, _, a, b in matroska.elements(data, matroska.demux(data).segment, len(data), matroska.SEGMENT)}
    bodies = [(matroska.TRACKS, crc + filler + parts[matroska.TRACKS].replace(b"A_PCM/INT/LIT", b"A_PCM\xff\xfe/LITxx")), (matroska.CLUSTER, parts[matroska.CLUSTER]), (matroska.CUES, crc + parts[matroska.CUES] + filler)]
    made = head + matroska._element(matroska.SEGMENT, b"".join(matroska._element(k, b) for k, b in bodies))
    media = matroska.demux(made)
    assert len(media.tracks) == len(media.cues) == 1 and media.tracks[0]["number"] == 1
    assert b"".join(made[o : o + n] for _, _, _, o, n, _ in media.packets) == matroska.payload_of(b"x" * 3000)
    df = spark.createDataFrame([(1, made), (2, made[:200]), (3, b"\x1a\x45\xdf\xa3" * 5), (4, None)], "doc_id long, media binary")
    assert matroska.packets(df).where("doc_id = 1").count() == len(media.packets) and matroska.packets(df).where("doc_id > 2").count() == 0


def test_pii_addresses_with_colons():
    for text, found in (("client 2001:0db8:85a3:0000:0000:8a2e:0370:7334 connected", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]), ("host fe80:0:0:0:202:b3ff:fe1e:8329 down", ["fe80:0:0:0:202:b3ff:fe1e:8329"]), ("mac 00:1a:2b:3c:4d:5e here", []), ("times 10:20:30:40:50:59 here", [])):
        assert [text[a:b] for a, b, _ in pii.find(text)[1]] == found, text
