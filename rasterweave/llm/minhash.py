"""Near-duplicate documents: one-permutation MinHash with optimal densification.

Each set is hashed once; the top bits choose one of 128 bins and the least value of a bin is its
signature. An empty bin borrows from a bin chosen by a universal hash of (bin, attempt), which gives
the optimal variance. 32 bands of 4 bins are bucket keys. In a bucket, every member is paired with the
smallest one (a star), so pairs grow with members; every pair is confirmed on the full sets. Members
that their centre did not hold are then compared with a few others of the bucket, and those still apart
with all members of other components, so no link inside a bucket is lost: by the triangle inequality of
the Jaccard distance many need no look.

A pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**32, about 5 in a million.

Inputs: null or empty texts have an empty set and link with nothing; equal sets are one node, so copies
are never paired (the smallest doc_id stands for all); rows that repeat a doc_id are one document that
links where any of its texts does; a row with a null doc_id takes part in no link and gets the component
of an equal text, else null; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.common import map_pieces, mix, saved, shared_folder, small, utf8
from rasterweave.llm.components import components
from rasterweave.llm.words import shingle_sets

BINS, BANDS = 128, 32
#: Members of a bucket that strays are compared with before all others.
SAMPLE = 4
#: Hashed places of a count vector, and strays or members in a block.
PLACES, BLOCK = 8192, 512
ROWS = BINS // BANDS
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of densified bin minima a set; rows of empty sets stay EMPTY."""
    sig = np.full((len(sets), BINS), EMPTY, dtype=np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            bins = (s >> _SHIFT).astype(np.int64)  # sorted sets: the first of a bin is its least
            first = np.concatenate([[True], bins[1:] != bins[:-1]])
            sig[i, bins[first]] = s[first]
    return densify(sig)


def densify(sig: np.ndarray) -> np.ndarray:
    filled = sig != EMPTY
    some = filled.any(axis=1)
    rows, bins = np.nonzero(~filled & some[:, None])
    out, attempt = sig.copy(), 1
    while len(rows):
        source = (mix((bins * 1_000_003 + attempt).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        found = filled[rows, source]
        out[rows[found], bins[found]] = sig[rows[found], source[found]]
        rows, bins, attempt = rows[~found], bins[~found], attempt + 1
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band, the band's number mixed in."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingle_sets(*utf8(batch.column("text")))
    keys = band_keys(signatures(sets))
    full = [len(s) > 0 for s in sets]
    marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full, strict=True)]
    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
    bands = pc.if_else(pa.array(full, pa.bool_()), bands, pa.scalar(None, bands.type))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), bands], ["doc_id", "n_shingles", "mark", "bands"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingle_sets(*utf8(batch.column("text")))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["id", "shingles"])


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` with the exact shared count and union of their sets, made again from the texts that pairs name."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    chosen = texts.join(small(ends, 32), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = map_pieces(chosen, _sets, "id long, shingles array<long>")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return joined.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).cast("long").alias("total")).withColumn("united", F.col("total") - F.col("shared")).drop("total")


def _placed(larger: DataFrame, found: DataFrame) -> DataFrame:
    """Bucket members with their component and whether it is another than their centre's."""
    member = found.select(F.col("node").alias("id"), "component")
    centre = found.select(F.col("node").alias("centre"), F.col("component").alias("centre_component"))
    both = larger.join(member, "id", "left").join(centre, "centre", "left")
    own, its = F.coalesce("component", "id"), F.coalesce("centre_component", "centre")
    return both.select("key", "id", "n", "far", own.alias("component"), (own != its).alias("apart"))


def _against_some(placed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Strays against up to SAMPLE members of their bucket, by hash: most strays of a large group meet their component here."""
    picks = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))).alias(f"p{k}") for k in range(SAMPLE)]
    some = placed.groupBy("key").agg(*picks).select("key", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(SAMPLE)]))).alias("p")).select("key", "p.b", "p.nb", "p.cb")
    return placed.where("apart").join(some, "key").where((F.col("component") != F.col("cb")) & (F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent)).select("id", "b")


def _places(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = [(s % np.uint64(PLACES)).astype(np.uint16).tobytes() for s in shingle_sets(*utf8(batch.column("text")))]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["id", "places"])


def _against_all(placed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Strays against every member of another component, block by block.

    A set becomes counts over PLACES hashed places. The product of two count vectors is at least the size
    of the intersection, so a pair that fails on it fails on the sets, and no link is lost. Groups are
    blocks of strays and members of one bucket, so a task's size doesn't follow the bucket's.
    """
    counts = placed.groupBy("key").agg(F.count("*").alias("members"), F.count_if("apart").alias("strays")).where("strays > 0")
    split = counts.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("strays") / BLOCK).cast("int").alias("sb"))
    rows = placed.join(split, "key")
    ends = rows.select(F.col("id").alias("doc_id")).distinct()
    chosen = texts.join(small(ends, 32), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    rows = rows.join(map_pieces(chosen, _places, "id long, places binary"), "id")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    body = ["key", "id", "n", "far", "component", "places"]
    members = rows.withColumn("s", F.explode(every("sb"))).select(*body, F.pmod(F.xxhash64("id"), "mb").cast("int").alias("m"), "s", F.lit(False).alias("stray"))
    strays = rows.where("apart").withColumn("m", F.explode(every("mb"))).select(*body, "m", F.pmod(F.xxhash64("id"), "sb").cast("int").alias("s"), F.lit(True).alias("stray"))

    def block(table: pa.Table) -> pa.Table:
        stray = table.column("stray").to_numpy()
        ids, n, component = (table.column(c).to_numpy() for c in ("id", "n", "component"))
        far = table.column("far").to_numpy().astype(np.float64)
        counts = np.zeros((len(ids), PLACES), dtype=np.float32)
        for i, p in enumerate(table.column("places").to_pylist()):
            counts[i] = np.bincount(np.frombuffer(p, np.uint16), minlength=PLACES)
        a, b = np.flatnonzero(stray), np.flatnonzero(~stray)
        shared = counts[a] @ counts[b].T
        keep = 100 * shared >= percent * (n[a][:, None] + n[b][None, :] - shared)
        keep &= np.minimum(n[a][:, None], n[b][None, :]) * 100 >= np.maximum(n[a][:, None], n[b][None, :]) * percent
        keep &= component[a][:, None] != component[b][None, :]
        keep &= ~(np.abs(far[a][:, None] - far[b][None, :]) > 1 - percent / 100 + 1e-9)
        i, j = np.nonzero(keep)
        return pa.table({"id": ids[a[i]], "b": ids[b[j]]})

    return members.unionByName(strays).groupBy("key", "m", "s").applyInArrow(block, "id long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links need ``100 * shared >= percent * united``."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = saved(map_pieces(texts, _sketch, "doc_id long, n_shingles long, mark binary, bands array<long>"), folder, "sketches")
    nodes = saved(sketches.where("mark is not null and doc_id is not null").groupBy("mark").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("s")).select("mark", "s.*").withColumnRenamed("doc_id", "id"), folder, "nodes")

    rows = nodes.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    centres = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("members")).where("members > 1")
    stars = rows.join(centres.select("key", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n"), "members"), "key").where("id <> centre")
    stars = saved(stars.select("key", "centre", "id", "n", "members", (F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent).alias("fits")), folder, "stars")

    pairs = stars.where("fits").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    checked = saved(_confirm(pairs, texts), folder, "checked")
    links = checked.where(F.col("shared") * 100 >= F.col("united") * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = saved(components(links, folder, "first"), folder, "first")

    # Members apart from their bucket's centre: first against a few members of the bucket, then against all.
    known = checked.select(F.col("a").alias("centre"), F.col("b").alias("id"), (1 - F.col("shared") / F.col("united")).alias("far"))
    larger = saved(stars.where("members > 2").select("key", "centre", "id", "n").join(known, ["centre", "id"], "left"), folder, "larger")
    tested = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for name, compare in (("some", _against_some), ("all", _against_all)):
        placed = saved(_placed(larger, found), folder, f"placed-{name}")
        near = compare(placed, texts, percent).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
        more = saved(near.join(tested, ["a", "b"], "left_anti"), folder, f"more-{name}")
        if not more.isEmpty():
            looked = saved(_confirm(more, texts), folder, f"checked-{name}")
            extra = looked.where(F.col("shared") * 100 >= F.col("united") * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
            found = saved(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(extra), folder, f"found-{name}"), folder, f"found-{name}")
            tested = tested.unionByName(looked.select("a", "b"))

    labelled = nodes.select("mark", "id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("mark", F.coalesce("component", "id").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "mark").join(labelled, "mark", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows, all their columns kept, without documents whose group has a smaller doc_id.

    Rows that repeat a doc_id are one document: the one that comes first, written as JSON, stays. Rows with a
    null doc_id are no documents and stay, each of them.
    """
    marks = near_duplicates(docs, percent)
    folder = shared_folder(docs.sparkSession)
    verdicts = saved(marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), folder, "verdicts")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id").cast("long").alias("doc_id"))
    left = packed.join(small(verdicts.where("not kept or rows > 1").select("doc_id"), 32), "doc_id", "left_anti")
    again = packed.join(small(verdicts.where("kept and rows > 1").select("doc_id"), 32), "doc_id", "left_semi")
    return left.select("own.*").unionByName(again.groupBy("doc_id").agg(F.min_by("own", F.to_json("own")).alias("own")).select("own.*"))
