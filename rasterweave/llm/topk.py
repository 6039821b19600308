"""Exact top-k by inner product: distributed histogram selection.

Scores are integers: every component is floor(256 x), which a double holds exactly. Queries and candidates
are packed into blocks, and blocks are dealt to cells of a grid. Each pass scores all pairs of a cell by
matrix product (nothing is kept between passes) and counts, for every query, how many scores fall into each
bin of its current interval; a cell adds up the counts of all its candidates before they leave it. The counts
are summed over the cells, the bin that holds the k-th highest score becomes the interval, and passes go on
until it is one value. A last pass keeps the scores at or above it, at most k a query and cell by (score,
smaller id), and a final selection breaks ties by id.

Products of two vectors whose squared norms stay below 2**52 are exact in double precision, partial sums
included (the product of the norms bounds them). Pairs with a longer vector are scored in whole numbers of any
size, and selected by a key that rises with the score, the leading 32 bits of the score as a double;
of scores with the same key the exact ones decide. A score beyond 64 bits is reported as the nearest long.

Inputs: vectors that are null, empty, or hold a null or a component that is not finite take no part, nor do
rows with a null id; a query meets the vectors of its own length only; rows that repeat an id are each a
candidate, but a query never meets rows with its own id, and one row of a repeated id is asked, the one with
the least vector hash; with fewer than k candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.llm.common import by_key, saved, shared_folder, shuffle_partitions, small, whole

SCALE = 256
#: Bins of a pass at most, and bits of the key of long vectors' scores.
BINS, KEY_BITS = 512, 32
#: Vectors in a block, and blocks of candidates that a cell holds.
QUERY_BLOCK, BLOCK, HELD_BLOCKS = 64, 2048, 32
#: Blocks that Arrow brings at once.
BLOCKS_A_BATCH = 4
EXACT = 2.0**52
MOST, LEAST = 2**63 - 1, -(2**63)

#: query ids, candidate ids, sort keys (a query's own rows: None), and a function from places to exact scores
Scored = tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int, np.ndarray], list[int]]]


def _clean(vectors: DataFrame, is_query: Column, ids: str, column: str) -> DataFrame:
    """id, v (array of doubles), n (length), long, asked, order (a hash of v)."""
    values = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(ids).isNotNull() & F.col(column).isNotNull()).select(F.col(ids).cast("long").alias("id"), values.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    fine = rows.where((F.size("v") > 0) & finite)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x * SCALE, F.lit(2.0)))
    # floor moves a component by less than one, so a norm well below the bound stays below it
    return fine.withColumns({"n": F.size("v"), "long": norm + 2 * F.sqrt(norm * F.size("v")) + F.size("v") >= EXACT, "order": F.xxhash64("v")})


def _packed(vectors: DataFrame, size: int, folder: str, name: str) -> DataFrame:
    """n, block, ids, lows, vals (bytes): about ``size`` vectors of equal length a row, dealt by hash."""
    counts = saved(vectors.groupBy("n").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks")), folder, f"{name}-counts")
    dealt = vectors.join(small(counts, 32), "n").select("n", F.pmod(F.xxhash64("id", "order"), "blocks").alias("block"), "id", "v", "low")

    def pack(table: pa.Table) -> pa.Table:
        flat = np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks])
        packed = [x.tobytes() for x in (table.column("id").to_numpy(), table.column("low").to_numpy(), flat)]
        return pa.table({"n": table.column("n")[:1], "block": table.column("block")[:1], **{k: pa.array([x], pa.binary()) for k, x in zip(("ids", "lows", "vals"), packed, strict=True)}})

    return saved(dealt.groupBy("n", "block").applyInArrow(pack, "n int, block long, ids binary, lows binary, vals binary"), folder, name)


def _whole_number(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE


def _key(score: int) -> int:
    """A number of KEY_BITS that never falls as the score rises."""
    try:
        bits = int(np.float64(float(score)).view(np.int64))
    except OverflowError:
        bits = int(np.float64(math.inf if score > 0 else -math.inf).view(np.int64))
    return (bits if bits >= 0 else bits ^ MOST) >> 64 - KEY_BITS


def _short_scores(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, Callable[[int, np.ndarray], list[int]]]:
    scores = np.floor(q * SCALE) @ np.floor(c * SCALE).T
    return scores, lambda i, at: scores[i, at].astype(np.int64).tolist()


def _long_scores(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, Callable[[int, np.ndarray], list[int]]]:
    exact = np.vectorize(_whole_number, otypes=[object])
    scores = exact(q) @ exact(c).T
    return np.vectorize(_key, otypes=[np.float64])(scores), lambda i, at: scores[i, at].tolist()


def _sorted_key(score: int) -> bytes:
    """Bytes that sort like the scores."""
    size = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return b"\1" + size.to_bytes(2) + score.to_bytes(size)
    return b"\0" + (65535 - size).to_bytes(2) + ((1 << 8 * size) - 1 + score).to_bytes(size)


class _Cell:
    """The candidates of a cell, as they come, then a function of each block of queries with all of them."""

    def __init__(self, scores: Callable, function: Callable[[np.ndarray, np.ndarray, Iterator], pa.RecordBatch]):
        self.scores, self.function = scores, function

    def __call__(self, key: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                vals = np.frombuffer(row["vals"]).reshape(len(ids), row["n"])
                if row["kind"] == 0:
                    held.append((ids, vals))
                elif held:
                    yield self.function(ids, np.frombuffer(row["lows"], np.int64), self.pairs(ids, vals, held))

    def pairs(self, qids: np.ndarray, q: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        for cids, c in held:
            keys, exact = self.scores(q, c)
            own = np.argsort(cids, kind="stable")
            left = np.searchsorted(cids, qids, "left", sorter=own)
            right = np.searchsorted(cids, qids, "right", sorter=own)
            meets = np.flatnonzero(right > left)
            if len(meets):
                keys = keys.copy()
                for i in meets:
                    keys[i, own[left[i] : right[i]]] = -np.inf
            yield cids, keys, exact


def _histogram(step: int, bins: int) -> Callable:
    """query_id, bin, n: the scores in each bin from the query's lower end up, over all candidates of a cell."""

    def count(qids: np.ndarray, lows: np.ndarray, pairs: Iterator) -> pa.RecordBatch:
        total = np.zeros((len(qids), bins + 1), dtype=np.int64)
        for _, keys, _ in pairs:
            place = np.floor((keys - lows[:, None]) / step)
            place[~((place >= 0) & (place < bins))] = bins
            place += np.arange(len(qids))[:, None] * (bins + 1)
            total += np.bincount(place.astype(np.int64).ravel(), minlength=total.size).reshape(total.shape)
        i, b = np.nonzero(total[:, :bins])
        return pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(b.astype(np.int32)), pa.array(total[i, b])], ["query_id", "bin", "n"])

    return count


def _best(k: int) -> Callable:
    """At most k scores of each query in a cell, those at or above its k-th key, by score and then smaller id."""

    def choose(qids: np.ndarray, lows: np.ndarray, pairs: Iterator) -> pa.RecordBatch:
        found: list[list[tuple[int, int]]] = [[] for _ in qids]
        for cids, keys, exact in pairs:
            for i, low in enumerate(lows.tolist()):
                at = np.flatnonzero(keys[i] >= low)
                if len(at):
                    found[i] = sorted([*found[i], *zip([-s for s in exact(i, at)], cids[at].tolist(), strict=True)])[:k]
        rows = [(q, c, max(LEAST, min(MOST, -s)), _sorted_key(-s)) for q, own in zip(qids.tolist(), found, strict=True) for s, c in own]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["query_id", "vec_id", "score", "sort"])

    return choose


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, ids: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row among all rows of another id."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows_per_batch = spark.conf.get(name)
    try:
        return saved(_search(vectors, is_query, k, ids, column, folder), folder, "result")
    finally:
        spark.conf.set(name, rows_per_batch)


def _search(vectors: DataFrame, is_query: Column, k: int, ids: str, column: str, folder: str) -> DataFrame:
    clean = saved(_clean(vectors, is_query, ids, column), folder, "clean")
    least = F.min(F.struct("order", "n", "v", "long")).alias("s")
    queries = saved(clean.where("asked").groupBy("id").agg(least).select("id", "s.*"), folder, "queries")
    short, long_ = clean.where("not long"), clean.where("long")
    parts = []
    if not queries.where("not long").isEmpty():
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0)))
        bound = int(short.agg(F.max(norm)).first()[0]) + 1
        parts.append(_selected(queries.where("not long"), short, k, bound, _short_scores, folder, "short"))
    if not long_.isEmpty():
        bound = 1 << KEY_BITS - 1
        parts.append(_selected(queries, long_, k, bound, _long_scores, folder, "long"))
        parts.append(_selected(queries.where("long"), short, k, bound, _long_scores, folder, "mixed"))
    best = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, sort binary")
    for part in parts:
        best = best.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("sort"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _selected(queries: DataFrame, candidates: DataFrame, k: int, bound: int, scores: Callable, folder: str, name: str) -> DataFrame:
    """query_id, vec_id, score, sort: the k best candidates of each query and some more; sort keys lie within ``bound``."""
    spark = queries.sparkSession
    batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch_rows, "10000")
    blocks = _packed(candidates.withColumn("low", F.lit(0).cast("long")), BLOCK, folder, f"{name}-blocks")
    # A grid for each length: every cell holds at most HELD_BLOCKS blocks of candidates and streams blocks of queries.
    asked = queries.groupBy("n").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("asked"))
    across = F.ceil(F.col("blocks") / HELD_BLOCKS)
    wanted = F.ceil(F.lit(shuffle_partitions(spark)) / across)
    grid = saved(blocks.groupBy("n").agg((F.max("block") + 1).alias("blocks")).join(asked, "n").select("n", across.cast("long").alias("across"), F.greatest(F.lit(1), F.least(wanted, "asked")).cast("long").alias("down")), folder, f"{name}-grid")
    grid = small(grid, 48)
    cells = grid.agg(F.sum(F.col("across") * F.col("down"))).first()[0] or 0
    key = F.xxhash64("n", "x", "y").alias("key")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    held = blocks.join(grid, "n").withColumn("x", F.pmod("block", "across")).withColumn("y", every("down")).select(key, F.lit(0).alias("kind"), "n", "ids", "lows", "vals")

    def each_cell(state: DataFrame, turn: int, function: Callable, schema: str) -> DataFrame:
        spark.conf.set(batch_rows, "10000")
        packed = _packed(queries.join(state, "id"), QUERY_BLOCK, folder, f"{name}-asked-{turn}")
        sent = packed.join(grid, "n").withColumn("x", every("across")).withColumn("y", F.pmod("block", "down")).select(key, F.lit(1).alias("kind"), "n", "ids", "lows", "vals")
        spark.conf.set(batch_rows, str(BLOCKS_A_BATCH))
        return by_key(held.unionByName(sent), "key", cells, _Cell(scores, function), schema, "kind")

    # [low, low + width) holds the k-th highest key of a query; `above` keys are higher.
    turns = max(1, math.ceil(math.log(2 * bound + 1) / math.log(BINS)))
    bins = next(b for b in range(2, BINS + 1) if b**turns >= 2 * bound + 1)
    width = bins**turns
    state = queries.select("id", F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    for turn in range(turns):
        step = width // bins
        counted = each_cell(state, turn, _histogram(step, bins), "query_id long, bin int, n long")
        sums = counted.groupBy(F.col("query_id").alias("id"), "bin").agg(F.sum("n").alias("n")).join(state, "id")
        down = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = sums.withColumn("upto", F.col("above") + F.sum("n").over(down))
        hit = F.max(F.when(F.col("upto") >= k, F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))))
        found = upto.groupBy("id").agg(F.max("low").alias("low"), F.max("above").alias("above"), F.min("bin").alias("lowest"), hit.alias("hit"))
        width = step
        state = saved(found.select("id", (F.col("low") + F.coalesce("hit.bin", "lowest").cast("long") * step).alias("low"), F.coalesce("hit.before", "above").cast("long").alias("above")), folder, f"{name}-state-{turn}")
    return saved(each_cell(state, turns, _best(k), "query_id long, vec_id long, score long, sort binary"), folder, f"{name}-best")
