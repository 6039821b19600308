"""What the operators share: shared storage, bounded Arrow batches, byte views, mixing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a Python worker looks at in one piece; a longer text is a piece of its own.
PIECE_BYTES = 1_000_000
#: Rows in an Arrow batch, so that a batch of long texts stays in memory.
BATCH_ROWS = 512
#: A table is broadcast up to this size; partitions that keys are dealt to.
BROADCAST_BYTES, MOST_PARTITIONS = 64 << 20, 20_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = tempfile.mkdtemp(prefix="rasterweave-")
    return f"{top.rstrip('/')}/rasterweave-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table to shared storage and reads it again: lineage ends there, lost executors cost nothing."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a saved table that nothing will read again, through Spark's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to BATCH_ROWS; plans are lazy, so the setting stays with the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def small(table: DataFrame, row_bytes: int, *sized: str) -> DataFrame:
    """Marks a saved table for broadcast if its rows, and the bytes of its columns ``sized``, stay below BROADCAST_BYTES."""
    size = F.count("*") * row_bytes
    for column in sized:
        size = size + F.coalesce(F.sum(F.octet_length(column) if dict(table.dtypes)[column] in ("string", "binary") else 8 * F.size(column)), F.lit(0))
    return F.broadcast(table) if table.agg(size).first()[0] <= BROADCAST_BYTES else table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n, at = len(column), column.offset
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each piece has PIECE_BYTES of text, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, length in enumerate(lengths.tolist()):
        if i > start and size + length > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    if start < len(lengths):
        yield batch.slice(start)


def map_pieces(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """``mapInArrow`` piece by piece."""
    bounded_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                made = function(piece)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(each, schema)


def _slices(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            yield int(keys[a]), batch.slice(a, b - a)


def by_key(df: DataFrame, key: str, keys: int, function: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *order: str) -> DataFrame:
    """A function of the rows of each of about ``keys`` keys, in ``order``; a worker sees them batch by batch and holds what the function holds."""
    bounded_batches(df.sparkSession)
    parts = min(MOST_PARTITIONS, max(shuffle_partitions(df.sparkSession), keys))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in groupby(_slices(batches, key), lambda pair: pair[0]):
            yield from function(value, (batch for _, batch in rows))

    return df.repartition(parts, key).sortWithinPartitions(key, *order).mapInArrow(each, schema)


def whole(function: Callable[[pa.Table], pa.Table]) -> Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For :func:`by_key`: a function of all rows of a key at once."""
    return lambda key, batches: function(pa.Table.from_batches(list(batches))).to_batches()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
