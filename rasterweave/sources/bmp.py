"""24-bit BMP files (a file of no bytes gives no row): codec, batch scan, a data source that reads row bands with halos, and writers.

The scan checks what a decoder needs (magic, bit depth, compression, length) and honours the pixel
offset and the sign of the height.  ``mode``: PERMISSIVE keeps a faulty file with ``error`` set,
DROPMALFORMED leaves it out, FAILFAST raises.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rasterweave.sources.raster import CHANNELS, PIXEL_SCHEMA

# The file format.
MAGIC = 19778
HEADER = struct.Struct("<HIIIIiiHHIIiiII")
HEADER_FIELDS = ("bfSize", "bfReserved", "bfOffBits", "biSize", "biWidth", "biHeight", "biPlanes", "biBitCount", "biCompression", "biSizeImage", "biXPelsPerMeter", "biYPelsPerMeter", "biClrUsed", "biClrImportant")
ERRORS = {"BMP_FILE_NOT_OPENED": -4, "BMP_HEADER_NOT_INITIALIZED": -3, "BMP_INVALID_FILE": -2, "BMP_ERROR": -1, "BMP_OK": 0}

HEADER_SCHEMA = "struct<bfSize:long,bfReserved:long,bfOffBits:long,biSize:long,biWidth:int,biHeight:int,biPlanes:int,biBitCount:int,biCompression:long,biSizeImage:long,biXPelsPerMeter:int,biYPelsPerMeter:int,biClrUsed:long,biClrImportant:long>"
IMAGE_SCHEMA = f"path string, header {HEADER_SCHEMA}, width int, height int, data binary, error int"
BAND_SCHEMA = "img string, band int, y0 int, n int, width int, height int, halo_top int, data binary"


class BmpError(ValueError):
    """A file that cannot be decoded; ``code`` is one of ERRORS."""

    def __init__(self, name: str, text: str):
        super().__init__(f"{name}: {text}")
        self.code = ERRORS[name]


def stride(width: int) -> int:
    return (3 * width + 3) // 4 * 4


def default_header(width: int, height: int, legacy_size: bool = False) -> dict[str, int]:
    """Header of a written file; ``legacy_size`` leaves the 54 header bytes out of bfSize."""
    pixels = stride(width) * abs(height)
    values = dict.fromkeys(HEADER_FIELDS, 0)
    return values | {"bfSize": pixels + (0 if legacy_size else HEADER.size), "bfOffBits": HEADER.size, "biSize": 40, "biWidth": width, "biHeight": height, "biPlanes": 1, "biBitCount": 24}


def decode_header(content: bytes) -> dict[str, int]:
    if len(content) < HEADER.size:
        raise BmpError("BMP_INVALID_FILE", "shorter than a header")
    magic, *values = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise BmpError("BMP_INVALID_FILE", "wrong magic")
    header = dict(zip(HEADER_FIELDS, values, strict=True))
    if header["biBitCount"] != 24 or header["biCompression"]:
        raise BmpError("BMP_INVALID_FILE", "only 24 bits without compression")
    if header["biWidth"] < 1 or header["biHeight"] == 0:
        raise BmpError("BMP_INVALID_FILE", "no pixels")
    return header


def decode(content: bytes) -> tuple[dict[str, int], np.ndarray]:
    """Header and top-down pixels, height x width x (b, g, r)."""
    header = decode_header(content)
    width, height = header["biWidth"], abs(header["biHeight"])
    step, at = stride(width), header["bfOffBits"]
    if len(content) < at + step * (height - 1) + 3 * width:
        raise BmpError("BMP_ERROR", "pixels are cut off")
    raw = np.frombuffer(content[at : at + step * height].ljust(step * height, b"\0"), dtype=np.uint8).reshape(height, step)
    rows = raw[:, : 3 * width].reshape(height, width, 3)
    return header, rows[::-1] if header["biHeight"] > 0 else rows


def encode(pixels: np.ndarray, legacy_size: bool = False) -> bytes:
    height, width, _ = pixels.shape
    header = default_header(width, height, legacy_size)
    raw = np.zeros((height, stride(width)), dtype=np.uint8)
    raw[:, : 3 * width] = pixels[::-1].reshape(height, 3 * width)
    return HEADER.pack(MAGIC, *(header[f] for f in HEADER_FIELDS)) + raw.tobytes()


def decode_files(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """``binaryFile`` rows to images; works on streams too."""
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode {mode!r}")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    header, pixels = decode(content)
                    out.append((path, header, header["biWidth"], abs(header["biHeight"]), pixels.tobytes(), ERRORS["BMP_OK"]))
                except BmpError as e:
                    if mode == "FAILFAST":
                        raise
                    if mode == "PERMISSIVE":
                        out.append((path, None, None, None, None, e.code))
            yield pd.DataFrame(out, columns=["path", "header", "width", "height", "data", "error"]).astype({"width": "Int32", "height": "Int32", "error": "int32"})

    return files.select("path", "content").mapInPandas(each, IMAGE_SCHEMA)


def read_images(spark: SparkSession, paths: str | list[str], mode: str = "PERMISSIVE") -> DataFrame:
    """One row an image; for images that fit a task. Large ones: the ``bmp`` data source."""
    return decode_files(spark.read.format("binaryFile").load(paths), mode)


def header_columns(files: DataFrame) -> DataFrame:
    """Width and height straight from the bytes, without Python: little-endian words at 18 and 22."""

    def word(at: int) -> F.Column:
        unsigned = F.conv(F.hex(F.reverse(F.substring("content", at + 1, 4))), 16, 10).cast("long")
        return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned).cast("int")

    magic = F.hex(F.substring("content", 1, 2)) == F.lit("424D")
    return files.select("path", F.when(magic, word(18)).alias("width"), F.when(magic, F.abs(word(22))).alias("height"), magic.alias("valid"))


def images_to_pixels(images: DataFrame) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for img, width, height, data in zip(pdf["path"], pdf["width"], pdf["height"], pdf["data"], strict=True):
                flat = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
                y, x = np.divmod(np.arange(int(width) * int(height), dtype=np.int32), int(width))
                yield pd.DataFrame({"img": img, "y": y, "x": x, "b": flat[:, 0], "g": flat[:, 1], "r": flat[:, 2]})

    return images.where("data is not null").select("path", "width", "height", "data").mapInPandas(each, PIXEL_SCHEMA)


def pixels_to_images(pixels: DataFrame, legacy_size: bool = False) -> DataFrame:
    """img, content: BMP bytes of every image, gathered by image (whole images only; bands write themselves)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, 3), dtype=np.uint8)
        block[pdf["y"], pdf["x"]] = pdf[list(CHANNELS)].to_numpy(dtype=np.uint8)
        return pd.DataFrame({"img": [pdf["img"].iloc[0]], "content": [encode(block, legacy_size)]})

    return pixels.select("img", "y", "x", *CHANNELS).groupBy("img").applyInPandas(one, "img string, content binary")


def output_name(source: str, how: str, output: str | None = None) -> str:
    """Name of a result: the caller's, or a prefix that tells how it was made."""
    prefixes = {"mpi": "mpi_out_", "gpu": "gpu_out_", "threads": "rcon_out_", "sequential": "seq_out_", "queue": "qmt_out_"}
    if how == "queue":
        return f"{prefixes[how]}{output + '_' if output else ''}{source}"
    return output or f"{prefixes[how]}{source}"


def below(path: F.Column, folder: str) -> F.Column:
    """A file's path below a folder; the name alone where it stands elsewhere."""
    plain = lambda c: F.regexp_replace(c, "^[a-zA-Z][a-zA-Z0-9+.-]*:/{0,2}(?=/)", "")
    top = F.concat(plain(F.lit(folder.rstrip("/"))), F.lit("/"))
    return F.when(F.startswith(plain(path), top), F.substring(plain(path), F.length(top) + 1, F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))


def prefixed(name: F.Column, prefix: str) -> F.Column:
    """The prefix before the last part of a path."""
    parts = F.split(name, "/")
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.concat(F.lit(prefix), F.element_at(parts, -1)))), "/")


def write_images(images: DataFrame, folder: str) -> None:
    """``img, content`` to files, on the executors; ``folder`` is one that all of them share."""
    images.select("img", "content").write.format("bmp").mode("append").save(folder)


@dataclass
class Band(InputPartition):
    path: str
    band: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class BmpReader(DataSourceReader):
    """Plans row bands from headers alone; a task seeks to its rows and halo, so no pixel is shuffled."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rows = int(options.get("bandRows", 256))
        self.halo = int(options.get("halo", 0))
        self.wrap = options.get("edge", "clamp") == "wrap"

    def _files(self) -> list[str]:
        """Paths below the folder that is read, or the one file's name: images are known by them."""
        if os.path.isdir(self.path):
            return sorted(os.path.relpath(os.path.join(top, f), self.path) for top, _, names in os.walk(self.path) for f in names if f.endswith(".bmp"))
        return [os.path.basename(self.path)]

    def _place(self, name: str) -> str:
        return os.path.join(self.path if os.path.isdir(self.path) else os.path.dirname(self.path), name)

    def partitions(self) -> list[Band]:
        made = []
        for path in self._files():
            with open(self._place(path), "rb") as f:
                height = abs(decode_header(f.read(HEADER.size))["biHeight"])
            made += [Band(path, k) for k in range(-(-height // self.rows))]
        return made

    def read(self, partition: Band) -> Iterator[tuple]:
        with open(self._place(partition.path), "rb") as f:
            header = decode_header(f.read(HEADER.size))
            width, height, step = header["biWidth"], abs(header["biHeight"]), stride(header["biWidth"])
            y0 = partition.band * self.rows
            n = min(self.rows, height - y0)
            wanted = np.arange(y0 - self.halo, y0 + n + self.halo)
            wanted = wanted % height if self.wrap else np.clip(wanted, 0, height - 1)
            stored = height - 1 - wanted if header["biHeight"] > 0 else wanted
            lines: dict[int, bytes] = {}
            lo, hi = int(stored.min()), int(stored.max())
            if hi - lo + 1 <= len(stored):  # one run of the file
                f.seek(header["bfOffBits"] + lo * step)
                run = f.read((hi - lo + 1) * step)
                lines = {lo + k: run[k * step : k * step + 3 * width] for k in range(hi - lo + 1)}
            else:
                for at in sorted(set(stored.tolist())):
                    f.seek(header["bfOffBits"] + at * step)
                    lines[at] = f.read(3 * width)
        if any(len(v) != 3 * width for v in lines.values()):
            raise BmpError("BMP_ERROR", "pixels are cut off")
        yield (partition.path, partition.band, y0, n, width, height, self.halo, b"".join(lines[at] for at in stored.tolist()))


class BmpWriter(DataSourceWriter):
    """``img, content`` rows become files; a file gets its name only when it is whole."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        done = []
        for row in rows:
            name = os.path.normpath("/" + row["img"]).lstrip("/")  # folders are kept, and never left
            path = os.path.join(self.folder, name if name.endswith(".bmp") else f"{name}.bmp")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            os.replace(part, path)
            done.append(path)
        return Written(done)


class BmpSource(DataSource):
    """``spark.read.format("bmp")``: options ``bandRows``, ``halo``, ``edge`` (clamp or wrap)."""

    @classmethod
    def name(cls) -> str:
        return "bmp"

    def schema(self) -> str:
        return BAND_SCHEMA

    def reader(self, schema) -> BmpReader:
        return BmpReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BmpWriter:
        return BmpWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BmpSource)


def read_bands(spark: SparkSession, path: str, rows: int = 256, halo: int = 0, wrap: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("bmp").option("bandRows", rows).option("halo", halo).option("edge", "wrap" if wrap else "clamp").load(path)


def bands_to_image(bands: DataFrame) -> DataFrame:
    """img, content from filtered bands (halo_top 0), joined in row order."""
    gathered = bands.groupBy("img", "width", "height").agg(F.array_sort(F.collect_list(F.struct("y0", "data"))).alias("p"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = []
            for width, height, parts in zip(pdf["width"], pdf["height"], pdf["p"], strict=True):
                whole = b"".join(p["data"] for p in parts)
                content.append(encode(np.frombuffer(whole, dtype=np.uint8).reshape(height, width, 3)))
            yield pd.DataFrame({"img": pdf["img"], "content": content})

    return gathered.mapInPandas(each, "img string, content binary")
