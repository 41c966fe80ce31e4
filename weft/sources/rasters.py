"""Rasters as files that many tasks read and that appear only when they are whole.

``npy_bands`` is a source whose partitions are ranges of bytes, as of a text file: a task reads a file's header and then the
rows that begin in its range, so that one large plane is read by many tasks and small files share one. ``raster_files`` is a
sink: rows of an image come in order and are written as a stream (.npy, or PNG by zlib) under a temporary name; the files
are renamed when all tasks are done, and go when one fails. Both reach files through ``pyarrow.fs``: a path may be local or
any address that it knows.
"""

from __future__ import annotations

import ast
import os
import struct
import uuid
import zlib
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weft.operators.discovery import stem
from weft.session import dealt, stored

#: Bytes that one task reads at least, unless there are fewer, and pixels in one batch.
BAND_BYTES = 32 << 20
BLOCK = 1 << 18
PIXELS = "path string, row int, col int, value double, error string, error_type string"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


@dataclass
class Ranges(InputPartition):
    """(path, from byte, to byte) of the parts of files that one task reads."""

    parts: list


def header(file) -> tuple[tuple, bool, np.dtype, int]:
    """Shape, whether columns come first, type and where the data begins, of an open .npy file."""
    head = file.read(8)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    size = struct.unpack("<H", file.read(2))[0] if head[6] == 1 else struct.unpack("<I", file.read(4))[0]
    said = ast.literal_eval(file.read(size).decode("latin1" if head[6] < 3 else "utf8"))
    return said["shape"], said["fortran_order"], np.dtype(said["descr"]), file.tell()


def band(system: fs.FileSystem, path: str, lo: int, hi: int):
    """(rows, cols, values) blocks of the lines that begin between bytes lo and hi of the data of a file."""
    with system.open_input_file(path) as file:
        shape, by_columns, kind, begin = header(file)
        if len(shape) != 2 or 0 in shape or kind.hasobject or kind.kind not in "biuf":
            raise ValueError(f"not a plane of numbers: shape {shape}, type {kind}")
        lines, length = shape[::-1] if by_columns else shape
        each = length * kind.itemsize
        if file.size() < begin + lines * each:
            raise EOFError(f"{file.size()} bytes, {begin + lines * each} are said to be there")
        first, last = (min(lines, max(0, -(-(at - begin) // each))) for at in (lo, hi))
        step = max(1, BLOCK // length)
        for at in range(first, last, step):
            many = min(step, last - at)
            file.seek(begin + at * each)
            block = np.frombuffer(file.read(many * each), kind).astype(float)
            if not np.isfinite(block).all():
                raise ValueError(f"values that are not finite in lines {at} to {at + many - 1}")
            across, along = np.divmod(np.arange(many * length), length)
            yield (along, across + at, block) if by_columns else (across + at, along, block)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("pathGlobFilter", "*.npy")
        self.size = int(options.get("bandBytes", BAND_BYTES))

    def partitions(self):
        """Files cut into ranges of ``bandBytes``; small ones are put together up to as much."""
        system, path = filesystem(self.path)
        at = system.get_file_info(path)
        files = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out, held, size = [], [], 0
        for file in sorted((f for f in files if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob)), key=lambda f: f.path):
            for lo in range(0, max(1, file.size), self.size):
                hi = min(lo + self.size, file.size)
                if held and size + hi - lo > self.size:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((file.path, lo, hi))
                size += hi - lo
        return [*out, Ranges(held)]

    def read(self, partition):
        system, _ = filesystem(self.path)
        schema = pa.schema([("path", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.float64()), ("error", pa.string()), ("error_type", pa.string())])
        for path, lo, hi in partition.parts:
            try:
                for rows, cols, values in band(system, path, lo, hi):
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(rows.astype("i4")), pa.array(cols.astype("i4")), pa.array(values), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], schema=schema)
            except (ValueError, OSError, EOFError, SyntaxError, struct.error) as why:
                yield pa.RecordBatch.from_pylist([{"path": path, "error": str(why)[:4000], "error_type": type(why).__name__}], schema=schema)


class NpyBands(DataSource):
    """Planes of .npy files as pixels. Options: path, pathGlobFilter, bandBytes. What can't be read is a row with its error."""

    @classmethod
    def name(cls):
        return "npy_bands"

    def schema(self):
        return PIXELS

    def reader(self, schema):
        return NpyReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final paths of the files of one task."""

    files: list


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


class Stream:
    """A raster file that is written line by line; lines that are left out are ``empty``."""

    def __init__(self, file, kind: str, dtype: np.dtype, height: int, width: int, channels: int, empty: float):
        self.file, self.png, self.dtype, self.shape, self.next = file, kind == "png", dtype, (height, width, channels), 0
        self.blank = np.full((width, channels), empty, dtype)
        if self.png:
            if channels not in (1, 3) or dtype != np.uint8:
                raise ValueError("PNG files have one or three channels of bytes")
            self.packer = zlib.compressobj()
            file.write(b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)))
        else:
            shape = (height, width) if channels == 1 else (height, width, channels)
            np.lib.format.write_array_header_1_0(file, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})

    def _line(self, cells: np.ndarray):
        self.next += 1
        if not self.png:
            self.file.write(cells.tobytes())
        # channels come as blue, green, red; each line of a PNG begins with its filter: none
        elif data := self.packer.compress(b"\0" + cells[:, ::-1].tobytes()):
            self.file.write(png_chunk(b"IDAT", data))

    def line(self, row: int, cols, values):
        height, width, channels = self.shape
        if not self.next <= row < height:
            raise ValueError(f"row {row} out of order or outside of {height}")
        while self.next < row:
            self._line(self.blank)
        cells = self.blank.copy()
        cells[np.asarray(cols, np.int64)] = np.asarray(values, float).reshape(-1, channels)
        self._line(cells)

    def close(self):
        while self.next < self.shape[0]:
            self._line(self.blank)
        if self.png:
            self.file.write(png_chunk(b"IDAT", self.packer.flush()) + png_chunk(b"IEND", b""))
        self.file.close()


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind, self.suffix = options["path"], options.get("kind", "npy"), options.get("suffix", "")
        self.dtype, self.channels, self.empty = np.dtype(options.get("dtype", "uint8")), int(options.get("channels", 1)), float(options.get("empty", 0))
        self.temporary = f"{filesystem(self.path)[1]}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        """One file for each run of rows of an image, under names that no other attempt uses."""
        system, path = filesystem(self.path)
        mine, files, image, out = f"{self.temporary}/{uuid.uuid4().hex}", [], None, None
        system.create_dir(mine, recursive=True)
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or r["image"] != image:
                    if out:
                        out.close()
                    image, name = r["image"], f"{r['image']}{self.suffix}.{self.kind}"
                    if image in ("", ".", "..") or "/" in image:
                        raise ValueError(f"no name of a file: {image!r}")
                    files.append((f"{mine}/{name}", f"{path}/{name}"))
                    out = Stream(system.open_output_stream(files[-1][0]), self.kind, self.dtype, r["height"], r["width"], self.channels, self.empty)
                if r["row"] is not None:
                    out.line(r["row"], r["cols"], r["values"])
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, _ = filesystem(self.path)
        for message in messages:
            for held, final in message.files if message else []:
                system.move(held, final)
        self._clear(system)

    def abort(self, messages):
        self._clear(filesystem(self.path)[0])

    def _clear(self, system):
        if system.get_file_info(self.temporary).type == fs.FileType.Directory:
            system.delete_dir(self.temporary)


class RasterFiles(DataSource):
    """Sink of image lines (image, height, width, row, cols, values), which come image by image and in order of rows.

    Options: path, kind (npy or png), dtype, channels, empty, suffix (of names, before the kind's own).
    """

    @classmethod
    def name(cls):
        return "raster_files"

    def writer(self, schema, overwrite):
        return RasterWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NpyBands)
    spark.dataSource.register(RasterFiles)
    return spark


def npy_pixels(spark: SparkSession, path: str, glob: str = "*.npy", band_bytes: int = BAND_BYTES) -> DataFrame:
    """(path, name, row, col, value, error, error_type) of the planes below a path, read by many tasks.

    A file that can't be read is a row with its error, one for each range of it.
    """
    rows = registered(spark).read.format("npy_bands").option("pathGlobFilter", glob).option("bandBytes", band_bytes).load(path)
    return rows.select("path", stem(F.col("path")).alias("name"), "row", "col", "value", "error", "error_type")


def first_channel(spark: SparkSession, folder: str) -> DataFrame:
    """(name, row, col, value) of all planes of a folder: .npy files, and the first channel of images."""
    from weft.sources import image_pixels, list_images

    arrays = npy_pixels(spark, folder).filter("error is null").select("name", "row", "col", "value")
    if list_images(spark, folder).isEmpty():
        return arrays
    images = image_pixels(spark, folder, drop_unreadable=False)
    return arrays.unionByName(images.select(stem(F.col("path")).alias("name"), "row", "col", F.col("b").cast("double").alias("value")))


def with_images(records: DataFrame, images: DataFrame, key: str = "name") -> DataFrame:
    """records with (height, width) of their image and ``image_available``; a record without an image stays, with none."""
    shapes = images.groupBy(key).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return records.join(shapes, key, "left").withColumn("image_available", F.col("height").isNotNull())


def label_pixels(spark: SparkSession, folder: str, background: int = 0) -> DataFrame:
    """(name, row, col, label) of label rasters, whole numbers only; background is left out."""
    at = first_channel(spark, folder)
    whole = F.when(F.col("value") == F.rint("value"), F.col("value").cast("long"))
    label = F.coalesce(whole, F.raise_error(F.concat_ws(" ", F.lit("not a label:"), F.col("name"), F.col("value").cast("string"))).cast("long"))
    return at.select("name", "row", "col", label.alias("label")).filter(F.col("label") != background)


def batches(rows: DataFrame, key: str, size: int, seed: int | None = None) -> DataFrame:
    """rows with ``batch``: numbers of batches of ``size`` rows, by key, or shuffled by a hash of key and seed.

    Rows are sorted by ranges; each range's rows are counted, and what lies before is added: a number a partition.
    """
    order = F.col(key) if seed is None else F.xxhash64(F.col(key), F.lit(seed))
    ranged = rows.withColumn("__order", order).repartitionByRange("__order", key).sortWithinPartitions("__order", key)
    at = stored(ranged.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "batches")
    counts, before, offsets = sorted(tuple(r) for r in at.groupBy("__part").agg(F.count("*")).collect()), 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    starts = at.sparkSession.createDataFrame(offsets, "__part int, __before long")
    return at.join(F.broadcast(starts), "__part").withColumn("batch", F.expr(f"(__before + __place) div {int(size)}")).drop("__part", "__place", "__before", "__order")


def write_planes(pixels: DataFrame, frames: DataFrame, path: str, values: tuple = ("value",), kind: str = "npy", dtype: str = "uint8", empty: float = 0, suffix: str = "") -> None:
    """A file ``path``/image+suffix.kind for every row of frames (image, height, width), of its pixels (image, row, col, values).

    Three values are blue, green and red. Pixels that are left out are ``empty``. The rows of an image go through one task in
    order, a line at a time; a file appears when all are written.
    """
    cell = F.struct("col", *(F.col(v).cast("double").alias(f"__{k}") for k, v in enumerate(values)))
    lines = pixels.groupBy(F.col("image").cast("string").alias("image"), "row").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    flat = F.flatten(F.transform("cells", lambda x: F.array(*(x[f"__{k}"] for k in range(len(values))))))
    rows = frames.select(F.col("image").cast("string").alias("image"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")).join(lines, "image", "left")
    rows = rows.select("image", "height", "width", F.col("row").cast("int").alias("row"), F.transform("cells", lambda x: x["col"].cast("int")).alias("cols"), flat.alias("values"))
    out = dealt(rows, "image").sortWithinPartitions("image", "row")
    registered(pixels.sparkSession)
    out.write.format("raster_files").mode("append").options(path=path, kind=kind, dtype=dtype, channels=len(values), empty=empty, suffix=suffix).save()


def bytes_of(p) -> F.Column:
    """A probability as a byte."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * 255).cast("int")


def overlaid(planes: DataFrame, mask: DataFrame, share: float = 0.45) -> DataFrame:
    """planes (image, row, col, b, g, r) with the mask's pixels drawn in red, mixed in by ``share``."""
    at = planes.join(mask.select("image", "row", "col").distinct().withColumn("__in", F.lit(True)), ["image", "row", "col"], "left")
    mixed = lambda c, to: F.when(F.col("__in"), F.rint(F.col(c) * (1 - share) + to * share).cast("int")).otherwise(F.col(c))
    return at.select("image", "row", "col", *(mixed(c, to).alias(c) for c, to in (("b", 0), ("g", 0), ("r", 255))))


def write_inference(prob: DataFrame, frames: DataFrame, path: str, least: float, planes: DataFrame | None = None) -> None:
    """What a tile inference leaves for each image: probabilities and mask as arrays and as PNG, and the mask over the image."""
    mask = prob.filter(F.col("p") >= least).withColumn("one", F.lit(1))
    write_planes(prob, frames, path, ("p",), "npy", "float32", suffix="_prob")
    write_planes(mask, frames, path, ("one",), "npy", suffix="_mask")
    write_planes(prob.withColumn("v", bytes_of(F.col("p"))), frames, path, ("v",), "png", suffix="_prob")
    write_planes(mask.withColumn("v", F.lit(255)), frames, path, ("v",), "png", suffix="_mask")
    if planes is not None:
        write_planes(overlaid(planes, mask, 0.45), frames, path, ("b", "g", "r"), "png", suffix="_overlay")
