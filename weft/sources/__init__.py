"""Scans of rasters, tables and catalogues, and their sinks."""

from __future__ import annotations

import io
import traceback
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.discovery import has_suffix, last_wins, stem
from weft.operators.labels import Vocabulary, duplicates, normalized
from weft.session import stored
from weft.sources.rasters import write_planes

#: Suffixes of image files.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".ppm", ".bmp"]


def list_images(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(path, length) of the image files below a folder, by path; the files' contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    files = files.filter(has_suffix(F.col("path"), IMAGE_SUFFIXES)).orderBy("path")
    return files if most is None else files.limit(most)


#: Pixels of one batch that a scan hands on.
BLOCK = 1 << 18


def _blocks(height: int, width: int):
    """(from, to) of stretches of rows of about ``BLOCK`` pixels."""
    each = max(1, BLOCK // max(1, width))
    return ((lo, min(height, lo + each)) for lo in range(0, height, each))


def image_pixels(spark: SparkSession, folder: str, drop_unreadable: bool = True) -> DataFrame:
    """(path, row, col, b, g, r) of PNG and JPEG files, decoded by Spark; grey images have three equal values.

    A folder without images is an error, and so is an image that cannot be read unless such are dropped. An image is
    handed on in blocks of rows, so its pixels are never all held as rows.
    """
    if list_images(spark, folder).isEmpty():
        raise ValueError(f"no images in {folder}")
    images = spark.read.format("image").option("dropInvalid", drop_unreadable).option("recursiveFileLookup", True).load(folder).select("image.*")

    def decode(batches):
        for batch in batches:
            for one in (batch.slice(k, 1) for k in range(len(batch))):
                path, height, width, channels, data = (c[0].as_py() for c in one.columns)
                if height <= 0:
                    raise ValueError(f"cannot read {path}")
                px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                for lo, hi in _blocks(height, width):
                    n = (hi - lo) * width
                    rows, cols = np.divmod(np.arange(n) + lo * width, width)
                    bgr = [px[lo:hi, :, min(k, channels - 1)].ravel().astype("i4") for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(rows.astype("i4")), pa.array(cols.astype("i4")), *map(pa.array, bgr)], ["path", "row", "col", "b", "g", "r"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInArrow(decode, "path string, row int, col int, b int, g int, r int")


def _plane(content: bytes, name: str) -> np.ndarray:
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(a, np.lib.npyio.NpzFile):
        a = a[a.files[0]]
    if a.ndim != 2 or not a.size or not np.isfinite(a.astype(float)).all():
        raise ValueError(f"not a finite, non-empty plane: shape {a.shape}")
    return a


def array_pixels(spark: SparkSession, folder: str, glob: str = "*.np[yz]") -> DataFrame:
    """(name, row, col, value, error, error_type, traceback) of two-dimensional .npy files, or the first array of .npz files.

    A file that cannot be read is one row with its error. Arrays are handed on in blocks of rows.
    """

    def decode(frames):
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                try:
                    a = _plane(content, name)
                except (ValueError, OSError, EOFError, IndexError, zipfile.BadZipFile) as why:
                    yield pd.DataFrame({"name": [name], "row": pd.array([None], "Int32"), "col": pd.array([None], "Int32"), "value": [None], "error": [str(why)[:4000]], "error_type": [type(why).__name__], "traceback": [traceback.format_exc()[-4000:]]})
                    continue
                for lo, hi in _blocks(*a.shape):
                    r, c = np.indices((hi - lo, a.shape[1]))
                    yield pd.DataFrame({"name": name, "row": (r.ravel() + lo).astype("int32"), "col": c.ravel().astype("int32"), "value": a[lo:hi].ravel().astype(float), "error": None, "error_type": None, "traceback": None})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select(stem(F.col("path")).alias("name"), "content").mapInPandas(decode, "name string, row int, col int, value double, error string, error_type string, traceback string")


def scores_and_masks(prob: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per image what there is of scores and mask, and the images whose two rasters differ in shape.

    Rows: image, row, col, ... of full rasters. First: image, prob_available, mask_available, height, width. Second: image, error.
    """
    shape = lambda rows, k: rows.groupBy("image").agg((F.max("row") + 1).alias(f"{k}_height"), (F.max("col") + 1).alias(f"{k}_width"))
    at = shape(prob, "prob").join(shape(masks, "mask"), "image", "full")
    unequal = (F.col("prob_height") != F.col("mask_height")) | (F.col("prob_width") != F.col("mask_width"))
    message = F.format_string("scores are %d x %d, mask is %d x %d", "prob_height", "prob_width", "mask_height", "mask_width")
    held = at.select("image", F.col("prob_height").isNotNull().alias("prob_available"), F.col("mask_height").isNotNull().alias("mask_available"), F.coalesce("prob_height", "mask_height").alias("height"), F.coalesce("prob_width", "mask_width").alias("width"), unequal.alias("__bad"), message.alias("error"))
    return held.filter("not coalesce(__bad, false)").drop("__bad", "error"), held.filter("__bad").select("image", "error")


def read_review(spark: SparkSession, path, required: list[str]) -> DataFrame:
    """Review tables (CSV, one or several) as text; a missing column is an error."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows


#: Columns of a feature table that are text; all others are numbers.
TEXT_COLUMNS = ("image_id", "panel_id", "label", "label_reason")


def read_features(spark: SparkSession, path: str, text: tuple = TEXT_COLUMNS) -> DataFrame:
    """A feature table, Parquet or CSV by its suffix; where the Parquet one is missing, the CSV beside it. Ids are text."""
    if not path.endswith(".csv"):
        try:
            rows = spark.read.parquet(path)
            return rows.withColumns({c: F.col(c).cast("string") for c in text if c in rows.columns})
        except AnalysisException as why:
            if why.getCondition() != "PATH_NOT_FOUND":
                raise
            path = path.removesuffix(".parquet") + ".csv"
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` {'string' if c in text else 'double'}" for c in names)
    return spark.read.option("header", True).option("nanValue", "").schema(schema).csv(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, panel_id) of a mapping table: required columns, blanks left out, the last row of an image by line."""
    rows = read_review(spark, path, ["image_id", "panel_id"]).withColumn("__line", F.monotonically_increasing_id())
    return last_wins(rows, "image_id", "panel_id", "__line")


def read_annotations(spark: SparkSession, path, words: Vocabulary, keys: tuple = ("image_id", "edge_id"), most: int = 20) -> DataFrame:
    """Keys and label of a review table; labels outside the vocabulary and keys that occur twice are one error with the
    first ``most`` of them."""
    rows = read_review(spark, path, [*keys, "label"]).withColumn("__label", normalized(F.col("label"), words))
    key = F.concat_ws("/", *(F.trim(k) for k in keys))
    bad = rows.filter("__label is null").select(F.concat(key, F.lit(": no label "), F.col("label")).alias("m"))
    twice = duplicates(rows.select(*(F.trim(k).alias(k) for k in keys)), list(keys)).select(F.concat(F.concat_ws("/", *keys), F.lit(": occurs "), F.col("n"), F.lit(" times")).alias("m"))
    messages = [r["m"] for r in bad.unionByName(twice).orderBy("m").limit(most).collect()]
    if messages:
        raise ValueError("; ".join(messages))
    return rows.select(*(F.trim(k).alias(k) for k in keys), F.col("__label").alias("label"))


def write_graph(nodes: DataFrame, edges: DataFrame, paths: DataFrame, path: str, config: str) -> None:
    """A graph archive: three tables, a folder for each configuration."""
    for name, rows in (("nodes", nodes), ("edges", edges), ("paths", paths)):
        write_by_config(rows.withColumn("config_hash", F.lit(config)), f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, config: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}").filter(F.col("config_hash") == config).drop("config_hash") for name in ("nodes", "edges", "paths"))


def packed(mask: DataFrame) -> DataFrame:
    """(image, row, start, length): a mask's runs of pixels, a row at a time."""
    w = Window.partitionBy("image", "row").orderBy("col")
    at = mask.select("image", "row", "col").distinct().withColumn("run", F.col("col") - F.row_number().over(w))
    return at.groupBy("image", "row", "run").agg(F.min("col").alias("start"), F.count("*").cast("int").alias("length")).drop("run")


def unpacked(runs: DataFrame) -> DataFrame:
    """The mask of packed runs."""
    return runs.select("image", "row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("col"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions as CSV, a folder an image."""
    predictions.write.mode("overwrite").partitionBy("image_id").option("header", True).csv(path)


def write_rasters(pixels: DataFrame, path: str, height: int, width: int, value: str = "value", empty: int = 0) -> DataFrame:
    """(image, path) of one .npy file an image, which appear when all are written. path must be reachable from all executors."""
    images = stored(pixels.select(F.col("image").cast("string").alias("image")).distinct(), "images")
    write_planes(pixels, images.withColumns({"height": F.lit(height), "width": F.lit(width)}), path, (value,), empty=empty)
    return images.select("image", F.concat(F.lit(f"{path}/"), "image", F.lit(".npy")).alias("path"))


def write_summary(rows: DataFrame, path: str) -> None:
    """One row an image as JSON lines and as CSV, in the folders ``json`` and ``csv`` of a path; few rows, so one file each."""
    one = stored(rows, "summary").orderBy("image").coalesce(1)
    one.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


#: What tells some readers that a text is UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def write_table_with_mark(rows: DataFrame, path: str) -> None:
    """A table as one CSV text whose first character is a byte order mark, for spreadsheet programs. Fields are quoted where they must be."""
    cell = lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *(F.coalesce(cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns))
    head = rows.sparkSession.createDataFrame([(0, BYTE_ORDER_MARK + ",".join(rows.columns))], "part int, value string")
    lines = rows.select((F.spark_partition_id() + 1).alias("part"), line.alias("value")).withColumn("at", F.monotonically_increasing_id())
    stored(head.withColumn("at", F.lit(0).cast("long")).unionByName(lines), "lines").orderBy("part", "at").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_by_config(rows: DataFrame, path: str) -> None:
    """Parquet, a folder for each config_hash; other configurations stay."""
    rows.write.mode("append").partitionBy("config_hash").parquet(path)


def journal(rows: DataFrame, stage: str, path: str) -> None:
    """Appends the rows that carry an error to a JSON journal."""
    bad = rows.filter("error is not null")
    bad.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.col("name").alias("image_id"), F.lit(stage).alias("stage"), *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("error_type", "traceback")), F.substring("error", 1, 4000).alias("message")).write.mode("append").json(path)


def write_review(edges: DataFrame, path: str) -> None:
    """A review table with blank label, confidence and notes for people to fill in."""
    blank = [F.lit("").alias(c) for c in ("label", "confidence", "notes")]
    edges.select("image_id", "panel_id", "component_id", "edge_id", *blank, "length_px", "row", "col").write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def merge_reviews(spark: SparkSession, paths: list[str], to: str) -> None:
    """Several review tables as one."""
    read_review(spark, paths, ["image_id", "edge_id", "label"]).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(to)
