"""Inference of probability maps from overlapping tiles of images of any size.

Pixels are packed into square cells of a stride's side; each tile gathers the few cells it covers. Tiles are scored in
batches by a model that is made once a task, and the overlapping scores become weighted means. No task holds an image.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import hann
from weft.operators import raster
from weft.operators.kernels import _kind
from weft.operators.raster import PIXEL

CHANNELS = ("b", "g", "r")


def cells(planes: DataFrame, side: int) -> DataFrame:
    """(image, cr, cc, data): the pixels of square cells as bytes, blue, green, red."""
    at = planes.select(*PIXEL, *CHANNELS).withColumn("cr", F.floor(F.col("row") / side)).withColumn("cc", F.floor(F.col("col") / side))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        image, cr, cc = (k.as_py() for k in key)
        data = np.zeros((side, side, 3), np.uint8)
        place = rows["row"].to_numpy() - cr * side, rows["col"].to_numpy() - cc * side
        for k, c in enumerate(CHANNELS):
            data[(*place, k)] = rows[c].to_numpy()
        return pa.table({"image": pa.array([image], rows.schema.field("image").type), "cr": pa.array([cr], pa.int64()), "cc": pa.array([cc], pa.int64()), "data": [data.tobytes()]})

    return at.groupBy("image", "cr", "cc").applyInArrow(pack, f"image {_kind(planes, 'image')}, cr long, cc long, data binary")


def tiles(planes: DataFrame, frames: DataFrame, tile: int, stride: int) -> DataFrame:
    """(image, y, x, height, width, pixels): the overlapping tiles of images, red, green and blue from -1 to 1, flat.

    frames: image, height, width. An image smaller than a tile is mirrored on at its lower and right side, without repeating
    the last pixel; the last tile of an axis ends with the image.
    """
    origin = lambda c: F.explode(raster.tile_origins(F.col(c), tile, stride))
    at = frames.select("image", "height", "width", origin("height").alias("y")).withColumn("x", origin("width"))
    reach = lambda o: F.explode(F.sequence(F.floor(F.col(o) / stride), F.floor((F.col(o) + tile - 1) / stride)))
    wants = at.withColumn("cr", reach("y")).withColumn("cc", reach("x"))
    met = wants.join(cells(planes, stride), ["image", "cr", "cc"]).select("image", "y", "x", "height", "width", "cr", "cc", "data")

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        image, y, x = (k.as_py() for k in key)
        h, w = (min(tile, rows[c][0].as_py() - o) for c, o in (("height", y), ("width", x)))
        first = rows["cr"].to_numpy().min(), rows["cc"].to_numpy().min()
        many = [rows[c].to_numpy().max() - f + 1 for c, f in zip(("cr", "cc"), first, strict=True)]
        held = np.zeros((many[0] * stride, many[1] * stride, 3), np.uint8)
        for r, c, data in zip(rows["cr"].to_numpy(), rows["cc"].to_numpy(), rows["data"], strict=True):
            i, j = (r - first[0]) * stride, (c - first[1]) * stride
            held[i : i + stride, j : j + stride] = np.frombuffer(data.as_buffer(), np.uint8).reshape(stride, stride, 3)
        cut = held[y - first[0] * stride :, x - first[1] * stride :][:h, :w]
        cut = np.pad(cut, ((0, tile - h), (0, tile - w), (0, 0)), "reflect") if cut.shape[:2] != (tile, tile) else cut
        scaled = (cut[:, :, ::-1].astype("f4") / 255 - 0.5) / 0.5
        return pa.table({"image": pa.array([image], rows.schema.field("image").type), "y": pa.array([y], pa.int32()), "x": pa.array([x], pa.int32()), **{c: pa.array([rows[c][0].as_py()], pa.int32()) for c in ("height", "width")}, "pixels": pa.array([scaled.ravel()], pa.list_(pa.float32()))})

    return met.groupBy("image", "y", "x").applyInArrow(gather, f"image {_kind(planes, 'image')}, y int, x int, height int, width int, pixels array<float>")


def _scored(make: Callable, flips: bool):
    """make() with its logits averaged over the tile as it is, mirrored sideways and mirrored upside down, then as probabilities."""

    def made():
        model = make()

        def predict(pixels: np.ndarray) -> np.ndarray:
            logits = model(pixels)
            if flips:
                for axis in (2, 1):
                    logits = logits + np.flip(model(np.flip(pixels, axis)), axis)
                logits = logits / 3
            return (1 / (1 + np.exp(-logits.astype(float)))).astype("f4").reshape(len(pixels), -1)

        return predict

    return made


def inferred(planes: DataFrame, frames: DataFrame, make: Callable, tile: int = 512, stride: int = 256, flips: bool = True, batch: int = 8) -> DataFrame:
    """(image, row, col, p) of every pixel of the frames.

    make() is called once a task and returns a model: logits (n, tile, tile) of tiles (n, tile, tile, 3).
    """
    if not 0 < stride <= tile:
        raise ValueError("tiles must touch: a stride of 1 to the tile's side")
    # a model that might answer differently is asked once: else the planner asks it again whether there are scores to explode
    score = predict_batch_udf(_scored(make, flips), return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[tile, tile, 3]]).asNondeterministic()
    at = tiles(planes, frames, tile, stride).select("image", "y", "x", "height", "width", score("pixels").alias("p"))
    at = at.select("image", "y", "x", "height", "width", F.posexplode("p").alias("i", "p")).withColumns({"r": F.floor(F.col("i") / tile).cast("int"), "c": (F.col("i") % tile).cast("int")})
    # a tile knows its image's frame, so that pixels meet by place only
    rows = at.select("image", "height", "width", (F.col("y") + F.col("r")).alias("row"), (F.col("x") + F.col("c")).alias("col"), F.col("p").cast("double").alias("p"), (hann(F.col("r"), tile) * hann(F.col("c"), tile)).alias("w"))
    return raster.blended(rows.filter("row < height and col < width"))
