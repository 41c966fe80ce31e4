"""Raster operators on sparse pixel relations (image, row, col[, value]).

A neighbourhood is an offset table exploded on the scan side and joined by pixel key, so the work is spread over
pixels, not images, and an image may be larger than a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.components import connected_components
from weft.session import stored

PIXEL = ["image", "row", "col"]


def square(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r, c in square(radius) if r * r + c * c <= radius * radius]


def neighbours(connectivity: int = 8) -> list[tuple[int, int]]:
    """Half of the neighbourhood: each pair of touching pixels once."""
    return [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])


def _offsets(shape: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in shape)))


def shifted(pixels: DataFrame, shape: list[tuple[int, int]], keep: list[str] | None = None) -> DataFrame:
    """Each pixel once for every offset, moved by it."""
    at = pixels.withColumn("__o", _offsets(shape))
    return at.select("image", (F.col("row") + F.col("__o.r")).alias("row"), (F.col("col") + F.col("__o.c")).alias("col"), *(keep or []))


def weak_and_strong(prob: DataFrame, high: float, low: float) -> DataFrame:
    """Pixels of at least the lower threshold; strong ones reach the higher."""
    if not 0 <= low <= high <= 1:
        raise ValueError("thresholds must satisfy 0 <= low <= high <= 1")
    return prob.filter(F.col("p") >= low).withColumn("strong", F.col("p") >= high)


def pixel_id(pixels: DataFrame, row: str = "row", col: str = "col") -> Column:
    """A key for each pixel that orders an image's pixels by row and column, an error outside what it can hold.

    Images that are numbers (0 to 2^23 - 1) give numbers, 20 bits each for row and column; other images give text.
    Rows and columns are 0 to 2^20 - 1, so no two pixels share a key.
    """
    row, col, image = F.col(row), F.col(col), F.col("image")
    held = row.between(0, (1 << 20) - 1) & col.between(0, (1 << 20) - 1)
    if isinstance(pixels.schema["image"].dataType, T.IntegralType):
        key = F.shiftleft(image.cast("long"), 40).bitwiseOR(F.shiftleft(row.cast("long"), 20)).bitwiseOR(col.cast("long"))
        held = held & image.between(0, (1 << 23) - 1)
    else:
        place = lambda x: F.lpad(x.cast("string"), 7, "0")
        key = F.concat(image.cast("string"), F.lit(":"), place(row), F.lit(":"), place(col))
    return F.when(held, key).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no pixel key for"), image.cast("string"), row.cast("string"), col.cast("string"))))


#: Side of the tiles that components are found in before they are joined over tile borders.
TILE = 256


def tile_roots(tile: np.ndarray, row: np.ndarray, col: np.ndarray, connectivity: int) -> np.ndarray:
    """For each pixel the place of the least pixel (by row and column) that it hangs together with inside its tile.

    Labels go to the least of the neighbours' and then to that one's own, until nothing moves: all tiles at once.
    """
    top, left = row.min(), col.min()
    width = int(col.max() - left) + 3
    number = np.unique(tile, return_inverse=True)[1]
    key = (number * (int(row.max() - top) + 3) + (row - top) + 1) * width + (col - left) + 1
    keys, first, own = np.unique(key, return_index=True, return_inverse=True)
    a, b = [], []
    for r, c in neighbours(connectivity):
        want = keys + r * width + c
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        met = np.flatnonzero(keys[at] == want)
        a.append(met)
        b.append(at[met])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(keys))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b):
            np.minimum.at(new, x, least)
            np.minimum.at(new, label[x], least)
        while (further := new[new]).tobytes() != new.tobytes():
            new = further
        if (new == label).all():
            return first[label][own]
        label = new


def labelled(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """mask with component: the least pixel key of the component (see ``pixel_id``).

    Tiles are labelled each in one pass; only labels that meet over a tile's border go on to the joined search. Rows without
    an image or place are left out.
    """
    tiled = mask.withColumn("__tile", F.concat_ws(":", F.col("image").cast("string"), F.floor(F.col("row") / TILE).cast("string"), F.floor(F.col("col") / TILE).cast("string")))

    def roots(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (held["__tile"] == held["__tile"].iloc[-1]).to_numpy()
            if not last.all():
                yield found(held[~last])
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held)

    def found(frame):
        row, col = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
        at = tile_roots(frame["__tile"].to_numpy(), row, col, connectivity)
        return frame.drop(columns="__tile").assign(__row=row[at], __col=col[at])

    tiled = tiled.filter("image is not null and row is not null and col is not null")
    kinds = T.StructType([*mask.schema.fields, T.StructField("__row", T.LongType()), T.StructField("__col", T.LongType())])
    at = tiled.repartition("__tile").sortWithinPartitions("__tile").mapInPandas(roots, kinds)
    at = stored(at.withColumn("component", pixel_id(mask, "__row", "__col")).drop("__row", "__col"), "tiles")
    edge = lambda c: (F.col(c) % TILE == 0) | (F.col(c) % TILE == TILE - 1)
    rim = at.filter(edge("row") | edge("col")).select(*PIXEL, F.col("component").alias("src"))
    near = shifted(rim, neighbours(connectivity), ["src"])
    over = stored(near.join(rim.withColumnRenamed("src", "dst"), PIXEL).filter("src <> dst").select("src", "dst").distinct(), "borders")
    if over.isEmpty():
        return at
    whole = connected_components(over).select(F.col("id").alias("component"), F.col("component").alias("__whole"))
    return at.join(whole, "component", "left").withColumn("component", F.coalesce("__whole", "component")).select(*mask.columns, "component")


def hysteresis(prob: DataFrame, high: float, low: float, connectivity: int = 8) -> DataFrame:
    """Weak pixels whose component holds a strong one, with their component."""
    at = labelled(weak_and_strong(prob, high, low), connectivity)
    strong = at.groupBy("component").agg(F.bool_or("strong").alias("any")).filter("any").select("component")
    return at.join(strong, "component", "left_semi").select(*PIXEL, "p", "component")


def neighbour_count(mask: DataFrame) -> DataFrame:
    """How many of the 8 neighbours of each pixel are in the mask."""
    around = shifted(mask.select(*PIXEL), [o for o in square(1) if o != (0, 0)])
    counts = around.groupBy(*PIXEL).agg(F.count("*").alias("n"))
    return mask.select(*PIXEL).join(counts, PIXEL, "left").select(*PIXEL, F.coalesce("n", F.lit(0)).cast("int").alias("neighbours"))


def within(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return pixels.filter((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))


def dilate(mask: DataFrame, shape: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    return within(shifted(mask.select(*PIXEL), shape), height, width).distinct()


def erode(mask: DataFrame, shape: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Pixels all of whose neighbourhood inside the frame is in the mask."""
    inside = F.lit(0)
    for r, c in shape:
        inside = inside + ((F.col("row") + r >= 0) & (F.col("row") + r < height) & (F.col("col") + c >= 0) & (F.col("col") + c < width)).cast("int")
    hits = shifted(mask.select(*PIXEL), [(-r, -c) for r, c in shape]).groupBy(*PIXEL).agg(F.count("*").alias("hits"))
    return within(hits, height, width).filter(F.col("hits") == inside).select(*PIXEL)


def inside_of(mask: DataFrame, shape: list[tuple[int, int]]) -> DataFrame:
    """Pixels all of whose neighbourhood is in the mask, which has nothing beyond the frame."""
    hits = shifted(mask.select(*PIXEL).distinct(), [(-r, -c) for r, c in shape]).groupBy(*PIXEL).agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") == len(shape)).select(*PIXEL)


def close(mask: DataFrame, shape: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    return erode(dilate(mask, shape, height, width), shape, height, width)


def frame(images: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of every image."""
    rows = images.select("image").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*PIXEL), PIXEL, "left_anti")


def face_pixels(mask: DataFrame, images: DataFrame, height: int, width: int, least: int = 1) -> DataFrame:
    """Background pixels of components (8-connected) that do not touch the frame, of at least ``least`` pixels."""
    background = minus(frame(images, height, width), mask)
    at = labelled(background, 8).withColumn("edge", (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1))
    faces = at.groupBy("component").agg(F.bool_or("edge").alias("open"), F.count("*").alias("area")).filter(~F.col("open") & (F.col("area") >= least))
    return at.join(faces.select("component", "area"), "component").select(*PIXEL, F.col("component").alias("face"), "area")


def face_counts(faces: DataFrame, images: DataFrame) -> DataFrame:
    """Faces and their area of each image, none included."""
    each = faces.groupBy("image").agg(F.countDistinct("face").alias("faces"), F.count("*").alias("area"))
    return images.select("image").distinct().join(each, "image", "left").na.fill(0, ["faces", "area"])


def adjacent_faces(paths: DataFrame, keys: list[str], faces: DataFrame, radius: int) -> DataFrame:
    """Distinct faces within ``radius`` (Chebyshev) of each path, with the sum and extremes of their areas."""
    near = shifted(faces, square(radius), ["face", "area"])
    met = paths.select(*keys, "row", "col").join(near, PIXEL).select(*keys, "face", "area").distinct()
    g = met.groupBy(*keys).agg(F.count("*").alias("faces"), F.sum("area").alias("area"), F.min("area").alias("least_area"), F.max("area").alias("most_area"))
    return paths.select(*keys).distinct().join(g, keys, "left").na.fill(0, ["faces", "area"])


def exclusion(nodes: DataFrame, radius: int) -> DataFrame:
    """Pixels within ``radius`` (Chebyshev) of a junction."""
    return shifted(nodes, square(radius)).distinct()


def thickened(paths: DataFrame, keys: list[str], width: str) -> DataFrame:
    """Discs of half the local width around each path pixel; where discs overlap pixels stay double."""
    r = F.greatest(F.bround(F.col(width) / 2), F.lit(0)).cast("int")
    at = paths.withColumn("__r", r).withColumn("__dr", F.explode(F.sequence(-F.col("__r"), F.col("__r")))).withColumn("__dc", F.explode(F.sequence(-F.col("__r"), F.col("__r"))))
    at = at.filter(F.col("__dr") * F.col("__dr") + F.col("__dc") * F.col("__dc") <= F.col("__r") * F.col("__r"))
    return at.select(*keys, (F.col("row") + F.col("__dr")).alias("row"), (F.col("col") + F.col("__dc")).alias("col"))


def tile_origins(length: Column, tile: int, stride: int) -> Column:
    """Origins of tiles along an axis: every stride, the last one clamped to the end."""
    end = F.greatest(length - tile, F.lit(0)).cast("int")
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), end, F.lit(stride)), F.array(end))))


def blended(tiles: DataFrame) -> DataFrame:
    """Overlapping tile values (image, row, col, p, w) as one weighted mean a pixel."""
    return tiles.groupBy(*PIXEL).agg((F.sum(F.col("p") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("p"))


def segment(start: tuple[Column, Column], end: tuple[Column, Column], n: Column) -> Column:
    """n pixels evenly spaced from start to end, rounded half to even."""
    place = lambda a, b, i: F.rint(a + (b - a) * i / F.greatest(n - 1, F.lit(1))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(place(start[0], end[0], i).alias("row"), place(start[1], end[1], i).alias("col")))


def component_stats(at: DataFrame) -> DataFrame:
    """Size, box, diagonal and mean probability of each component."""
    g = at.groupBy("image", "component").agg(F.count("*").alias("pixels"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"), F.avg("p").alias("confidence"))
    h, w = F.col("bottom") - F.col("top") + 1, F.col("right") - F.col("left") + 1
    return g.withColumn("diagonal", F.sqrt((h * h + w * w).cast("double")))


def noise_reason(stats: DataFrame, pixels: int, diagonal: float, confidence: float) -> DataFrame:
    """Why a component is noise, the first failing test by name; NULL if it stays."""
    why = F.when(F.col("pixels") < pixels, "skeleton_length").when(F.col("diagonal") < diagonal, "bbox_diagonal").when(F.col("confidence") < confidence, "confidence")
    return stats.withColumn("reason", why)


def to_bytes(prob: DataFrame) -> DataFrame:
    """Values scaled by the greatest of their image to 0..255, negatives clipped."""
    top = F.max("p").over(Window.partitionBy("image"))
    return prob.withColumn("level", F.coalesce(F.floor(F.try_divide(F.greatest(F.col("p"), F.lit(0.0)), top) * 255), F.lit(0)).cast("int"))


def as_probability(values: DataFrame) -> DataFrame:
    """Raw values to 0..1: images whose greatest value is over 1.5 are in 0..255."""
    top = F.max("value").over(Window.partitionBy("image"))
    return values.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(top > 1.5, F.col("value") / 255).otherwise(F.col("value")))))


def as_mask(values: DataFrame, threshold: float) -> DataFrame:
    """Pixels that are set: above the threshold where an image has values over 1, else above 0."""
    top = F.max("value").over(Window.partitionBy("image"))
    return values.withColumn("set", F.when(top > 1, F.col("value") > threshold).otherwise(F.col("value") > 0)).filter("set").select(*PIXEL)
