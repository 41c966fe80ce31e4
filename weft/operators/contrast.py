"""Contrast-limited adaptive histogram equalisation, in DataFrame operations only.

An image is cut into a grid of tiles; each tile's levels are counted with map-side sums, counts over the limit are spread over
all levels, and their running sum is the tile's table. A pixel's new level lies between those that the four nearest tiles'
tables give it. An image's tables are one row, so each pixel meets them in one join on its image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.raster import PIXEL

LEVELS = 256


def tile_shapes(frames: DataFrame, grid: int) -> DataFrame:
    """image, height, width, th and tw: the sides of an image's tiles.

    Where either side isn't a multiple of the grid, both are filled up, by a whole grid where a side is one already.
    """
    even = (F.col("height") % grid == 0) & (F.col("width") % grid == 0)
    side = lambda c: F.when(even, F.col(c) / grid).otherwise((F.col(c) + grid - F.col(c) % grid) / grid).cast("int")
    return frames.select("image", "height", "width", side("height").alias("th"), side("width").alias("tw"))


def _copies(i: Column, n: Column, full: Column) -> Column:
    """All places from 0 to full - 1 that show index i, when n places are mirrored beyond the last without repeating it."""
    mirrored = 2 * (n - 1) - i
    return F.when((i < n - 1) & (mirrored < full), F.array(i, mirrored)).when(n == 1, F.sequence(F.lit(0), full - 1)).otherwise(F.array(i))


def tile_tables(levels: DataFrame, frames: DataFrame, grid: int = 8, clip: float = 2.0) -> DataFrame:
    """image, tr, tc, level and to: what each tile of an image makes of each level.

    levels: image, row, col, level (0 to 255); frames: image, height, width, sides of at least grid + 1 pixels or one.
    """
    shape = tile_shapes(frames, grid)
    at = levels.join(shape, "image")
    at = at.select("image", "level", "th", "tw", F.explode(_copies(F.col("row"), F.col("height"), F.col("th") * grid)).alias("row"), F.transform(_copies(F.col("col"), F.col("width"), F.col("tw") * grid), lambda x: F.floor(x / F.col("tw")).cast("int")).alias("tcs"))
    at = at.select("image", "level", F.floor(F.col("row") / F.col("th")).cast("int").alias("tr"), F.explode("tcs").alias("tc"))
    counts = at.groupBy("image", "tr", "tc", "level").agg(F.count("*").alias("n"))
    tiles = shape.select("image", (F.col("th") * F.col("tw")).alias("size"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("tr"))
    tiles = tiles.withColumn("tc", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    key = ["image", "tr", "tc"]
    full = tiles.join(counts, [*key, "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    limit = F.greatest(F.lit(1), F.floor(clip * F.col("size") / LEVELS)).cast("long")
    full = full.withColumn("limit", limit).withColumn("over", F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0))).over(Window.partitionBy(*key)))
    # what is over goes to all levels alike, the rest of it to every so-manieth level from the first on
    rest = F.col("over") % LEVELS
    every = F.greatest(F.expr(f"{LEVELS} div greatest(over % {LEVELS}, 1)"), F.lit(1))
    extra = (F.col("level") % every == 0) & (F.floor(F.col("level") / every) < rest)
    full = full.withColumn("m", F.least("n", "limit") + F.expr(f"over div {LEVELS}") + extra.cast("int"))
    so_far = F.sum("m").over(Window.partitionBy(*key).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    to = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.rint(so_far * (LEVELS - 1) / F.col("size")))).cast("int")
    return full.select(*key, "level", to.alias("to"))


def equalised(levels: DataFrame, frames: DataFrame, grid: int = 8, clip: float = 2.0) -> DataFrame:
    """image, row, col and level of every pixel, with its contrast equalised."""
    tables = tile_tables(levels, frames, grid, clip)
    ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("k", name))), lambda x: x[name])
    by_tile = tables.groupBy("image", "tr", "tc").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "to"))), lambda x: x["to"]).alias("t"))
    by_image = by_tile.select("image", (F.col("tr") * grid + F.col("tc")).alias("k"), "t").groupBy("image").agg(ordered("t").alias("tables"))
    at = levels.join(tile_shapes(frames, grid).join(by_image, "image"), "image")

    def side(place: str, size: str) -> tuple[Column, Column, Column]:
        x = F.col(place) / F.col(size) - 0.5
        low = F.floor(x).cast("int")
        return F.greatest(low, F.lit(0)), F.least(low + 1, F.lit(grid - 1)), x - low

    (r1, r2, ya), (c1, c2, xa) = side("row", "th"), side("col", "tw")
    table = lambda r, c: F.get(F.get(F.col("tables"), r * grid + c), F.col("level"))
    mixed = (table(r1, c1) * (1 - xa) + table(r1, c2) * xa) * (1 - ya) + (table(r2, c1) * (1 - xa) + table(r2, c2) * xa) * ya
    return at.select(*PIXEL, F.rint(mixed).cast("int").alias("level"))


def lightness(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """L (0 to 255), a and b (128 in the middle) of a colour in bytes, under D65."""
    linear = lambda x: F.when(x / 255 <= 0.04045, x / 255 / 12.92).otherwise(F.pow((x / 255 + 0.055) / 1.055, F.lit(2.4)))
    cube = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    rl, gl, bl = linear(r), linear(g), linear(b)
    x = cube((0.412453 * rl + 0.357580 * gl + 0.180423 * bl) / 0.950456)
    y = cube(0.212671 * rl + 0.715160 * gl + 0.072169 * bl)
    z = cube((0.019334 * rl + 0.119193 * gl + 0.950227 * bl) / 1.088754)
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(v).cast("int")))
    return byte((116 * y - 16) * 255 / 100), byte(500 * (x - y) + 128), byte(200 * (y - z) + 128)


def colour(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Blue, green and red of a colour in L, a, b as bytes."""
    y = (light * 100 / 255 + 16) / 116
    back = lambda t: F.when(t > 6 / 29, t * t * t).otherwise((t - 16 / 116) / 7.787)
    x, yy, z = back(y + (a - 128) / 500) * 0.950456, back(y), back(y - (b - 128) / 200) * 1.088754
    gamma = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(255 * gamma(v)).cast("int")))
    red = 3.240479 * x - 1.537150 * yy - 0.498535 * z
    green = -0.969256 * x + 1.875991 * yy + 0.041556 * z
    blue = 0.055648 * x - 0.204043 * yy + 1.057311 * z
    return byte(blue), byte(green), byte(red)


def equalised_colours(planes: DataFrame, frames: DataFrame, grid: int = 8, clip: float = 2.0) -> DataFrame:
    """planes (image, row, col, b, g, r) with the contrast of their lightness equalised; hues stay."""
    light, a, b = lightness(F.col("b"), F.col("g"), F.col("r"))
    lab = planes.select(*PIXEL, light.alias("level"), a.alias("__a"), b.alias("__b"))
    new = equalised(lab.select(*PIXEL, "level"), frames, grid, clip).withColumnRenamed("level", "__l")
    out = colour(F.col("__l"), F.col("__a"), F.col("__b"))
    return lab.join(new, PIXEL).select(*PIXEL, *(x.alias(n) for x, n in zip(out, "bgr", strict=True)))
