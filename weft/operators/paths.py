"""Ordered pixel paths: length, chord, curvature, orientation, series statistics.

Paths are rows (keys, pos, row, col). One window specification, the keys ordered by pos, serves every step, so a plan
shuffles once however many of these are computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import clipped, eigenvalues, heading_change, ratio


def along(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("pos")


def steps(paths: DataFrame, keys: list[str]) -> DataFrame:
    """dr, dc and their length to the pixel before."""
    w = along(keys)
    d = paths.withColumn("dr", F.col("row") - F.lag("row").over(w)).withColumn("dc", F.col("col") - F.lag("col").over(w))
    return d.withColumn("step", F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")))


def geometry(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Length, pixels, chord, tortuosity, straightness, distance to the best line, bounding box and its fill."""
    place = F.struct("pos", "row", "col")
    g = steps(paths, keys).groupBy(*keys).agg(
        F.count("*").alias("pixel_count"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_px"), F.min(place).alias("a"), F.max(place).alias("z"),
        (F.max("row") - F.min("row") + 1).cast("double").alias("bbox_height"), (F.max("col") - F.min("col") + 1).cast("double").alias("bbox_width"),
        F.var_pop("row").alias("vr"), F.var_pop("col").alias("vc"), F.covar_pop("row", "col").alias("vrc"),
    )
    dr, dc = F.col("z.row") - F.col("a.row"), F.col("z.col") - F.col("a.col")
    chord = F.sqrt(dr * dr + dc * dc)
    thin, _ = eigenvalues(F.col("vr"), F.col("vrc"), F.col("vc"))
    return g.withColumn("chord_px", chord).select(
        *keys, "pixel_count", "length_px", "chord_px", ratio("length_px", "chord_px").alias("tortuosity"), ratio("chord_px", "length_px").alias("straightness"),
        F.when(F.col("pixel_count") < 3, 0.0).otherwise(F.sqrt(F.greatest(thin, F.lit(0.0)))).alias("residual"),
        "bbox_height", "bbox_width", F.sqrt(F.col("bbox_height") ** 2 + F.col("bbox_width") ** 2).alias("bbox_diagonal"),
        (F.col("pixel_count") / (F.col("bbox_height") * F.col("bbox_width"))).alias("bbox_fill"),
    )


def curvature(paths: DataFrame, keys: list[str], stride: int = 5) -> DataFrame:
    """Turning along each path, resampled at every stride-th pixel and the last: mean, greatest, deviation, total, net."""
    w = along(keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    kept = paths.withColumn("n", n).filter((F.col("n") <= 2) | (F.col("pos") % stride == 0) | (F.col("pos") == F.col("n") - 1))
    s = steps(kept, keys).filter("step > 0").withColumn("angle", F.atan2("dr", "dc"))
    turned = s.withColumn("turn", heading_change(F.lag("angle").over(w), F.col("angle"))).withColumn("span", (F.col("step") + F.lag("step").over(w)) / 2)
    k = F.abs("turn") / F.col("span")
    stats = turned.groupBy(*keys).agg(
        F.coalesce(F.avg(k), F.lit(0.0)).alias("curvature_mean"), F.coalesce(F.max(k), F.lit(0.0)).alias("curvature_max"), F.coalesce(F.stddev_pop(k), F.lit(0.0)).alias("curvature_std"),
        F.coalesce(F.sum(F.abs("turn")), F.lit(0.0)).alias("turn_total"), F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turn_net"),
    )
    names = ["curvature_mean", "curvature_max", "curvature_std", "turn_total", "turn_net"]
    return paths.select(*keys).distinct().join(stats, keys, "left").na.fill(0.0, names)


def orientation(paths: DataFrame, keys: list[str], lag: int = 1, bins: int = 12) -> DataFrame:
    """Length-weighted statistics of the undirected segment angles: dominant degrees, anisotropy, variance, entropy, histogram."""
    w = along(keys)
    seg = paths.withColumn("dr", F.lead("row", lag).over(w) - F.col("row")).withColumn("dc", F.lead("col", lag).over(w) - F.col("col"))
    seg = seg.withColumn("w", F.sqrt(F.col("dr") ** 2 + F.col("dc") ** 2)).filter("w > 0").withColumn("angle", F.pmod(F.atan2("dr", "dc"), F.lit(math.pi)))
    seg = seg.withColumn("bin", F.least(F.floor(F.col("angle") * bins / math.pi).cast("int"), F.lit(bins - 1)))
    total, c, s = F.sum("w"), F.sum(F.col("w") * F.cos(2 * F.col("angle"))), F.sum(F.col("w") * F.sin(2 * F.col("angle")))
    hist = [(F.sum(F.when(F.col("bin") == b, F.col("w")).otherwise(0.0)) / total).alias(f"hist_{b:02d}") for b in range(bins)]
    r = F.sqrt(c * c + s * s) / total
    g = seg.groupBy(*keys).agg(F.pmod(F.degrees(F.atan2(s, c)) / 2, F.lit(180.0)).alias("dominant_deg"), clipped(r, 0.0, 1.0).alias("anisotropy"), (1 - clipped(r, 0.0, 1.0)).alias("variance"), *hist)
    part = lambda b: F.when(F.col(f"hist_{b:02d}") > 0, -F.col(f"hist_{b:02d}") * F.ln(f"hist_{b:02d}")).otherwise(0.0)
    return g.withColumn("entropy", sum((part(b) for b in range(bins)), F.lit(0.0)) / math.log(bins))


def series(rows: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Mean, deviation, least, greatest, outer deciles and coefficient of variation of a series."""
    v = F.col(value).cast("double")
    g = rows.groupBy(*keys).agg(
        F.avg(v).alias(f"{prefix}_mean"), F.stddev_pop(v).alias(f"{prefix}_std"), F.min(v).alias(f"{prefix}_min"), F.max(v).alias(f"{prefix}_max"),
        F.percentile(v, F.lit(0.1)).alias(f"{prefix}_p10"), F.percentile(v, F.lit(0.9)).alias(f"{prefix}_p90"),
    )
    return g.withColumn(f"{prefix}_cv", ratio(f"{prefix}_std", f"{prefix}_mean", 1e-9))


def normals(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The unit normal of each pixel by the difference of its neighbours, the ends clamped; nothing moves where they coincide."""
    w = along(keys)
    diff = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    d = paths.withColumn("dr", diff("row").cast("double")).withColumn("dc", diff("col").cast("double"))
    size = F.sqrt(F.col("dr") ** 2 + F.col("dc") ** 2)
    size = F.when(size > 0, size).otherwise(1.0)
    return d.withColumn("normal_row", -F.col("dc") / size).withColumn("normal_col", F.col("dr") / size).drop("dr", "dc")


def broken(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Paths with a step of more than one pixel in either direction."""
    s = steps(paths, keys).groupBy(*keys).agg(F.max(F.greatest(F.abs("dr"), F.abs("dc"))).alias("widest"))
    return s.filter("widest > 1")


def midpoint(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The pixel at half the number of pixels."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return paths.withColumn("n", n).filter(F.col("pos") == F.floor(F.col("n") / 2)).select(*keys, "row", "col")


def elongation(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Long over short axis of a pixel cloud, by sample covariance."""
    g = pixels.groupBy(*keys).agg(F.var_samp("row").alias("a"), F.covar_samp("row", "col").alias("b"), F.var_samp("col").alias("c"))
    small, large = eigenvalues(F.col("a"), F.col("b"), F.col("c"))
    return g.select(*keys, F.sqrt(F.greatest(large, F.lit(0.0)) / (F.greatest(small, F.lit(0.0)) + 1e-9)).alias("elongation"))


def length_of(path: Column) -> Column:
    """The length of a path held as an array of (row, col) structs."""
    hop = lambda a, b: F.sqrt(F.pow(b["row"] - a["row"], F.lit(2.0)) + F.pow(b["col"] - a["col"], F.lit(2.0)))
    moves = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), hop)
    return F.when(F.size(path) > 1, F.aggregate(moves, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
