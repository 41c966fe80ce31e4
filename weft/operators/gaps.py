"""From scores to a clean mask: choice of source, hysteresis, removal of noise, and repair of gaps between line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import paths, raster, skeleton_graph, tiles
from weft.operators.graph import pairs_within
from weft.operators.raster import PIXEL
from weft.session import stored


def binarized(prob: DataFrame | None, mask: DataFrame | None, high: float, low: float, threshold: float) -> DataFrame:
    """(image, row, col, available): by hysteresis where an image has scores (image, row, col, p), else its mask's values
    (image, row, col, value) above the threshold. One of the two must be given."""
    if prob is None and mask is None:
        raise ValueError("neither scores nor masks")
    parts = []
    if prob is not None:
        parts.append(raster.hysteresis(prob, high, low).select(*PIXEL, F.lit(True).alias("available")))
    if mask is not None:
        rest = mask if prob is None else mask.join(prob.select("image").distinct(), "image", "left_anti")
        parts.append(rest.filter(F.col("value") > threshold).select(*PIXEL, F.lit(False).alias("available")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def without_noise(mask: DataFrame, prob: DataFrame | None, pixels: int, diagonal: float, elongation: float, confidence: float) -> tuple[DataFrame, DataFrame]:
    """The mask without noise, and each component with why it went (NULL: it stayed): the first test that fails, by skeleton
    pixels, by the diagonal of its box, by elongation, by mean score."""
    at = stored(raster.labelled(mask.select(*PIXEL)), "components")
    p = at.withColumn("p", F.lit(1.0)) if prob is None else at.join(prob.select(*PIXEL, "p"), PIXEL, "left")
    thin = tiles.thinned(mask).join(at, PIXEL).groupBy("image", "component").agg(F.count("*").alias("skeleton"))
    stats = raster.component_stats(p).join(thin, ["image", "component"], "left").join(paths.elongation(at, ["image", "component"]), ["image", "component"], "left")
    why = (
        F.when(F.coalesce("skeleton", F.lit(0)) < pixels, "skeleton_length").when(F.col("diagonal") < diagonal, "bbox_diagonal")
        .when(F.coalesce("elongation", F.lit(1.0)) < elongation, "elongation").when(F.col("confidence") < confidence, "confidence")
    )
    judged = stored(stats.withColumn("reason", why), "judged")
    kept = at.join(judged.filter("reason is null"), ["image", "component"], "left_semi")
    return kept.select(*PIXEL), judged


def tangents(skeleton: DataFrame, window: int) -> DataFrame:
    """(image, point, row, col, tr, tc): each line end, by its pixel key, and the unit vector that points away from the line.

    The line is followed for ``window`` pixels, each time to the first neighbour by row and column that was not visited.
    """
    tips = raster.neighbour_count(skeleton).filter("neighbours = 1")
    here = F.struct("row", "col")
    walk = tips.select("image", raster.pixel_id(tips).alias("point"), here.alias("head"), here.alias("now"), F.array(here).alias("seen"))
    near = raster.shifted(skeleton.select(*PIXEL, here.alias("to")), skeleton_graph.AROUND, ["to"]).select("image", F.struct("row", "col").alias("now"), "to")
    for _ in range(window):
        ahead = walk.join(near, ["image", "now"], "left").withColumn("to", F.when(~F.array_contains("seen", F.col("to")), F.col("to")))
        walk = ahead.groupBy("image", "point", "head", "now", "seen").agg(F.min("to").alias("to"))
        walk = walk.select("image", "point", "head", F.coalesce("to", "now").alias("now"), F.when(F.col("to").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("to"))).alias("seen"))
    dr, dc = F.col("head.row") - F.col("now.row"), F.col("head.col") - F.col("now.col")
    size = F.sqrt((dr * dr + dc * dc).cast("double"))
    return walk.select("image", "point", F.col("head.row").alias("row"), F.col("head.col").alias("col"), F.when(size > 0, dr / size).alias("tr"), F.when(size > 0, dc / size).alias("tc"))


def _angle(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r1 * r2 + c1 * c2))))


def bridges(mask: DataFrame, prob: DataFrame | None, most: float, angle: float, confidence: float, window: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gaps of at most ``most`` pixels between line ends that point at each other within ``angle`` degrees and whose
    inside has a mean score of ``confidence``; each end is used once, the nearest pairs first.

    Returns the bridges (image, a, b, distance, angle_start, angle_end, mean_p), their pixels, and how many pairs were
    rejected for what reason (image, reason, n) while both their ends were free.
    """
    skeleton = stored(tiles.thinned(mask), "skeleton")
    ends = stored(tangents(skeleton, window), "ends")
    near = pairs_within(ends.select("image", "point", "row", "col"), most)
    side = lambda k: ends.select("image", *(F.col(c).alias(n) for c, n in (("point", k), ("row", f"{k}r"), ("col", f"{k}c"), ("tr", f"{k}tr"), ("tc", f"{k}tc"))))
    at = near.join(side("a"), ["image", "a"]).join(side("b"), ["image", "b"])
    dr, dc = (F.col("br") - F.col("ar")) / F.col("distance"), (F.col("bc") - F.col("ac")) / F.col("distance")
    at = at.withColumn("angle_start", _angle(F.col("atr"), F.col("atc"), dr, dc)).withColumn("angle_end", _angle(F.col("btr"), F.col("btc"), -dr, -dc))
    n = F.greatest(F.abs(F.col("br") - F.col("ar")), F.abs(F.col("bc") - F.col("ac"))) + 1
    at = at.withColumn("path", raster.segment((F.col("ar"), F.col("ac")), (F.col("br"), F.col("bc")), n.cast("int")))
    pair = ["image", "a", "b"]
    if prob is None:
        at = at.withColumn("mean_p", F.lit(None).cast("double"))
    else:
        inside = F.when(F.size("path") > 2, F.slice("path", F.lit(2), F.size("path") - 2)).otherwise(F.col("path"))
        found = at.select(*pair, F.explode(inside).alias("x")).select(*pair, "x.*").join(prob.select(*PIXEL, "p"), PIXEL).groupBy(*pair).agg(F.avg("p").alias("mean_p"))
        at = at.join(found, pair, "left").withColumn("mean_p", F.coalesce("mean_p", F.lit(0.0)))
    reason = F.when(F.col("angle_start").isNull() | F.col("angle_end").isNull(), "no_tangent").when(F.greatest("angle_start", "angle_end") > angle, "angle")
    if prob is not None:
        reason = reason.when(F.col("mean_p") < confidence, "confidence")
    at = stored(at.withColumn("reason", reason), "candidates")
    taken = stored(skeleton_graph.greedy_pairs(at.filter("reason is null")), "taken")
    won = at.join(taken.select(*pair), pair, "left_semi")
    # a pair is rejected only if neither of its ends was used by a nearer bridge
    key = F.struct("distance", "a", "b")
    used = taken.select("image", F.explode(F.array("a", "b")).alias("point"), key.alias("by"))
    first = lambda k: used.select("image", F.col("point").alias(k), F.col("by").alias(f"{k}_by"))
    refused = at.filter("reason is not null").join(first("a"), ["image", "a"], "left").join(first("b"), ["image", "b"], "left")
    free = lambda k: F.col(f"{k}_by").isNull() | (F.col(f"{k}_by") > key)
    rejected = refused.filter(free("a") & free("b")).groupBy("image", "reason").agg(F.count("*").alias("n"))
    px = won.select("image", F.explode("path").alias("x")).select("image", "x.row", "x.col").distinct()
    return won.select(*pair, "distance", "angle_start", "angle_end", "mean_p"), px, rejected


def repaired(mask: DataFrame, prob: DataFrame | None, most: float, angle: float, confidence: float, window: int = 7) -> DataFrame:
    """The mask with the pixels of its bridges."""
    _, px, _ = bridges(mask, prob, most, angle, confidence, window)
    return mask.select(*PIXEL).unionByName(px).distinct()


def preprocessed(prob: DataFrame | None, mask: DataFrame | None, high: float = 0.6, low: float = 0.25, threshold: float = 127, pixels: int = 10, diagonal: float = 0.0, elongation: float = 0.0, confidence: float = 0.0, gap: float | None = None, angle: float = 25.0, gap_confidence: float = 0.2) -> DataFrame:
    """The chain: source, hysteresis, noise, and gaps where ``gap`` is given."""
    at = stored(binarized(prob, mask, high, low, threshold).select(*PIXEL), "mask")
    kept, _ = without_noise(at, prob, pixels, diagonal, elongation, confidence)
    return kept if gap is None else repaired(stored(kept, "kept"), prob, gap, angle, gap_confidence)
