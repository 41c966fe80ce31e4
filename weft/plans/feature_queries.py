"""Queries on whole chains: masks to features, noise and gaps, and on small tables beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import functions as fn
from weft import sources
from weft.operators import discovery, features, gaps, metrics, raster, skeleton_graph, splits, tiles
from weft.plans.relations import SIDE, mask, predictions, prob, with_
from weft.session import stored, table

#: The rasters of the tables are eight by eight, so sizes are small.
SMALL = features.Settings(margin=1, least_face=1, radius=4.0, patch=2, stride=2, offset=1.0)


def _features(s, d):
    m = stored(mask(s, d), "mask")
    nodes, edges, paths = skeleton_graph.build(tiles.thinned(m), 1)
    distance = tiles.distances(m, SIDE, SIDE).select("image", "row", "col", F.sqrt(F.col("d2").cast("double")).alias("distance"))
    p = prob(s, d)
    planes = p.select("image", "row", "col", F.floor(F.col("p") * 255).alias("grey"), F.floor(F.col("p") * 100).alias("saturation"))
    return features.table(nodes, edges, paths, SIDE, SIDE, m, distance, p, planes, settings=SMALL)


def _bridges(s, d):
    won, _, _ = gaps.bridges(stored(mask(s, d), "mask"), prob(s, d), 3.0, 60.0, 0.3, 3)
    return won.select("image", "a", "b", *(F.round(c, 6).alias(c) for c in ("distance", "angle_start", "angle_end", "mean_p")))


def _noise(s, d):
    _, judged = gaps.without_noise(mask(s, d), prob(s, d), 2, 2.9, 1.5, 0.7)
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _confusion(s, d):
    folds = metrics.confusion(predictions(s, d), "y", "yhat", ["fold"])
    return folds.groupBy("truth", "predicted").agg(F.sum("n").alias("n"))


def _stripped(s, d):
    names = table(s, d, "pages").select(F.concat(F.lit("p"), "page_id", F.when(F.col("page_id") % 3 == 0, "_s1_prob").when(F.col("page_id") % 3 == 1, "_prob").otherwise("")).alias("name"))
    ids = names.filter("name rlike '^p[0-9]*[05]_'").select(F.substring_index("name", "_", 1).alias("id"))
    return discovery.stripped(names, ids, ["_s1_prob", "_prob"])


def _padded(s, d):
    """Each raster row with two pixels mirrored at either end."""
    at = prob(s, d).select("image", "row", F.col("col").alias("__c"), "p")
    wide = at.select("image", "row").distinct().withColumn("col", F.explode(F.sequence(F.lit(-2), F.lit(SIDE + 1))))
    return wide.withColumn("__c", fn.reflected(F.col("col"), F.lit(SIDE))).join(at, ["image", "row", "__c"]).select("image", "row", "col", F.round("p", 6).alias("p"))


QUERIES = {
    "edge_features": (_features, None),
    "gap_bridges": (_bridges, None),
    "noise_reasons": (_noise, None),
    "packed_masks": (
        lambda s, d: sources.packed(mask(s, d)),
        with_("prob", "mask") + ", r AS (SELECT *, col - row_number() OVER (PARTITION BY image, row ORDER BY col) AS run FROM mask) SELECT image, row, min(col) AS start, count(*)::INT AS length FROM r GROUP BY image, row, run",
    ),
    "unpacked_masks": (lambda s, d: sources.unpacked(sources.packed(mask(s, d))), with_("prob", "mask") + "SELECT image, row, col FROM mask"),
    "image_conflicts": (
        lambda s, d: splits.image_conflicts(predictions(s, d), "source", "lang"),
        with_("predictions") + "SELECT source AS image, count(DISTINCT lang) AS groups FROM predictions GROUP BY source HAVING count(DISTINCT lang) > 1",
    ),
    "confusion_sum": (_confusion, with_("predictions") + "SELECT y AS truth, yhat AS predicted, count(*)::HUGEINT::BIGINT AS n FROM predictions GROUP BY ALL"),
    "stripped_names": (
        _stripped,
        "SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '_s1_prob' WHEN 1 THEN '_prob' ELSE '' END AS name, 'p' || page_id AS owner FROM pages",
    ),
    "selected_records": (
        lambda s, d: discovery.selected(table(s, d, "customer").select(F.col("c_name").alias("image_id"), "c_nationkey"), None, 40),
        "SELECT c_name AS image_id, c_nationkey FROM customer ORDER BY c_name LIMIT 40",
    ),
    "mirrored_rows": (
        _padded,
        with_("prob") + f"SELECT a.image, a.row, c.col::INT AS col, round(a.p, 6) AS p FROM prob a JOIN (SELECT col, CASE WHEN col < 0 THEN -col WHEN col >= {SIDE} THEN {2 * SIDE - 2} - col ELSE col END AS src FROM range(-2, {SIDE + 2}) AS r(col)) c ON c.src = a.col",
    ),
    "colour_classes": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", fn.class_of_colour(F.col("label") % 2, F.col("vec_id") % 2, F.col("vec_id") % 3, {1: (1, 0, 0), 2: (0, 1, 2)}).alias("value")),
        "SELECT vec_id, CASE WHEN label % 2 = 1 AND vec_id % 2 = 0 AND vec_id % 3 = 0 THEN 1 WHEN label % 2 = 0 AND vec_id % 2 = 1 AND vec_id % 3 = 2 THEN 2 ELSE 0 END AS value FROM embeddings",
    ),
    "frame_check": (
        lambda s, d: raster.minus(raster.frame(mask(s, d), SIDE, SIDE), mask(s, d)).groupBy("image").agg(F.count("*").alias("n")),
        with_("prob", "mask") + "SELECT image, count(*) AS n FROM prob ANTI JOIN mask USING (image, row, col) WHERE image IN (SELECT image FROM mask) GROUP BY image",
    ),
}
