"""Queries on predictions as pixels, node features, and reports on graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft import functions as fn
from weft.operators import discovery, graph, raster, sweeps, tiles
from weft.plans.relations import edges, mask, nodes, paths, prob, scores, with_
from weft.plans.sweep_queries import rounded
from weft.session import table


def _seeded(s, d):
    m = mask(s, d)
    seeds = m.filter("(row * 8 + col + image) % 9 = 0").withColumn("seed", F.col("row") * 8 + F.col("col"))
    values = s.range(64).filter("id % 5 > 0").select(F.col("id").cast("int").alias("seed"), (F.col("id") % 3).cast("int").alias("value"))
    return graph.class_mask(tiles.nearest(m, seeds), values).groupBy("image", "value").agg(F.count("*").alias("n"))


def _pixels(s, d):
    """Paths on a coarse grid, so that they share pixels."""
    return paths(s, d).select(F.lit(0).alias("image"), "edge", F.floor(F.col("row") / 20).cast("int").alias("row"), (F.col("col") % 10).alias("col"), "pos")


_PIXELS = with_("paths") + ", px AS (SELECT 0 AS image, edge, floor(row / 20)::INT AS row, col % 10 AS col, pos FROM paths) "


def _leaving(s, d):
    p = paths(s, d).groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row", "col"))), lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"))).alias("path"))
    return rounded(p.select("edge", graph.leaving_angle(F.col("path")).alias("first"), graph.leaving_angle(F.col("path"), reverse=True).alias("last")))


def _pairs(s, d):
    p = table(s, d, "pages").select("page_id")
    truths = p.select(F.concat(F.lit("a_lab_/p"), F.col("page_id"), F.lit("_lab.png")).alias("path"))
    guesses = p.filter("page_id % 2 = 0").select(F.concat(F.lit("a_lab_/p"), F.col("page_id"), F.lit("_pred.png")).alias("path"))
    return discovery.pairs(truths, guesses, "_lab.png", "_pred.png")


def _messages(s, d):
    bad = graph.validate(edges(s, d), nodes(s, d)).withColumn("message", F.concat(F.lit("edge "), F.col("edge"), F.lit(": missing node "), F.col("node")))
    out = graph.capped_messages(bad, "image", "message", 5)
    return out.select("image", "n", F.array_join("messages", "; ").alias("messages"))


QUERIES = {
    "half_max_metrics": (
        lambda s, d: rounded(sweeps.at_half_of_most(scores(s, d), "image", "score", "truth")),
        with_("scores") + ", p AS (SELECT truth, score > max(score) OVER (PARTITION BY image) / 2::DOUBLE AS p FROM scores), n AS (SELECT count(*) FILTER (p AND truth) AS tp, count(*) FILTER (p AND NOT truth) AS fp, count(*) FILTER (NOT p AND truth) AS fn FROM p) SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 1), 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM n",
    ),
    "segment_metrics": (
        lambda s, d: rounded(sweeps.segment_metrics(scores(s, d).withColumn("guess", F.col("score") > 127), "guess", "truth")),
        with_("scores") + ", n AS (SELECT count(*) FILTER (score > 127 AND truth) AS tp, count(*) FILTER (score > 127 AND NOT truth) AS fp, count(*) FILTER (score <= 127 AND truth) AS fn, count(*) FILTER (score <= 127 AND NOT truth) AS tn FROM scores) SELECT round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS class_accuracy, round((tp / (tp + fp + fn)::DOUBLE + tn / (tn + fp + fn)::DOUBLE) / 2, 6) AS mean_iou FROM n",
    ),
    "soft_losses": (
        lambda s, d: rounded(sweeps.soft_losses(prob(s, d).withColumn("t", F.col("col") > 3), "image", "p", "t")),
        with_("prob") + ", x AS (SELECT image, p, (col > 3)::INT AS t, greatest(1e-7, least(1 - 1e-7, p)) AS x FROM prob) SELECT image, round(1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1), 6) AS dice_loss, round(avg(-(t * ln(x) + (1 - t) * ln(1 - x))), 6) AS bce FROM x GROUP BY image",
    ),
    "mask_ratio": (
        lambda s, d: rounded(prob(s, d).groupBy("image").agg(F.avg((F.col("p") >= 0.55).cast("double")).alias("ratio"))),
        with_("prob") + "SELECT image, round(avg((p >= 0.55::DOUBLE)::INT), 6) AS ratio FROM prob GROUP BY image",
    ),
    "class_mask": (
        _seeded,
        with_("prob", "mask") + ", sd AS (SELECT *, row * 8 + col AS seed FROM mask WHERE (row * 8 + col + image) % 9 = 0), k AS (SELECT m.image, m.row, m.col, arg_min(seed, ((m.row - sd.row) * (m.row - sd.row) + (m.col - sd.col) * (m.col - sd.col), seed)) AS seed FROM mask m LEFT JOIN sd ON sd.image = m.image GROUP BY ALL) SELECT image, CASE WHEN seed % 5 > 0 THEN seed % 3 ELSE 255 END::INT AS value, count(*) AS n FROM k GROUP BY ALL",
    ),
    "pixel_owner": (lambda s, d: graph.pixel_owner(_pixels(s, d)), _PIXELS + "SELECT image, row, col, max(edge) AS edge FROM px GROUP BY ALL"),
    "shared_pixels": (lambda s, d: graph.shared_pixels(_pixels(s, d)), _PIXELS + "SELECT image, row, col, count(DISTINCT edge) AS edges FROM px GROUP BY ALL HAVING count(DISTINCT edge) > 1"),
    "paint_labels": (
        lambda s, d: graph.painted(_pixels(s, d), _pixels(s, d).select("edge").distinct().filter("edge % 4 > 0").withColumn("value", (F.col("edge") % 3).cast("int"))),
        _PIXELS + "SELECT image, row, col, (max(edge) % 3)::INT AS value FROM px WHERE edge % 4 > 0 GROUP BY ALL",
    ),
    "node_features": (
        lambda s, d: graph.node_features(edges(s, d), nodes(s, d)),
        with_("edges", "ends", "nodes") + ", g AS (SELECT n.image, n.node, count(e.edge)::INT AS degree FROM nodes n LEFT JOIN ends e ON e.node = n.node GROUP BY ALL) SELECT *, (degree = 0)::INT AS is_isolated, (degree = 1)::INT AS is_endpoint, (degree = 2)::INT AS is_passing, (degree >= 3)::INT AS is_junction FROM g",
    ),
    "leaving_angles": (
        _leaving,
        with_("paths") + ", e AS (SELECT edge, pos, row, col, count(*) OVER (PARTITION BY edge) AS n FROM paths), a AS (SELECT edge, any_value(n) AS n, arg_min(row, pos) AS r0, arg_min(col, pos) AS c0, arg_max(row, pos) FILTER (pos < 7) AS r1, arg_max(col, pos) FILTER (pos < 7) AS c1, arg_max(row, pos) AS s0, arg_max(col, pos) AS d0, arg_min(row, pos) FILTER (pos >= n - 7) AS s1, arg_min(col, pos) FILTER (pos >= n - 7) AS d1 FROM e GROUP BY edge), x AS (SELECT edge, n, degrees(atan2(r1 - r0, c1 - c0)) AS a, degrees(atan2(s1 - s0, d1 - d0)) AS b FROM a) SELECT edge, CASE WHEN n > 1 THEN round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) END AS first, CASE WHEN n > 1 THEN round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) END AS last FROM x",
    ),
    "pair_files": (_pairs, "SELECT 'a_lab_/p' || page_id AS name, 'a_lab_/p' || page_id || '_lab.png' AS truth, 'a_lab_/p' || page_id || '_pred.png' AS prediction FROM pages WHERE page_id % 2 = 0"),
    "capped_messages": (
        _messages,
        with_("edges", "ends", "nodes") + ", b AS (SELECT DISTINCT image, 'edge ' || edge || ': missing node ' || node AS m FROM ends e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node = e.node)), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY m) AS k FROM b) SELECT image, count(*) AS n, string_agg(m, '; ' ORDER BY m) FILTER (k <= 5) AS messages FROM r GROUP BY image",
    ),
    "fixed_format": (
        lambda s, d: table(s, d, "customer").select("c_custkey", fn.as_fixed(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")), 2).alias("balance")),
        "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN printf('%.2f', c_acctbal) ELSE 'n/a' END AS balance FROM customer",
    ),
}
