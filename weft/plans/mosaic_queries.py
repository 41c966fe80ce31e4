"""Queries on one large image: all rasters laid out side by side, so that tiles and their borders are crossed."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import contrast, inference, skeleton_graph, tiles
from weft.operators import raster as R
from weft.plans.relations import ACROSS, SIDE, mosaic, mosaic_shape, with_
from weft.plans.sweep_queries import rounded

LEAST = 0.6
#: Above this most pixels are set, so that what is not lies in many closed faces.
MOST = 0.45


def _mask(s, d, least=LEAST):
    return mosaic(s, d).filter(F.col("p") >= least).select("image", "row", "col")


def _seeds(s, d):
    return _mask(s, d).filter("(row * 7 + col) % 41 = 0").withColumn("seed", F.col("row") + 3 * F.col("col"))


def _faces(s, d):
    height, width = mosaic_shape(s, d)
    return R.face_pixels(_mask(s, d, MOST), mosaic(s, d).select("image"), height, width)


def _graph(s, d):
    """Nodes and edges of the thinned mosaic, by kind."""
    nodes, edges, _ = skeleton_graph.build(tiles.thinned(_mask(s, d)))
    kinds = nodes.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.sum("pixels").cast("double").alias("pixels"))
    return kinds.unionByName(edges.agg(F.lit("edge").alias("kind"), F.count("*").alias("n"), F.round(F.sum("length"), 4).alias("pixels")))


def _levels(s, d):
    return mosaic(s, d).select("image", "row", "col", F.floor(F.col("p") * 255).cast("int").alias("level"))


def _frame(s, d):
    return s.createDataFrame([(0, *mosaic_shape(s, d))], "image long, height int, width int")


def _line_model():
    """A stand-in for a trained network: one weight a channel."""
    return lambda x: 3 * x[..., 0] - x[..., 2]


def _inferred(s, d):
    planes = _levels(s, d).select("image", "row", "col", F.col("level").alias("b"), F.lit(0).alias("g"), (255 - F.col("level")).alias("r"))
    return inference.inferred(planes, _frame(s, d), _line_model, 96, 48).select("image", "row", "col", F.round("p", 2).alias("p"))


GRID, CLIP = 8, 2.0
_CONTRAST = (
    with_("prob", "mosaic")
    + f""", shape AS (SELECT (max(vec_id) // {ACROSS} + 1) * {SIDE} // {GRID} AS th, {ACROSS * SIDE // GRID} AS tw FROM embeddings
), l AS (SELECT row, col, floor(p * 255)::INT AS level FROM mosaic
), c AS (SELECT row // th AS tr, col // tw AS tc, level, count(*) AS n FROM l, shape GROUP BY ALL
), f AS (
  SELECT tr, tc, level, coalesce(n, 0) AS n, th * tw AS size, greatest(1, floor({CLIP} * th * tw / 256))::BIGINT AS most
  FROM (SELECT * FROM shape, range({GRID}) AS a(tr), range({GRID}) AS b(tc), range(256) AS d(level)) LEFT JOIN c USING (tr, tc, level)
), o AS (SELECT *, (sum(greatest(n - most, 0)) OVER (PARTITION BY tr, tc))::BIGINT AS over FROM f
), m AS (
  SELECT *, least(n, most) + over // 256 + (level % greatest(256 // greatest(over % 256, 1), 1) = 0 AND level // greatest(256 // greatest(over % 256, 1), 1) < over % 256)::INT AS m FROM o
), t AS (
  SELECT tr, tc, level, greatest(0, least(255, round_even((sum(m) OVER (PARTITION BY tr, tc ORDER BY level))::DOUBLE * 255 / size, 0)))::INT AS v FROM m
) """
)

def _mask_sql(least: float) -> str:
    return with_("prob", "mosaic", recursive=True) + f", mask AS (SELECT image, row, col FROM mosaic WHERE p >= {least}::DOUBLE)"


_MASK = _mask_sql(LEAST)
_MASK_ONLY = _MASK.replace("WITH RECURSIVE", "WITH")


def _cc(name: str) -> str:
    """Components of pixels, 8-connected, by least pixel number: least labels of neighbours until none changes."""
    return f""", px AS (SELECT row::BIGINT * 1048576 + col AS px, row, col FROM {name}
), steps AS (
  SELECT a.px AS a, b.px AS b FROM px a, range(-1, 2) AS u(r), range(-1, 2) AS v(c) JOIN px b ON b.row = a.row + r AND b.col = a.col + c WHERE a.px <> b.px
), comp(node, component) USING KEY (node) AS (
  SELECT px, px FROM px
  UNION
  SELECT s.a, min(c.component) FROM comp c JOIN steps s ON s.b = c.node JOIN recurring.comp r ON r.node = s.a WHERE c.component < r.component GROUP BY s.a
), cc AS (SELECT 0::BIGINT AS image, row, col, component FROM px JOIN comp ON node = px)"""


_SHAPE = f"shape AS (SELECT (max(vec_id) // {ACROSS} + 1) * {SIDE} AS height, {ACROSS * SIDE} AS width FROM embeddings)"
_BACK = f", {_SHAPE}, frame AS (SELECT row::INT AS row, col::INT AS col FROM (SELECT unnest(range(height)) AS row, width FROM shape), range({ACROSS * SIDE}) AS c(col)), back AS (SELECT row, col FROM frame ANTI JOIN mask USING (row, col))"

QUERIES = {
    "mosaic_components": (lambda s, d: R.labelled(_mask(s, d)), _MASK + _cc("mask") + " SELECT image, row, col, component FROM cc"),
    "mosaic_hysteresis": (
        lambda s, d: rounded(R.hysteresis(mosaic(s, d), 0.75, LEAST)),
        _MASK + _cc("mask") + ", strong AS (SELECT DISTINCT component FROM cc JOIN mosaic USING (row, col) WHERE p >= 0.75::DOUBLE) SELECT cc.image, cc.row, cc.col, round(p, 6) AS p, component FROM cc JOIN mosaic USING (row, col) WHERE component IN (SELECT component FROM strong)",
    ),
    "mosaic_faces": (
        _faces,
        _mask_sql(MOST) + _BACK + _cc("back") + ", open AS (SELECT DISTINCT component FROM cc, shape WHERE row = 0 OR col = 0 OR row = height - 1 OR col = width - 1) SELECT image, row, col, component AS face, count(*) OVER (PARTITION BY component) AS area FROM cc ANTI JOIN open USING (component)",
    ),
    "mosaic_distances": (
        lambda s, d: tiles.distances(_mask(s, d), *mosaic_shape(s, d)),
        _MASK_ONLY + _BACK + " SELECT image, m.row, m.col, min((m.row - b.row) * (m.row - b.row) + (m.col - b.col) * (m.col - b.col))::BIGINT AS d2 FROM mask m, back b GROUP BY ALL",
    ),
    "mosaic_nearest": (
        lambda s, d: tiles.nearest(_mask(s, d), _seeds(s, d)),
        _MASK_ONLY + ", sd AS (SELECT row, col, (row + 3 * col)::BIGINT AS seed FROM mask WHERE (row * 7 + col) % 41 = 0), c AS (SELECT m.row, m.col, min(((m.row - sd.row) * (m.row - sd.row) + (m.col - sd.col) * (m.col - sd.col), seed)) AS x FROM mask m, sd GROUP BY ALL) SELECT 0::BIGINT AS image, row, col, x[2] AS seed, x[1]::BIGINT AS d2 FROM c",
    ),
    "contrast_tables": (
        lambda s, d: contrast.tile_tables(_levels(s, d), _frame(s, d), GRID, CLIP),
        _CONTRAST + 'SELECT 0::BIGINT AS image, tr::INT AS tr, tc::INT AS tc, level::INT AS level, v AS "to" FROM t',
    ),
    "contrast_equalised": (
        lambda s, d: contrast.equalised(_levels(s, d), _frame(s, d), GRID, CLIP),
        _CONTRAST
        + f""", x AS (SELECT row, col, level, floor(row / th::DOUBLE - 0.5::DOUBLE)::INT AS r, floor(col / tw::DOUBLE - 0.5::DOUBLE)::INT AS c, row / th::DOUBLE - 0.5::DOUBLE AS fr, col / tw::DOUBLE - 0.5::DOUBLE AS fc FROM l, shape
), y AS (SELECT *, fr - r AS ya, fc - c AS xa, greatest(r, 0) AS r1, least(r + 1, {GRID - 1}) AS r2, greatest(c, 0) AS c1, least(c + 1, {GRID - 1}) AS c2 FROM x)
SELECT 0::BIGINT AS image, row, col, round_even((a.v * (1 - xa) + b.v * xa) * (1 - ya) + (e.v * (1 - xa) + g.v * xa) * ya, 0)::INT AS level
FROM y JOIN t a ON a.tr = r1 AND a.tc = c1 AND a.level = y.level JOIN t b ON b.tr = r1 AND b.tc = c2 AND b.level = y.level
JOIN t e ON e.tr = r2 AND e.tc = c1 AND e.level = y.level JOIN t g ON g.tr = r2 AND g.tc = c2 AND g.level = y.level""",
    ),
    "tile_inference": (
        _inferred,
        with_("prob", "mosaic") + f", shape AS (SELECT (max(vec_id) // {ACROSS} + 1) * {SIDE} AS height FROM embeddings), h AS (SELECT unnest(range(height))::INT AS row FROM shape), f AS (SELECT row, col::INT AS col FROM h, range({ACROSS * SIDE}) AS c(col)), l AS (SELECT row, col, floor(p * 255) AS l FROM f LEFT JOIN mosaic USING (row, col)), b AS (SELECT row, col, coalesce(l, 0) / 255::DOUBLE AS b, CASE WHEN l IS NULL THEN 0 ELSE 255 - l END / 255::DOUBLE AS r FROM l) SELECT 0::BIGINT AS image, row, col, round(1 / (1 + exp(-(3 * (r - 0.5::DOUBLE) / 0.5::DOUBLE - (b - 0.5::DOUBLE) / 0.5::DOUBLE))), 2) AS p FROM b",
    ),
    "mosaic_thinned": (lambda s, d: tiles.thinned(_mask(s, d)), None),
    "mosaic_graph": (_graph, None),
}
