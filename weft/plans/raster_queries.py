"""Queries on rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import hann
from weft.operators import kernels, tiles
from weft.operators import raster as R
from weft.plans.relations import SIDE, mask, paths, prob, with_
from weft.plans.sweep_queries import rounded
from weft.session import table

_DISK = "o AS (SELECT r, c FROM range(-{0}, {1}) AS a(r), range(-{0}, {1}) AS b(c) WHERE r * r + c * c <= {0} * {0})"


def _disk_sql(radius: int) -> str:
    return _DISK.format(radius, radius + 1)


def _cc(name: str) -> str:
    """Components of a relation of pixels (image, row, col), 8-connected, by the least pixel number."""
    return f"""reach(image, row, col, r2, c2) AS (
  SELECT image, row, col, row, col FROM {name}
  UNION
  SELECT reach.image, reach.row, reach.col, m.row, m.col FROM reach JOIN {name} m ON m.image = reach.image AND abs(m.row - r2) <= 1 AND abs(m.col - c2) <= 1
), cc AS (SELECT image, row, col, min((image << 40) + (r2::BIGINT << 20) + c2::BIGINT) AS component FROM reach GROUP BY image, row, col)"""


_HYST = with_("prob", recursive=True) + ", weak AS (SELECT * FROM prob WHERE p >= 0.55::DOUBLE), " + _cc("weak") + " "
_FACES = (
    with_("prob", "mask", recursive=True)
    + ", bg AS (SELECT image, row, col FROM prob ANTI JOIN mask USING (image, row, col)), "
    + _cc("bg")
    + ", faces AS (SELECT image, row, col, component AS face, count(*) OVER (PARTITION BY component) AS area FROM cc WHERE component NOT IN (SELECT component FROM cc WHERE row IN (0, 7) OR col IN (0, 7))) "
)
_DILATED = ", " + _disk_sql(1) + ", dil AS (SELECT DISTINCT image, row + r AS row, col + c AS col FROM mask, o WHERE row + r BETWEEN 0 AND 7 AND col + c BETWEEN 0 AND 7)"



_ERODE = ", e AS (SELECT image, row - r AS row, col - c AS col, count(*) AS n FROM {0}, o GROUP BY ALL), w AS (SELECT a.row, b.col, count(*) AS n FROM range(8) AS a(row), range(8) AS b(col), o WHERE a.row + r BETWEEN 0 AND 7 AND b.col + c BETWEEN 0 AND 7 GROUP BY ALL) SELECT image, e.row::INT AS row, e.col::INT AS col FROM e JOIN w ON w.row = e.row AND w.col = e.col AND w.n = e.n"


def _tiles(s, d):
    """The overlapping 4-wide tiles of each raster, weighted by a Hann window, blended again."""
    at = prob(s, d)
    for axis in ("row", "col"):
        at = at.withColumn(f"{axis}0", F.explode(R.tile_origins(F.lit(SIDE), 4, 2))).filter(f"{axis} >= {axis}0 and {axis} < {axis}0 + 4")
    return at.withColumn("w", hann(F.col("row") - F.col("row0"), 4) * hann(F.col("col") - F.col("col0"), 4))


def _seeds(s, d):
    return mask(s, d).filter("(row * 8 + col + image) % 9 = 0").withColumn("seed", F.col("row") * 8 + F.col("col"))


def _faces(s, d):
    return R.face_pixels(mask(s, d), prob(s, d).select("image"), SIDE, SIDE)


def _stats(s, d):
    at = R.labelled(R.weak_and_strong(prob(s, d), 0.65, 0.55))
    return rounded(R.noise_reason(R.component_stats(at), 3, 3.0, 0.6))


def _thin_and_trace(s, d):
    """Thinned masks cut at their junctions, and the chains that are left, traced."""
    thin = tiles.thinned(mask(s, d))
    chains = R.neighbour_count(thin).filter("neighbours <= 2").select("image", "row", "col")
    return kernels.traced(R.labelled(chains))


QUERIES = {
    "hysteresis": (lambda s, d: rounded(R.hysteresis(prob(s, d), 0.65, 0.55)), _HYST + "SELECT image, row, col, round(p, 6) AS p, component FROM cc JOIN weak USING (image, row, col) WHERE component IN (SELECT component FROM cc JOIN weak USING (image, row, col) WHERE p >= 0.65::DOUBLE)"),
    "mask_components": (lambda s, d: R.labelled(mask(s, d)), with_("prob", "mask", recursive=True) + ", " + _cc("mask") + " SELECT image, row, col, component FROM cc"),
    "component_noise": (
        _stats,
        _HYST + ", g AS (SELECT image, component, count(*) AS pixels, min(row) AS top, max(row) AS bottom, min(col) AS \"left\", max(col) AS \"right\", round(avg(p), 6) AS confidence, round(sqrt(power(max(row) - min(row) + 1, 2) + power(max(col) - min(col) + 1, 2)), 6) AS diagonal FROM cc JOIN weak USING (image, row, col) GROUP BY image, component) SELECT *, CASE WHEN pixels < 3 THEN 'skeleton_length' WHEN diagonal < 3 THEN 'bbox_diagonal' WHEN confidence < 0.6 THEN 'confidence' END AS reason FROM g",
    ),
    "neighbor_count": (lambda s, d: R.neighbour_count(mask(s, d)), with_("prob", "mask") + "SELECT a.image, a.row, a.col, (count(b.image) - 1)::INT AS neighbours FROM mask a JOIN mask b ON a.image = b.image AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL"),
    "dilate": (lambda s, d: R.dilate(mask(s, d), R.disk(1), SIDE, SIDE), with_("prob", "mask") + _DILATED + " SELECT image, row::INT AS row, col::INT AS col FROM dil"),
    "erode": (lambda s, d: R.erode(mask(s, d), R.disk(1), SIDE, SIDE), with_("prob", "mask") + ", " + _disk_sql(1) + _ERODE.format("mask")),
    "close": (lambda s, d: R.close(mask(s, d), R.disk(1), SIDE, SIDE), with_("prob", "mask") + _DILATED + _ERODE.format("dil")),
    "faces": (lambda s, d: _faces(s, d), _FACES + "SELECT image, row, col, face, area FROM faces"),
    "face_counts": (lambda s, d: R.face_counts(_faces(s, d), prob(s, d)), _FACES + "SELECT image, count(DISTINCT face) AS faces, count(face) AS area FROM (SELECT DISTINCT image FROM prob) LEFT JOIN faces USING (image) GROUP BY image"),
    "face_adjacency": (
        lambda s, d: R.adjacent_faces(mask(s, d), ["image"], _faces(s, d), 1).na.fill(0),
        _FACES + ", m AS (SELECT DISTINCT k.image, face, area FROM mask k JOIN faces f ON f.image = k.image AND abs(f.row - k.row) <= 1 AND abs(f.col - k.col) <= 1) SELECT image, count(face) AS faces, coalesce(sum(area), 0)::BIGINT AS area, coalesce(min(area), 0) AS least_area, coalesce(max(area), 0) AS most_area FROM (SELECT DISTINCT image FROM mask) LEFT JOIN m USING (image) GROUP BY image",
    ),
    "mask_algebra": (lambda s, d: R.minus(R.dilate(mask(s, d), R.disk(1), SIDE, SIDE), mask(s, d)), with_("prob", "mask") + _DILATED + " SELECT image, row::INT AS row, col::INT AS col FROM dil ANTI JOIN mask USING (image, row, col)"),
    "tile_origins": (
        lambda s, d: table(s, d, "pages").select("page_id", F.length("html").alias("length")).withColumn("origin", F.explode(R.tile_origins(F.col("length"), 512, 256))),
        "SELECT DISTINCT page_id, length::INT AS length, origin::INT AS origin FROM (SELECT page_id, length(html) AS length, unnest(list_append(range(0, greatest(length(html) - 512, 0) + 1, 256), greatest(length(html) - 512, 0))) AS origin FROM pages)",
    ),
    "tile_blend": (
        lambda s, d: rounded(R.blended(_tiles(s, d).withColumn("p", F.col("p") + F.col("row0") / 100))),
        with_("prob") + ", h AS (SELECT i, greatest(0.5 - 0.5 * cos(2 * pi() * i / 3), 1e-3) AS w FROM range(4) AS r(i)), t AS (SELECT image, row, col, p + a.o / 100::DOUBLE AS p, x.w * y.w AS w FROM prob JOIN (VALUES (0), (2), (4)) AS a(o) ON row BETWEEN a.o AND a.o + 3 JOIN (VALUES (0), (2), (4)) AS b(o) ON col BETWEEN b.o AND b.o + 3 JOIN h x ON x.i = row - a.o JOIN h y ON y.i = col - b.o) SELECT image, row, col, round(sum(p * w) / greatest(sum(w), 1e-6), 6) AS p FROM t GROUP BY ALL",
    ),
    "disc_samples": (
        lambda s, d: R.thickened(paths(s, d).withColumn("row", F.floor("row").cast("int")).withColumn("width", F.col("col") % 8), ["edge"], "width").groupBy("edge", "row", "col").agg(F.count("*").alias("n")),
        with_("paths") + ", w AS (SELECT edge, floor(row)::INT AS row, col, round_even(col % 8 / 2::DOUBLE, 0)::INT AS r FROM paths), x AS (SELECT edge, row, col, r, unnest(range(-r, r + 1)) AS dr FROM w), y AS (SELECT *, unnest(range(-r, r + 1)) AS dc FROM x) SELECT edge, (row + dr)::INT AS row, (col + dc)::INT AS col, count(*) AS n FROM y WHERE dr * dr + dc * dc <= r * r GROUP BY ALL",
    ),
    "junction_exclusion": (
        lambda s, d: R.minus(mask(s, d), R.exclusion(_seeds(s, d), 1)),
        with_("prob", "mask") + "SELECT image, row, col FROM mask m WHERE NOT EXISTS (SELECT 1 FROM mask k WHERE k.image = m.image AND (k.row * 8 + k.col + k.image) % 9 = 0 AND abs(k.row - m.row) <= 1 AND abs(k.col - m.col) <= 1)",
    ),
    "nearest_seed": (
        lambda s, d: tiles.nearest(mask(s, d), _seeds(s, d)).na.fill(-1),
        with_("prob", "mask") + ", sd AS (SELECT *, row * 8 + col AS seed FROM mask WHERE (row * 8 + col + image) % 9 = 0), c AS (SELECT m.image, m.row, m.col, seed, (m.row - sd.row) * (m.row - sd.row) + (m.col - sd.col) * (m.col - sd.col) AS d2 FROM mask m JOIN sd ON sd.image = m.image), k AS (SELECT *, row_number() OVER (PARTITION BY image, row, col ORDER BY d2, seed) AS n FROM c) SELECT m.image, m.row, m.col, coalesce(seed, -1) AS seed, coalesce(d2, -1) AS d2 FROM mask m LEFT JOIN k ON k.image = m.image AND k.row = m.row AND k.col = m.col AND n = 1",
    ),
    "distance_transform": (
        lambda s, d: tiles.distances(mask(s, d), SIDE, SIDE),
        with_("prob", "mask") + ", bg AS (SELECT image, row, col FROM prob ANTI JOIN mask USING (image, row, col)) SELECT m.image, m.row, m.col, min((m.row - b.row) * (m.row - b.row) + (m.col - b.col) * (m.col - b.col))::BIGINT AS d2 FROM mask m LEFT JOIN bg b ON b.image = m.image GROUP BY ALL",
    ),
    "normalise_per_group": (
        lambda s, d: R.to_bytes(prob(s, d)).groupBy("image", "level").agg(F.count("*").alias("n")),
        with_("prob") + "SELECT image, coalesce(floor(greatest(p, 0) / nullif(m, 0) * 255), 0)::INT AS level, count(*) AS n FROM (SELECT *, max(p) OVER (PARTITION BY image) AS m FROM prob) GROUP BY ALL",
    ),
    "thin_and_trace": (_thin_and_trace, None),
}
