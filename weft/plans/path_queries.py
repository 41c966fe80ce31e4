"""Queries on ordered paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import paths as P
from weft.plans.relations import paths, with_
from weft.plans.sweep_queries import rounded
from weft import streaming
from weft.session import table

_GEOMETRY = with_("paths") + """, s AS (
  SELECT *, sqrt(power(row - lag(row) OVER w, 2) + power(col - lag(col) OVER w, 2)) AS step FROM paths WINDOW w AS (PARTITION BY edge ORDER BY pos)
), g AS (
  SELECT edge, count(*) AS pixel_count, coalesce(sum(step), 0) AS length_px, sqrt(power(arg_max(row, pos) - arg_min(row, pos), 2) + power(arg_max(col, pos) - arg_min(col, pos), 2)) AS chord_px,
         max(row) - min(row) + 1 AS bbox_height, (max(col) - min(col) + 1)::DOUBLE AS bbox_width, var_pop(row) AS a, covar_pop(row, col) AS b, var_pop(col) AS c FROM s GROUP BY edge
)
SELECT edge, pixel_count, round(length_px, 6) AS length_px, round(chord_px, 6) AS chord_px, round(CASE WHEN abs(chord_px) > 1e-6 THEN length_px / chord_px END, 6) AS tortuosity,
       round(CASE WHEN abs(length_px) > 1e-6 THEN chord_px / length_px END, 6) AS straightness,
       round(CASE WHEN pixel_count < 3 THEN 0 ELSE sqrt(greatest((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 0)) END, 6) AS residual,
       round(bbox_height, 6) AS bbox_height, bbox_width, round(sqrt(bbox_height * bbox_height + bbox_width * bbox_width), 6) AS bbox_diagonal, round(pixel_count / (bbox_height * bbox_width), 6) AS bbox_fill
FROM g"""

_CURVATURE = with_("paths") + """, k AS (
  SELECT edge, pos, row, col FROM (SELECT *, count(*) OVER (PARTITION BY edge) AS n FROM paths) WHERE n <= 2 OR pos % 5 = 0 OR pos = n - 1
), s AS (
  SELECT *, row - lag(row) OVER w AS dr, col - lag(col) OVER w AS dc FROM k WINDOW w AS (PARTITION BY edge ORDER BY pos)
), a AS (
  SELECT edge, pos, sqrt(dr * dr + dc * dc) AS step, atan2(dr, dc) AS angle FROM s WHERE dr * dr + dc * dc > 0
), d AS (
  SELECT edge, angle - lag(angle) OVER w + pi() AS x, (step + lag(step) OVER w) / 2 AS span FROM a WINDOW w AS (PARTITION BY edge ORDER BY pos)
), t AS (
  SELECT edge, x - 2 * pi() * floor(x / (2 * pi())) - pi() AS turn, span FROM d
), g AS (
  SELECT edge, avg(abs(turn) / span) AS m, max(abs(turn) / span) AS x, stddev_pop(abs(turn) / span) AS s, sum(abs(turn)) AS t, sum(turn) AS n FROM t GROUP BY edge
)
SELECT edge, round(coalesce(m, 0), 6) AS curvature_mean, round(coalesce(x, 0), 6) AS curvature_max, round(coalesce(s, 0), 6) AS curvature_std, round(coalesce(t, 0), 6) AS turn_total, round(coalesce(n, 0), 6) AS turn_net
FROM (SELECT DISTINCT edge FROM paths) LEFT JOIN g USING (edge)"""

_ORIENTATION = with_("paths") + """, s AS (
  SELECT edge, lead(row) OVER w - row AS dr, lead(col) OVER w - col AS dc FROM paths WINDOW w AS (PARTITION BY edge ORDER BY pos)
), a AS (
  SELECT edge, sqrt(dr * dr + dc * dc) AS w, atan2(dr, dc) AS x FROM s WHERE dr * dr + dc * dc > 0
), m AS (
  SELECT edge, w, x - pi() * floor(x / pi()) AS angle FROM a
), b AS (
  SELECT *, least(floor(angle * 12 / pi()), 11)::INT AS bin FROM m
), g AS (
  SELECT edge, sum(w) AS t, sum(w * cos(2 * angle)) AS c, sum(w * sin(2 * angle)) AS s FROM b GROUP BY edge
), h AS (
  SELECT edge, bin, sum(w) / any_value(t) AS h FROM b JOIN g USING (edge) GROUP BY edge, bin
), e AS (
  SELECT edge, sum(CASE WHEN h > 0 THEN -h * ln(h) ELSE 0 END) / ln(12) AS entropy FROM h GROUP BY edge
)
SELECT edge, round(degrees(atan2(s, c)) / 2 - 180 * floor(degrees(atan2(s, c)) / 360), 6) AS dominant_deg, round(least(1, sqrt(c * c + s * s) / t), 6) AS anisotropy, round(1 - least(1, sqrt(c * c + s * s) / t), 6) AS variance, round(entropy, 6) AS entropy
FROM g JOIN e USING (edge)"""


def _elongation(s, d):
    """The ratio is not stable where points lie on a line: those paths are marked instead."""
    line = F.col("elongation") >= 1000
    return P.elongation(paths(s, d), ["edge"]).select("edge", F.when(~line, F.round("elongation", 3)).alias("elongation"), line.alias("on_a_line"))


QUERIES = {
    "path_geometry": (lambda s, d: rounded(P.geometry(paths(s, d), ["edge"])), _GEOMETRY),
    "path_curvature": (lambda s, d: rounded(P.curvature(paths(s, d), ["edge"])), _CURVATURE),
    "path_orientation": (lambda s, d: rounded(P.orientation(paths(s, d), ["edge"])).select("edge", "dominant_deg", "anisotropy", "variance", "entropy"), _ORIENTATION),
    "series_stats": (
        lambda s, d: rounded(P.series(paths(s, d), ["edge"], "row", "v")),
        with_("paths") + "SELECT edge, round(avg(row), 6) AS v_mean, round(stddev_pop(row), 6) AS v_std, round(min(row), 6) AS v_min, round(max(row), 6) AS v_max, round(quantile_cont(row, 0.1), 6) AS v_p10, round(quantile_cont(row, 0.9), 6) AS v_p90, round(CASE WHEN abs(avg(row)) > 1e-9 THEN stddev_pop(row) / avg(row) END, 6) AS v_cv FROM paths GROUP BY edge",
    ),
    "path_normals": (
        lambda s, d: rounded(P.normals(paths(s, d), ["edge"])).select("edge", F.col("pos").cast("long").alias("pos"), (F.col("normal_row") + 0.0).alias("normal_row"), (F.col("normal_col") + 0.0).alias("normal_col")),
        with_("paths") + ", x AS (SELECT edge, pos, coalesce(lead(row) OVER w, row) - coalesce(lag(row) OVER w, row) AS dr, (coalesce(lead(col) OVER w, col) - coalesce(lag(col) OVER w, col))::DOUBLE AS dc FROM paths WINDOW w AS (PARTITION BY edge ORDER BY pos)), n AS (SELECT *, CASE WHEN dr * dr + dc * dc > 0 THEN sqrt(dr * dr + dc * dc) ELSE 1 END AS n FROM x) SELECT edge, pos, round(-dc / n, 6) + 0.0 AS normal_row, round(dr / n, 6) + 0.0 AS normal_col FROM n",
    ),
    "path_broken": (
        lambda s, d: rounded(P.broken(paths(s, d), ["edge"])),
        with_("paths") + ", x AS (SELECT edge, abs(row - lag(row) OVER w) AS dr, abs(col - lag(col) OVER w) AS dc FROM paths WINDOW w AS (PARTITION BY edge ORDER BY pos)) SELECT edge, round(max(greatest(dr, dc)), 6) AS widest FROM x GROUP BY edge HAVING max(greatest(dr, dc)) > 1",
    ),
    "path_midpoint": (
        lambda s, d: P.midpoint(paths(s, d), ["edge"]),
        with_("paths") + "SELECT edge, row, col FROM (SELECT *, count(*) OVER (PARTITION BY edge) AS n FROM paths) WHERE pos = n // 2",
    ),
    "elongation": (
        _elongation,
        with_("paths") + ", g AS (SELECT edge, var_samp(row) AS a, covar_samp(row, col) AS b, var_samp(col) AS c FROM paths GROUP BY edge), e AS (SELECT edge, sqrt(greatest((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 0) / (greatest((a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 0) + 1e-9)) AS elongation FROM g) SELECT edge, CASE WHEN elongation < 1000 THEN round(elongation, 3) END AS elongation, elongation >= 1000 AS on_a_line FROM e",
    ),
    "json_props": (
        lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n")),
        with_("paths") + "SELECT col AS k, count(*) AS n FROM paths GROUP BY col",
    ),
    "hourly_events": (
        lambda s, d: rounded(streaming.hourly(table(s, d, "events"))).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH")),
        "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    ),
    "user_sessions": (
        lambda s, d: streaming.sessions(table(s, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
        "WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)), c AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    ),
}
