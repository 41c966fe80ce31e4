"""The feature table of drawn graphs, its blocks against plain computations."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import line, pixels
from weft.operators import features, raster, skeleton_graph, tiles

SIZE = 60
DRAWN = {
    1: line((30, 30), (10, 30)) | line((30, 30), (45, 12)) | line((30, 30), (45, 48)),
    2: {(r, c) for r in range(20, 41) for c in range(20, 41) if r in (20, 40) or c in (20, 40)},
    3: line((25, 0), (25, 40)),
}


@pytest.fixture(scope="module")
def built(spark):
    masks = None
    for image, points in DRAWN.items():
        part = pixels(spark, points, image)
        masks = part if masks is None else masks.unionByName(part)
    nodes, edges, paths = (x.cache() for x in skeleton_graph.build(tiles.thinned(masks), 2))
    distance = tiles.distances(masks, SIZE, SIZE).select("image", "row", "col", F.sqrt(F.col("d2").cast("double")).alias("distance"))
    frame = raster.frame(masks, SIZE, SIZE)
    prob = frame.select("image", "row", "col", ((F.col("row") * 7 + F.col("col") * 3) % 11 / 11.0).alias("p"))
    planes = frame.select("image", "row", "col", ((F.col("row") * 13 + F.col("col") * 5) % 251).alias("grey"), ((F.col("row") + F.col("col")) % 97).alias("saturation"))
    out = features.table(nodes, edges, paths, SIZE, SIZE, masks, distance, prob, planes).toPandas()
    return nodes.toPandas(), edges.toPandas(), paths.toPandas(), out


def test_columns_have_their_names(built):
    out = built[3]
    assert len(features.names()) == 195 and list(out.columns) == ["image", "group", "component", "edge", "u", "v", "row", "col", *features.names()]
    assert len(out) == len(built[1]) and not out["edge"].duplicated().any()


def test_geometry_series_and_border(built):
    nodes, edges, paths, out = built
    out = out.set_index("edge")
    for edge, p in paths.sort_values("pos").groupby("edge"):
        r, c = p["row"].to_numpy(float), p["col"].to_numpy(float)
        f = out.loc[edge]
        length = np.hypot(np.diff(r), np.diff(c)).sum()
        assert math.isclose(f["length_px"], length, abs_tol=1e-9) and f["pixel_count"] == len(p) and math.isclose(f["row"], r.mean())
        prob = (r * 7 + c * 3) % 11 / 11.0
        assert math.isclose(f["prob_mean"], prob.mean()) and math.isclose(f["prob_p90"], np.percentile(prob, 90)) and f["prob_available"] == 1
        grey = (r * 13 + c * 5) % 251
        assert math.isclose(f["line_gray_mean"], grey.mean()) and math.isclose(f["line_gray_std"], grey.std(), abs_tol=1e-9)
        rows = np.arange(max(0, r.min() - 7), min(SIZE, r.max() + 8))
        cols = np.arange(max(0, c.min() - 7), min(SIZE, c.max() + 8))
        patch = (rows[:, None] * 13 + cols[None, :] * 5) % 251
        assert math.isclose(f["patch_gray_std"], patch.std(), rel_tol=1e-9) and f["sample_count"] == len(p)
        step = 5
        dr, dc = r[step:] - r[:-step], c[step:] - c[:-step]
        w, a = np.hypot(dr, dc), np.arctan2(dr, dc) % math.pi
        if not len(w):
            assert math.isnan(f["orientation_anisotropy"]) and f["orientation_hist_00"] == 0
            continue
        total = np.hypot((w * np.cos(2 * a)).sum(), (w * np.sin(2 * a)).sum()) / w.sum()
        assert math.isclose(f["orientation_anisotropy"], min(1, total), abs_tol=1e-9)
        assert math.isclose(sum(f[f"orientation_hist_{b:02d}"] for b in range(12)), 1)
    assert out.loc[out["image"] == 3, "touches_border"].tolist() == [1.0] and out.loc[out["image"] == 3, "both_ends_border"].tolist() == [0.0]


def test_structure_of_a_fork_a_ring_and_a_line(built):
    out = built[3]
    fork, ring, single = (out[out["image"] == k] for k in (1, 2, 3))
    for p in ("comp", "local"):
        assert set(fork[f"{p}_node_count"]) == {4} and set(fork[f"{p}_edge_count"]) == {3} and set(fork[f"{p}_cycle_rank"]) == {0}
        assert set(fork[f"{p}_endpoint_count"]) == {3} and set(fork[f"{p}_junction_count"]) == {1} and set(fork[f"{p}_junction_ratio"]) == {0.25}
        assert np.allclose(fork[f"{p}_length_total"], fork["length_px"].sum()) and np.allclose(fork[f"{p}_length_std"], fork["length_px"].std(ddof=0))
        assert set(ring[f"{p}_cycle_rank"]) == {1} and set(ring[f"{p}_node_count"]) == {1}
    assert np.allclose(fork["local_length_share"].sum(), 1) and set(single["comp_free_endpoint_count"]) == {1} and set(single["comp_endpoint_count"]) == {2}
    assert set(ring["is_loop"]) == {1} and set(ring["strict_face_count"]) == {1} and set(ring["strict_borders_face"]) == {1} and ring["strict_face_area_max"].iloc[0] >= 19 * 19
    assert set(fork["strict_face_count"]) == {0} and set(ring["comp_strict_face_count"]) == {1} and set(ring["comp_face_closure_gain"]) == {0}


def test_node_features(built):
    out = built[3]
    fork = out[out["image"] == 1]
    assert set(fork["node_degree_max"]) == {3} and set(fork["node_degree_min"]) == {1} and set(fork["free_end_count"]) == {1}
    assert set(fork["node_type_junction_max"]) == {1} and set(fork["node_type_endpoint_mean"]) == {0.5}
    angles = fork["node_branch_angle_max_max"].iloc[0], fork["node_branch_angle_orthogonality_max"].iloc[0]
    assert 30 < angles[0] <= 90 and 0 <= angles[1] <= 1


def test_without_rasters_features_are_missing_not_zero(spark):
    nodes, edges, paths = skeleton_graph.build(pixels(spark, DRAWN[3], 3))
    r = features.table(nodes, edges, paths, SIZE, SIZE).first()
    assert r["width_mean"] is None and r["prob_mean"] is None and r["prob_available"] == 0 and r["appearance_available"] == 0 and r["comp_strict_face_count"] is None and r["length_px"] == 40


def test_an_image_is_not_changed_by_another(spark):
    """A ring with a line six pixels off it, alone and beside a large blob, whose distances are greater."""
    ring = {(r, c) for r in range(5, 26) for c in range(5, 26)} - {(r, c) for r in range(7, 24) for c in range(7, 24)}
    line = {(r, 32) for r in range(8, 22)}
    blob = {(r, c) for r in range(5, 55) for c in range(5, 55)}
    both = spark.createDataFrame([("a", r, c) for r, c in ring | line] + [("b", r, c) for r, c in blob], "image string, row int, col int")

    def faces(mask):
        nodes, edges, px = skeleton_graph.build(tiles.thinned(mask), 2)
        distance = tiles.distances(mask, 64, 64).select("image", "row", "col", F.sqrt(F.col("d2").cast("double")).alias("distance"))
        rows = features.table(nodes, edges, px, 64, 64, mask=mask, distance=distance).filter("image = 'a'").collect()
        return sorted((r["row"], r["col"], r["strict_face_count"], r["tolerant_face_count"], r["strict_face_area_max"]) for r in rows)

    alone = faces(both.filter("image = 'a'"))
    assert alone == faces(both) and len(alone) == 2 and {x[2] for x in alone} == {0.0, 1.0}
