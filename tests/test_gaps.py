"""Choice of source, noise and gap repair on drawn masks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import line, pixels
from weft.operators import gaps, graph, skeleton_graph
from weft.plans.catalogue import QUERIES


def scores(spark, points, inside, value, images=(1,)):
    rows = [(k, r, c, 0.9 if (r, c) in points else value if (r, c) in inside else 0.0) for k in images for r in range(40) for c in range(45)]
    return spark.createDataFrame(rows, "image long, row int, col int, p double")


LEFT, RIGHT = line((20, 5), (20, 18)), line((20, 22), (20, 35))
GAP = {(20, c) for c in range(19, 22)}


def test_an_aligned_gap_is_bridged(spark):
    mask = pixels(spark, LEFT | RIGHT)
    won, px, rejected = gaps.bridges(mask, scores(spark, LEFT | RIGHT, GAP, 0.4), 6, 25, 0.2)
    (b,) = won.collect()
    assert b["distance"] == 4 and b["angle_start"] < 1e-6 and abs(b["mean_p"] - 0.4) < 1e-9 and rejected.count() == 0
    filled = gaps.repaired(mask, scores(spark, LEFT | RIGHT, GAP, 0.4), 6, 25, 0.2)
    assert {(r["row"], r["col"]) for r in filled.collect()} == LEFT | RIGHT | GAP


def test_other_gaps_stay_open(spark):
    for points, inside, value, reason in ((LEFT | {(r, 22) for r in range(20, 34)}, GAP, 0.4, "angle"), (LEFT | RIGHT, GAP, 0.0, "confidence")):
        won, _, rejected = gaps.bridges(pixels(spark, points), scores(spark, points, inside, value), 6, 25, 0.2)
        assert won.count() == 0 and {r["reason"]: r["n"] for r in rejected.collect()} == {reason: 1}


def test_scores_come_before_masks(spark):
    prob = spark.createDataFrame([(1, 8, c, 0.9) for c in range(5)], "image long, row int, col int, p double")
    mask = spark.createDataFrame([(k, 8, c, 255 * (c > 1)) for k in (1, 2) for c in range(10)], "image long, row int, col int, value int")
    got = gaps.binarized(prob, mask, 0.6, 0.25, 127)
    assert {(r["image"], r["available"], r["n"]) for r in got.groupBy("image", "available").agg(F.count("*").alias("n")).collect()} == {(1, True, 5), (2, False, 8)}
    with pytest.raises(ValueError):
        gaps.binarized(None, None, 0.6, 0.25, 127)


def test_noise_goes_by_the_first_reason(spark):
    # a bar twice as long as wide thins to more than three pixels, and is not elongated enough
    speck, blob = {(3, 3)}, {(r, c) for r in range(30, 34) for c in range(30, 38)}
    points = line((20, 5), (20, 30)) | speck | blob
    kept, judged = gaps.without_noise(pixels(spark, points), None, 3, 0.0, 4.0, 0.0)
    assert {(r["row"], r["col"]) for r in kept.collect()} == line((20, 5), (20, 30))
    assert sorted(r["reason"] or "" for r in judged.collect()) == ["", "elongation", "skeleton_length"]
    whole = gaps.preprocessed(scores(spark, LEFT | RIGHT, GAP, 0.2), None, pixels=3, gap=6)
    assert {(r["row"], r["col"]) for r in whole.collect()} == LEFT | RIGHT | GAP


def test_points_at_one_place_pair_off_without_all_their_pairs(spark):
    """As taking all pairs one by one; 4000 points at one place have 8 million pairs."""
    from weft.operators.graph import pairs_within

    rows = [(k % 2, k * 7 % 101, k % 5, k * k % 4) for k in range(101)]
    points = spark.createDataFrame(rows, "image int, point int, row int, col int")
    want = {tuple(r) for r in skeleton_graph.greedy_pairs(pairs_within(points, 2.0)).select("image", "a", "b", "distance").collect()}
    got = [tuple(r) for r in skeleton_graph.greedy_within(points, 2.0).select("image", "a", "b", "distance").collect()]
    assert set(got) == want and len(got) == len(want) > 20
    heap = spark.range(4001).select(F.lit(0).alias("image"), F.col("id").alias("point"), F.lit(3).alias("row"), F.lit(4).alias("col"))
    got = skeleton_graph.greedy_within(heap, 2.0)
    assert got.count() == 2000 and got.filter("b <> a + 1 or a % 2 = 1 or distance > 0").isEmpty()


def test_near_points_are_found_by_their_places(spark):
    """As comparing every two rows; 3000 points at one place meet as blocks, not as 4.5 million pairs."""
    from weft.operators import graph

    rows = [(k % 2, f"p{k * 7 % 101:03d}", k % 5 - 2, k * k % 4) for k in range(101)] + [(0, "p007", 2, 1), (None, "p1", 0, 0), (0, None, 0, 0), (1, "p2", None, 0)]
    points = spark.createDataFrame(rows, "image int, point string, row int, col int")
    whole = [r for r in rows if None not in r]
    want = sorted((i, a, b, round(((r - r2) ** 2 + (c - c2) ** 2) ** 0.5, 6), r, c, r2, c2) for i, a, r, c in whole for i2, b, r2, c2 in whole if i == i2 and a < b and (r - r2) ** 2 + (c - c2) ** 2 <= 4)
    got = graph.pairs_within(points, 2.0, places=True).select("image", "a", "b", F.round("distance", 6), "row", "col", "row2", "col2")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    heap = spark.range(3000).select(F.lit(0).alias("image"), F.col("id").alias("point"), F.lit(3).alias("row"), F.lit(4).alias("col"))
    blocks = graph.near_places(heap, 2.0)
    assert blocks.count() == 12 * 13 // 2
    pairs = graph.points_of(blocks)
    assert pairs.count() == pairs.filter("a < b and distance = 0").count() == 3000 * 2999 // 2


def test_pairs_do_not_depend_on_the_size_of_blocks(spark):
    """Small blocks give each pair of a heap once, as large ones do, and few pairs to two of them."""
    heap = spark.range(300).select(F.lit(0).alias("image"), F.col("id").alias("point"), (F.col("id") % 3).alias("row"), F.lit(4).alias("col"))
    blocks = graph.near_places(heap, 1.0, graph.SMALL_BLOCK)
    assert blocks.selectExpr("max(size(points) * size(points2))").first()[0] == graph.SMALL_BLOCK**2
    got = sorted(map(tuple, graph.points_of(blocks).select("a", "b", "distance").collect()))
    assert got == [(a, b, float(abs(a % 3 - b % 3))) for a in range(300) for b in range(a + 1, 300) if abs(a % 3 - b % 3) < 2]


def test_segments_are_made_once_for_two_places(spark, sf_dir):
    """Below the rows of nodes, not for each pair of them."""
    lines = QUERIES["gap_segments"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [n for n, line in enumerate(lines) if "transform(" in line]
    assert len(made) == 1 and made[0] > max(n for n, line in enumerate(lines) if "Generate explode(points" in line)


def test_noise_labels_the_mask_alone(spark, monkeypatch):
    """The skeleton takes the mask's components; its own would be thrown away."""
    calls, labelled = [], gaps.raster.labelled
    monkeypatch.setattr(gaps.raster, "labelled", lambda *a: calls.append(a) or labelled(*a))
    mask = spark.createDataFrame([(1, 0, c) for c in range(6)] + [(1, 4, 4)], "image long, row int, col int")
    _, judged = gaps.without_noise(mask, None, 2, 1.0, 1.0, 0.5)
    assert sorted((r["pixels"], r["skeleton"], r["reason"]) for r in judged.collect()) == [(1, 1, "skeleton_length"), (6, 6, None)] and len(calls) == 1
