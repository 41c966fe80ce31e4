"""Contrast equalisation and tile inference against plain computations on drawn planes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import contrast, inference


def equalised_brute(plane, grid, clip):
    h, w = plane.shape
    if h % grid or w % grid:
        padded = np.pad(plane, ((0, grid - h % grid), (0, grid - w % grid)), "reflect")
    else:
        padded = plane
    th, tw = padded.shape[0] // grid, padded.shape[1] // grid
    size = th * tw
    limit = max(1, int(clip * size / 256))
    tables = np.zeros((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                step = max(256 // rest, 1)
                k = 0
                while k < 256 and rest:
                    n[k] += 1
                    k, rest = k + step, rest - 1
            tables[i, j] = np.clip(np.rint(np.cumsum(n) * 255 / size), 0, 255)
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            i, j = int(np.floor(fy)), int(np.floor(fx))
            a, b = fy - i, fx - j
            i2, j2, i, j = min(i + 1, grid - 1), min(j + 1, grid - 1), max(i, 0), max(j, 0)
            t = tables[:, :, plane[y, x]]
            out[y, x] = np.rint((t[i, j] * (1 - b) + t[i, j2] * b) * (1 - a) + (t[i2, j] * (1 - b) + t[i2, j2] * b) * a)
    return out


@pytest.mark.parametrize(("grid", "clip"), [(4, 2.0), (8, 40.0)])
def test_contrast_is_that_of_plain_loops(spark, grid, clip):
    rng = np.random.default_rng(2)
    planes = {"even": rng.integers(90, 140, (32, 40)), "odd": (rng.normal(100, 20, (37, 45))).clip(0, 255).astype(int), "half": rng.integers(0, 256, (40, 29))}
    levels = spark.createDataFrame([(k, int(r), int(c), int(v)) for k, p in planes.items() for (r, c), v in np.ndenumerate(p)], "image string, row int, col int, level int")
    frames = spark.createDataFrame([(k, *p.shape) for k, p in planes.items()], "image string, height int, width int")
    got = {k: np.full(p.shape, -1) for k, p in planes.items()}
    for r in contrast.equalised(levels, frames, grid, clip).collect():
        got[r["image"]][r["row"], r["col"]] = r["level"]
    for k, p in planes.items():
        assert (got[k] == equalised_brute(p, grid, clip)).all(), k


def test_colours_come_back_and_hues_stay(spark):
    rng = np.random.default_rng(3)
    rows = [("x", r, c, *(int(v) for v in rng.integers(0, 256, 3))) for r in range(16) for c in range(16)] + [("x", 16, 0, 0, 0, 0), ("x", 16, 1, 255, 255, 255), ("x", 16, 2, 0, 0, 255)]
    planes = spark.createDataFrame(rows, "image string, row int, col int, b int, g int, r int")
    light, a, b = contrast.lightness(F.col("b"), F.col("g"), F.col("r"))
    lab = planes.select("*", light.alias("ll"), a.alias("la"), b.alias("lb"))
    back = lab.select("row", "col", "b", "g", "r", "ll", "la", "lb", *(x.alias(n) for x, n in zip(contrast.colour(F.col("ll"), F.col("la"), F.col("lb")), ("bb", "gg", "rr"), strict=True))).collect()
    # known corners: black, white, red
    named = {(r["b"], r["g"], r["r"]): (r["ll"], r["la"], r["lb"]) for r in back}
    assert named[0, 0, 0] == (0, 128, 128) and named[255, 255, 255] == (255, 128, 128) and named[0, 0, 255] == (136, 208, 195)
    assert np.mean([max(abs(r["b"] - r["bb"]), abs(r["g"] - r["gg"]), abs(r["r"] - r["rr"])) for r in back]) < 4
    frames = spark.createDataFrame([("x", 17, 16)], "image string, height int, width int")
    grey = planes.withColumns({"b": F.col("g"), "r": F.col("g")})
    out = contrast.equalised_colours(grey, frames, 2).collect()
    assert len(out) == len(rows) and all(max(r["b"], r["g"], r["r"]) - min(r["b"], r["g"], r["r"]) <= 2 for r in out)


def pointwise():
    return lambda x: x @ np.array([1.0, -2.0, 0.5], "f4")


def stencil():
    def model(x):
        v = np.pad(x.sum(axis=3), ((0, 0), (1, 1), (1, 1)))
        return v[:, 1:-1, :-2] + 2 * v[:, :-2, 1:-1] - v[:, 1:-1, 1:-1]

    return model


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(4)
    planes = {"large": rng.integers(0, 256, (37, 61, 3)), "small": rng.integers(0, 256, (5, 20, 3)), "dot": rng.integers(0, 256, (1, 1, 3)), "even": rng.integers(0, 256, (24, 16, 3))}
    rows = spark.createDataFrame([(k, r, c, *(int(v) for v in p[r, c])) for k, p in planes.items() for r in range(p.shape[0]) for c in range(p.shape[1])], "image string, row int, col int, b int, g int, r int")
    return planes, rows, spark.createDataFrame([(k, *p.shape[:2]) for k, p in planes.items()], "image string, height int, width int")


def as_planes(rows, planes):
    got = {k: np.full(p.shape[:2], np.nan) for k, p in planes.items()}
    for r in rows.collect():
        assert np.isnan(got[r["image"]][r["row"], r["col"]])
        got[r["image"]][r["row"], r["col"]] = r["p"]
    return got


def scaled(p):
    return (p[:, :, ::-1].astype("f4") / 255 - 0.5) / 0.5


@pytest.mark.parametrize(("tile", "stride"), [(16, 8), (16, 16), (24, 7)])
def test_tiles_give_what_the_whole_image_gives(images, tile, stride):
    planes, rows, frames = images
    got = as_planes(inference.inferred(rows, frames, pointwise, tile, stride, batch=3), planes)
    for k, p in planes.items():
        assert np.abs(got[k] - 1 / (1 + np.exp(-pointwise()(scaled(p)).astype(float)))).max() < 1e-5


def test_tiles_are_those_cut_by_hand(images):
    planes, rows, frames = images
    got = {(r["image"], r["y"], r["x"]): np.array(r["pixels"], "f4").reshape(16, 16, 3) for r in inference.tiles(rows, frames, 16, 10).collect()}
    for k, p in planes.items():
        h, w = p.shape[:2]
        padded = np.pad(p, ((0, max(0, 16 - h)), (0, max(0, 16 - w)), (0, 0)), "reflect")
        origins = [sorted({*range(0, n - 15, 10), n - 16}) for n in padded.shape[:2]]
        assert {(y, x) for i, y, x in got if i == k} == {(y, x) for y in origins[0] for x in origins[1]}
        for y in origins[0]:
            for x in origins[1]:
                assert np.abs(got[k, y, x] - scaled(padded[y : y + 16, x : x + 16])).max() < 1e-6


def test_flips_are_averaged_before_the_sigmoid(images):
    planes, rows, frames = images
    got = as_planes(inference.inferred(rows, frames, stencil, 64, 32), planes)
    for k, p in planes.items():
        h, w = p.shape[:2]
        x = np.pad(scaled(p), ((0, 64 - h), (0, 64 - w), (0, 0)), "reflect")[None]
        model = stencil()
        logits = (model(x) + model(x[:, :, ::-1])[:, :, ::-1] + model(x[:, ::-1])[:, ::-1]) / 3
        assert np.abs(got[k] - (1 / (1 + np.exp(-logits)))[0, :h, :w]).max() < 1e-5
    with pytest.raises(ValueError, match="stride"):
        inference.inferred(rows, frames, stencil, 8, 9)


def test_one_large_image_is_spread_over_tasks_and_each_tile_is_scored_once(spark, tmp_path):
    """However few images there are: pixels meet by place, not by image."""
    from pyspark.sql import functions as F

    planes = spark.range(96).select(F.lit(0).cast("long").alias("image"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(95))).alias("col"))
    planes = planes.select("*", *(F.lit(k).alias(c) for k, c in enumerate("bgr")))
    frames = spark.createDataFrame([(0, 96, 96)], "image long, height int, width int")
    told = str(tmp_path)

    def make():
        import uuid

        def model(x):
            with open(f"{told}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(len(x)))
            return x[..., 0]

        return model

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r[1] for r in inference.inferred(planes, frames, make, 16, 8, flips=False).groupBy(F.spark_partition_id().alias("part")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 96 * 96 and max(parts) < 96 * 96 / 2
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 11 * 11
