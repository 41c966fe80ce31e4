"""Thinning, distances and nearest seeds over tiles against the same on whole images."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import kernels, tiles
from weft.session import sized, stored

PIXELS = "image string, row int, col int"


def blobs(rng, height, width, many):
    """A mask of thick lines and discs, which cross the tiles of any size."""
    grid = np.zeros((height, width), bool)
    for _ in range(many):
        (r, c), (dr, dc), thick = rng.integers(0, (height, width)), rng.normal(size=2), rng.integers(1, 6)
        for k in range(rng.integers(5, 60)):
            y, x = int(r + k * dr), int(c + k * dc)
            grid[max(0, y - thick) : max(0, y + thick), max(0, x - thick) : max(0, x + thick)] = True
    return grid


@pytest.fixture(scope="module")
def grids():
    rng = np.random.default_rng(8)
    return {"a": blobs(rng, 70, 90, 9), "b": rng.random((40, 61)) < 0.7, "c": blobs(rng, 30, 30, 2), "full": np.ones((37, 23), bool), "dot": np.eye(1, dtype=bool)}


def as_rows(spark, grids, shift=0):
    return spark.createDataFrame([(k, int(r) + shift, int(c) + shift) for k, g in grids.items() for r, c in np.argwhere(g)], PIXELS)


def found(rows):
    return {(r["image"], r["row"], r["col"]) for r in rows.collect()}


@pytest.mark.parametrize(("side", "halo", "shift"), [(8, 4, 0), (16, 8, 5), (32, 32, 3), (256, 16, 250)])
def test_thinning_is_the_same_at_any_tile_size(spark, grids, side, halo, shift):
    want = set()
    for k, g in grids.items():
        r, c = np.argwhere(g).min(axis=0)
        padded = np.pad(g[r:, c:], 1)
        want |= {(k, int(i) + r - 1 + shift, int(j) + c - 1 + shift) for i, j in np.argwhere(kernels.thin(padded))}
    assert found(tiles.thinned(as_rows(spark, grids, shift), side, halo)) == want


def test_tiles_hold_no_more_than_their_side(spark, grids):
    at = tiles.tiled(as_rows(spark, grids), 16)
    assert at.count() > 30 and all(len(r["bits"]) == 32 for r in at.collect())
    assert found(tiles.pixels_of(at, 16)) == found(as_rows(spark, grids))
    with pytest.raises(ValueError, match="multiple of 4"):
        tiles.thinned(as_rows(spark, grids), 16, 6)


def test_an_empty_mask_stays_empty(spark, grids):
    none = as_rows(spark, grids).limit(0)
    assert tiles.thinned(none).count() == 0 and tiles.distances(none, 9, 9).count() == 0


@pytest.mark.parametrize("band", [1, 7, 64])
def test_distances_are_those_of_all_pairs(spark, grids, band):
    got = {k: {} for k in grids}
    for r in tiles.distances(as_rows(spark, {k: g for k, g in grids.items() if k != "full"}), 200, 200, band).collect():
        got[r["image"]][r["row"], r["col"]] = r["d2"]
    for k in ("a", "b", "c"):
        g = np.zeros((200, 200), bool)
        g[: grids[k].shape[0], : grids[k].shape[1]] = grids[k]
        off = np.argwhere(~g)
        assert got[k] == {(int(r), int(c)): int(((off - (r, c)) ** 2).sum(axis=1).min()) for r, c in np.argwhere(g)}
    assert all(r["d2"] is None for r in tiles.distances(as_rows(spark, {"full": grids["full"]}), 37, 23, band).collect())


@pytest.mark.parametrize("band", [1, 5, 64])
def test_nearest_seeds_are_those_of_all_pairs(spark, grids, band):
    rng = np.random.default_rng(9)
    seeds = {k: [(int(r), int(c), int(s)) for r, c, s in zip(rng.integers(0, 90, n), rng.integers(-0, 120, n), rng.integers(-4, 5, n), strict=True)] for k, n in (("a", 25), ("b", 3), ("c", 1), ("dot", 40), ("other", 9))}
    rows = spark.createDataFrame([(k, *s) for k, ss in seeds.items() for s in ss], f"{PIXELS}, seed int")
    got = tiles.nearest(as_rows(spark, grids), rows, band).collect()
    assert len(got) == sum(int(g.sum()) for g in grids.values())
    for r in got:
        want = min((((r["row"] - y) ** 2 + (r["col"] - x) ** 2, s) for y, x, s in seeds.get(r["image"], [])), default=(None, None))
        assert (r["d2"], r["seed"]) == want


def test_images_may_be_numbers(spark):
    mask = spark.createDataFrame([(7, 3, c) for c in range(300)], "image long, row int, col int")
    seeds = spark.createDataFrame([(7, 900, 5, 2), (7, 3, 299, 1)], "image long, row int, col int, seed long")
    got = {r["col"]: (r["seed"], r["d2"]) for r in tiles.nearest(mask, seeds).collect()}
    assert got[299] == (1, 0) and got[5] == (1, 294 * 294) and tiles.thinned(mask).count() == 300


def test_small_images_are_thinned_in_one_pass(spark):
    """3000 images of different sizes and corners: a tile for each would take minutes."""
    rng = np.random.default_rng(5)
    grids = {f"i{k}": rng.random((int(rng.integers(1, 20)), int(rng.integers(1, 20)))) < 0.6 for k in range(3000)}
    want = set()
    for k, g in grids.items():
        if g.any():
            r, c = np.argwhere(g).min(axis=0)
            want |= {(k, int(i) + r - 1 + 7, int(j) + c - 1 + 7) for i, j in np.argwhere(kernels.thin(np.pad(g[r:, c:], 1)))}
    started = time.monotonic()
    assert found(tiles.thinned(as_rows(spark, grids, 7))) == want
    assert time.monotonic() - started < 60


def test_pixels_that_compress_well_are_not_broadcast(spark):
    """Most of a million pixels are under 10 MB in Parquet, but not in a driver's memory."""
    pixels = spark.range(0, 1_000_000, 1, 4).filter("xxhash64(id) % 3 <> 0").selectExpr("0L as image", "cast(id div 1000 as int) as row", "cast(id % 1000 as int) as col")
    other = sized(spark.newSession())
    other.conf.set("spark.sql.adaptive.enabled", "false")
    one = other.read.parquet(*stored(pixels, "pixels").inputFiles())
    plan = one.join(one.select("image", "row", "col", F.lit(1).alias("x")), ["image", "row", "col"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_what_turns_out_small_is_not_broadcast_by_the_hundred(spark):
    """Some MB of pixels fit one broadcast, but a plan of many joins holds as many of them in the driver."""
    other = sized(spark.newSession())
    pixels = other.range(0, 200_000, 1, 4).selectExpr("id div 64 as image", "id div 8 % 8 as row", "id % 8 as col")
    counts = pixels.groupBy("image", "row", "col").count()
    joined = pixels.join(counts, ["image", "row", "col"])
    assert len(joined.collect()) == 200_000
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    few = counts.groupBy("image").count().filter("image < 9")
    joined = pixels.join(few, "image")
    assert len(joined.collect()) == 9 * 64
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_nearest_seeds_of_small_images_are_found_in_one_pass(spark):
    """3000 images, some without seeds, one too large, and pixels that are given twice: a group for each would take minutes."""
    rng = np.random.default_rng(6)
    mask, seeds = [], []
    for k in range(3000):
        h, w = (int(x) for x in rng.integers(1, 12, 2))
        put = lambda n: zip(rng.integers(0, h, n), rng.integers(0, w, n), strict=True)  # noqa: B023, E731
        mask += [(k, int(r) + 70, int(c)) for r, c in put(4)]
        seeds += [(k, int(r) + 70, int(c), int(rng.integers(-3, 3)) * 2**60) for r, c in put(rng.integers(0, 5))]
    mask += [(5000, 0, 0), (5000, 300, 2)]
    seeds += [(5000, 150, 1, 4)]
    by = {}
    for k, *at in seeds:
        by.setdefault(k, []).append(at)
    want = sorted(((k, r, c, *min((((r - y) ** 2 + (c - x) ** 2, s) for y, x, s in by.get(k, [])), default=(None, None))) for k, r, c in mask), key=str)
    started = time.monotonic()
    got = tiles.nearest(spark.createDataFrame(mask, "image long, row int, col int"), spark.createDataFrame(seeds, "image long, row int, col int, seed long"))
    assert sorted(((r["image"], r["row"], r["col"], r["d2"], r["seed"]) for r in got.collect()), key=str) == want
    assert time.monotonic() - started < 20


def test_images_stay_in_one_task_where_a_join_turns_into_a_broadcast(spark):
    """As in the catalogue: a join by image is planned as a merge and run as a broadcast, which leaves its shuffle where it lies."""
    mask = [(k, r, c) for k in range(3000) for r, c in ((2, 2), (2, 3), (3, 2), (3, 3), (4, 4))] + [(5000, 0, 0), (5000, 300, 2)]
    seeds = [(k, 0, 0, k) for k in range(3000)] + [(5000, 150, 1, 4)]
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.fileCompressionFactor")
    before = [spark.conf.get(n) for n in names]
    sized(spark)
    try:
        at = spark.createDataFrame(mask, "image long, row int, col int")
        got = tiles.nearest(at, spark.createDataFrame(seeds, "image long, row int, col int, seed long")).collect()
        thin = tiles.thinned(at).collect()
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
    assert all(r["seed"] == (4 if r["image"] == 5000 else r["image"]) for r in got) and len(got) == len(mask)
    left = {}
    for r in thin:
        left.setdefault(r["image"], set()).add((r["row"], r["col"]))
    assert len({frozenset(left[k]) for k in range(3000)}) == 1 and left[5000] == {(0, 0), (300, 2)}
