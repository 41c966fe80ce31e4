"""Row bands of arrays, raster files with commit, and what is read back."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import sources
from weft.sources import rasters


def test_a_large_plane_is_read_by_many_tasks(spark, tmp_path):
    plane = np.arange(9147 * 437, dtype="u4").reshape(9147, 437)
    np.save(tmp_path / "large.npy", plane)
    at = rasters.npy_pixels(spark, str(tmp_path), band_bytes=1 << 20)
    assert at.rdd.getNumPartitions() == -(-os.path.getsize(tmp_path / "large.npy") // (1 << 20))
    got = at.agg(F.count("*"), F.countDistinct("row", "col"), F.sum((F.col("value") != F.col("row") * 437 + F.col("col")).cast("int"))).first()
    assert tuple(got) == (plane.size, plane.size, 0)
    rows = at.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert all(r["n"] <= plane.size // 10 for r in rows)


@pytest.mark.parametrize("size", [1, 100, 137, 1 << 20])
def test_bands_of_any_size_equal_numpy(spark, tmp_path, size):
    rng = np.random.default_rng(5)
    planes = {"a": rng.integers(0, 9, (7, 5)).astype("u1"), "b": np.asfortranarray(rng.random((6, 11))), "c": rng.random((1, 3)).astype("f4"), "d": rng.integers(-9, 9, (20, 2)), "e": rng.random((4, 4)) > 0.5}
    for name, plane in planes.items():
        np.save(tmp_path / f"{name}.npy", plane)
    rows = rasters.npy_pixels(spark, str(tmp_path), band_bytes=size).collect()
    for name, plane in planes.items():
        got = np.full(plane.shape, np.nan)
        mine = [r for r in rows if r["name"] == name]
        assert len(mine) == plane.size and not any(r["error"] for r in mine)
        for r in mine:
            got[r["row"], r["col"]] = r["value"]
        assert (got == plane).all()


def test_what_cannot_be_read_is_an_error_row(spark, tmp_path):
    np.save(tmp_path / "good.npy", np.ones((2, 2)))
    np.save(tmp_path / "cube.npy", np.ones((2, 2, 2)))
    np.save(tmp_path / "holes.npy", np.array([[1.0, np.nan]]))
    (tmp_path / "junk.npy").write_bytes(b"no array")
    whole = (tmp_path / "good.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-8])
    (tmp_path / "none.txt").write_text("not looked at")
    rows = rasters.npy_pixels(spark, f"file://{tmp_path}").collect()
    assert {r["name"]: r["error_type"] for r in rows} == {"good": None, "cube": "ValueError", "holes": "ValueError", "junk": "ValueError", "short": "EOFError"}
    assert sum(r["name"] == "good" for r in rows) == 4


@pytest.fixture()
def drawn(spark):
    rng = np.random.default_rng(6)
    planes = {"one": rng.integers(0, 256, (33, 57)), "two": rng.integers(0, 256, (8, 300)), "three": rng.integers(0, 256, (5, 5))}
    rows = [(k, int(r), int(c), int(v)) for k, p in planes.items() for (r, c), v in np.ndenumerate(p)]
    frames = [(k, *p.shape) for k, p in planes.items()] + [("blank", 4, 6)]
    return planes, spark.createDataFrame(rows, "image string, row int, col int, value int"), spark.createDataFrame(frames, "image string, height int, width int")


def test_arrays_round_trip(spark, drawn, tmp_path):
    planes, pixels, frames = drawn
    rasters.write_planes(pixels.filter("value > 20"), frames, str(tmp_path / "out"), dtype="int32", empty=-1)
    assert sorted(os.listdir(tmp_path / "out")) == ["blank.npy", "one.npy", "three.npy", "two.npy"]
    for name, plane in planes.items():
        assert (np.load(tmp_path / "out" / f"{name}.npy") == np.where(plane > 20, plane, -1)).all()
    assert (np.load(tmp_path / "out" / "blank.npy") == np.full((4, 6), -1)).all()


def test_png_files_are_read_by_spark(spark, drawn, tmp_path):
    planes, pixels, frames = drawn
    colour = pixels.select("image", "row", "col", F.col("value").alias("b"), (255 - F.col("value")).alias("g"), (F.col("value") % 7).alias("r"))
    rasters.write_planes(colour, frames.filter("image <> 'blank'"), str(tmp_path / "out"), ("b", "g", "r"), "png", suffix="_c")
    rasters.write_planes(pixels, frames, str(tmp_path / "grey"), kind="png")
    for r in sources.image_pixels(spark, str(tmp_path / "out"), drop_unreadable=False).collect():
        v = planes[os.path.basename(r["path"]).removesuffix("_c.png")][r["row"], r["col"]]
        assert (r["b"], r["g"], r["r"]) == (v, 255 - v, v % 7)
    grey = rasters.first_channel(spark, str(tmp_path / "grey")).collect()
    assert len(grey) == sum(p.size for p in planes.values()) + 24
    assert all(r["value"] == (0 if r["name"] == "blank" else planes[r["name"]][r["row"], r["col"]]) for r in grey)


def test_a_failed_task_leaves_nothing(spark, drawn, tmp_path):
    _, pixels, frames = drawn
    out = tmp_path / "out"
    bad = pixels.unionByName(spark.createDataFrame([("two", 99, 0, 1)], pixels.schema))
    with pytest.raises(Exception, match="row 99"):
        rasters.write_planes(bad, frames, str(out))
    assert not out.exists() or os.listdir(out) == []
    rasters.write_planes(pixels, frames, str(out))
    before = {f: os.path.getmtime(out / f) for f in os.listdir(out)}
    with pytest.raises(Exception, match="row 99"):
        rasters.write_planes(bad, frames, str(out))
    assert {f: os.path.getmtime(out / f) for f in os.listdir(out)} == before
    with pytest.raises(Exception, match="no name of a file"):
        rasters.write_planes(pixels.withColumn("image", F.lit("../x")), frames.withColumn("image", F.lit("../x")), str(out))


def test_attempts_write_apart_and_only_committed_files_appear(tmp_path):
    import pyarrow as pa

    writer = rasters.RasterWriter({"path": str(tmp_path)})
    line = lambda v: iter([pa.RecordBatch.from_pylist([{"image": "a", "height": 1, "width": 2, "row": 0, "cols": [0, 1], "values": [v, v]}])])
    first, again = writer.write(line(1.0)), writer.write(line(2.0))
    assert [f for f in os.listdir(tmp_path) if f.endswith("npy")] == []
    writer.commit([again, None])
    assert os.listdir(tmp_path) == ["a.npy"] and np.load(tmp_path / "a.npy").tolist() == [[2, 2]] and first != again


def test_label_rasters_and_missing_images(spark, tmp_path):
    np.save(tmp_path / "lab.npy", np.array([[0, 3], [5, 0]]))
    assert sorted(tuple(r) for r in rasters.label_pixels(spark, str(tmp_path)).collect()) == [("lab", 0, 1, 3), ("lab", 1, 0, 5)]
    records = spark.createDataFrame([("lab",), ("gone",)], "name string")
    out = {r["name"]: (r["image_available"], r["height"]) for r in rasters.with_images(records, rasters.first_channel(spark, str(tmp_path))).collect()}
    assert out == {"lab": (True, 2), "gone": (False, None)}
    np.save(tmp_path / "odd.npy", np.array([[0.5]]))
    with pytest.raises(Exception, match="not a label"):
        rasters.label_pixels(spark, str(tmp_path)).collect()


def test_batches_hold_every_row_once(spark):
    rows = spark.range(103).withColumn("x", F.col("id") * 2)
    plain = sorted((r["id"], r["batch"]) for r in rasters.batches(rows, "id", 10).collect())
    assert plain == [(k, k // 10) for k in range(103)]
    one, two, other = (sorted((r["id"], r["batch"]) for r in rasters.batches(rows, "id", 10, seed).collect()) for seed in (1, 1, 2))
    assert one == two != other and one != plain
    assert sorted(b for _, b in one) == sorted(b for _, b in plain) and [k for k, _ in one] == list(range(103))


def test_inference_files(spark, tmp_path):
    p = np.array([[0.2, 0.9], [0.5, 0.0]])
    prob = spark.createDataFrame([("x", int(r), int(c), float(v)) for (r, c), v in np.ndenumerate(p)], "image string, row int, col int, p double")
    planes = prob.select("image", "row", "col", F.lit(100).alias("b"), F.lit(50).alias("g"), F.lit(10).alias("r"))
    rasters.write_inference(prob, spark.createDataFrame([("x", 2, 2)], "image string, height int, width int"), str(tmp_path), 0.5, planes)
    assert np.allclose(np.load(tmp_path / "x_prob.npy"), p.astype("f4")) and np.load(tmp_path / "x_mask.npy").tolist() == [[0, 1], [1, 0]]
    seen = {(os.path.basename(r["path"]), r["row"], r["col"]): (r["b"], r["g"], r["r"]) for r in sources.image_pixels(spark, str(tmp_path)).collect()}
    assert seen["x_prob.png", 0, 1] == (229, 229, 229) and seen["x_mask.png", 1, 0] == (255, 255, 255) and seen["x_mask.png", 0, 0] == (0, 0, 0)
    assert seen["x_overlay.png", 0, 0] == (100, 50, 10) and seen["x_overlay.png", 0, 1] == (55, 28, 120)
