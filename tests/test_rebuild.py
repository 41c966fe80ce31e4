"""Incremental rebuilds: what is touched, and what is not."""

from __future__ import annotations

import os
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.sources import rasters
from weft.streaming import rebuild as r


def build(files):
    """The sum of each image's plane, read from the paths that are stale."""
    spark = files.sparkSession
    paths = [x["path"] for x in files.select("path").collect()]
    rows = None
    for p in paths:
        part = rasters.npy_pixels(spark, p)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(F.col("name").alias("image_id")).agg(F.sum("value").alias("total")).filter("total > 0")


def times(out):
    return {str(p.relative_to(out)): p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}


def totals(spark, out):
    return {x["image_id"]: x["total"] for x in spark.read.parquet(f"{out}/results").collect()}


@pytest.fixture()
def places(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, v in (("a", 1), ("b", 2), ("c x=1", 3)):
        np.save(folder / f"{name}.npy", np.full((4, 5), v))
    return folder, str(tmp_path / "out")


def test_only_what_changed_is_rebuilt(spark, places):
    folder, out = places
    run = lambda config="": r.rebuild(spark, r.listed(spark, str(folder), "*.npy"), out, build, config)
    assert run() == {"built": 3, "kept": 0, "removed": 0} and totals(spark, out) == {"a": 20, "b": 40, "c x=1": 60}
    before = times(out)
    assert run() == {"built": 0, "kept": 3, "removed": 0} and times(out) == before
    time.sleep(0.02)
    np.save(folder / "b.npy", np.full((4, 5), 7))
    os.utime(folder / "b.npy")
    assert run() == {"built": 1, "kept": 2, "removed": 0} and totals(spark, out)["b"] == 140
    after = times(out)
    same = lambda a, b: {k for k in a if b.get(k) == a[k]}
    assert {k for k in before if "image_id=b" not in k} == same(before, after)
    (folder / "a.npy").unlink()
    assert run() == {"built": 0, "kept": 2, "removed": 1} and set(totals(spark, out)) == {"b", "c x=1"}
    np.save(folder / "c x=1.npy", np.zeros((2, 2)))
    assert run() == {"built": 1, "kept": 1, "removed": 0} and set(totals(spark, out)) == {"b"}
    assert run("another configuration") == {"built": 2, "kept": 0, "removed": 0}


def test_a_failed_build_is_done_again(spark, places):
    folder, out = places
    with pytest.raises(RuntimeError):
        r.rebuild(spark, r.listed(spark, str(folder), "*.npy"), out, lambda files: (_ for _ in ()).throw(RuntimeError("no")))
    assert r.rebuild(spark, r.listed(spark, str(folder), "*.npy"), out, build)["built"] == 3


def test_a_stream_follows_a_folder(spark, places, tmp_path):
    folder, out = places
    go = lambda: r.follow(spark, str(folder), out, build, str(tmp_path / "checkpoint"), glob="*.npy").awaitTermination(120)
    assert go() and totals(spark, out) == {"a": 20, "b": 40, "c x=1": 60}
    before = times(out)
    assert go() and times(out) == before
    np.save(folder / "d.npy", np.full((1, 1), 5))
    assert go() and totals(spark, out)["d"] == 5 and {k for k in times(out) if times(out)[k] == before.get(k)} == set(before)
