"""Scans, sinks, and small operators on tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import line, pixels
from weft import functions as fn
from weft import sources
from weft.operators import discovery, graph, labels, learning, raster, skeleton_graph, splits


def test_feature_tables_keep_their_ids(spark, tmp_path):
    rows = spark.createDataFrame([("001", "p1", 3, 1.5), ("002", "p2", 4, None)], "image_id string, panel_id string, edge_id int, length_px double")
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    got = sources.read_features(spark, str(tmp_path / "t.parquet")).orderBy("image_id").collect()
    assert [(r["image_id"], r["edge_id"], r["length_px"]) for r in got] == [("001", 3.0, 1.5), ("002", 4.0, None)]
    rows.write.parquet(str(tmp_path / "u.parquet"))
    assert sources.read_features(spark, str(tmp_path / "u.parquet")).schema["image_id"].dataType.simpleString() == "string"


def test_arrays_and_archives(spark, tmp_path):
    plane = np.arange(12.0).reshape(3, 4)
    np.save(tmp_path / "a.npy", plane)
    np.savez(tmp_path / "b.npz", plane=plane + 1)
    (tmp_path / "c.npy").write_bytes(b"nothing")
    got = sources.array_pixels(spark, str(tmp_path)).collect()
    assert {(r["row"], r["col"], r["value"]) for r in got if r["name"] == "b"} == {(r, c, plane[r, c] + 1) for r in range(3) for c in range(4)}
    (bad,) = (r for r in got if r["name"] == "c")
    assert bad["error_type"] == "ValueError" and "Traceback" in bad["traceback"]
    with pytest.raises(ValueError):
        sources.image_pixels(spark, str(tmp_path))


def test_shapes_of_scores_and_masks(spark):
    full = lambda k, h, w: [(k, r, c) for r in range(h) for c in range(w)]
    schema = "image string, row int, col int"
    held, bad = sources.scores_and_masks(spark.createDataFrame(full("a", 3, 4) + full("b", 3, 4), schema), spark.createDataFrame(full("a", 3, 5) + full("c", 2, 2), schema))
    assert {(r["image"], r["prob_available"], r["mask_available"]) for r in held.collect()} == {("b", True, False), ("c", False, True)}
    assert [(r["image"], r["error"]) for r in bad.collect()] == [("a", "scores are 3 x 4, mask is 3 x 5")]


def test_annotations(spark, tmp_path):
    words = labels.Vocabulary({1: "thin", 2: "wide"}, {"t": "thin"})
    write = lambda rows, name: spark.createDataFrame(rows, "image_id string, edge_id string, label string").coalesce(1).write.option("header", True).csv(str(tmp_path / name))
    write([("a", "1", " T "), ("a", "2", "wide")], "good")
    assert {tuple(r) for r in sources.read_annotations(spark, str(tmp_path / "good"), words).collect()} == {("a", "1", "thin"), ("a", "2", "wide")}
    write([("a", "1", "thin"), ("a", "1", "wide"), ("b", "1", "zzz")], "bad")
    with pytest.raises(ValueError, match="a/1: occurs 2 times; b/1: no label zzz"):
        sources.read_annotations(spark, str(tmp_path / "bad"), words)
    table = spark.createDataFrame([("class", "1", "thin"), ("spelling", "T", "thin"), ("no_class", "9", "unlabeled")], "kind string, key string, label string")
    got = spark.createDataFrame([("t",), ("9",), ("?",)], "x string").select(labels.normalized(F.col("x"), labels.Vocabulary.of(table))).collect()
    assert [r[0] for r in got] == ["thin", "unlabeled", None]
    with pytest.raises(ValueError):
        labels.Vocabulary({1: "thin"}, {"x": "nothing"})


def test_groups_of_a_mapping(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿image_id,panel_id\na,p\nb,\na,q\n", encoding="utf-8")
    assert [tuple(r) for r in sources.read_groups(spark, str(tmp_path / "m.csv")).collect()] == [("a", "q")]


def test_archives_and_packed_masks(spark, tmp_path):
    mask = pixels(spark, line((2, 1), (2, 9)) | {(4, 4)})
    runs = sources.packed(mask)
    assert runs.count() == 2 and {tuple(r) for r in sources.unpacked(runs).collect()} == {tuple(r) for r in mask.collect()}
    nodes, edges, paths = skeleton_graph.build(mask)
    for config in ("x", "y"):
        sources.write_graph(nodes, edges, paths, str(tmp_path / "g"), config)
    n, e, p = sources.read_graph(spark, str(tmp_path / "g"), "x")
    assert (n.count(), e.count(), p.count()) == (nodes.count(), edges.count(), paths.count())
    files = sources.write_rasters(mask.withColumn("value", F.lit(3)), str(tmp_path / "r"), 12, 12).collect()
    assert np.load(files[0]["path"]).sum() == 3 * 10


def test_names_without_ids_lose_a_suffix(spark):
    names = spark.createDataFrame([("foo_s1_prob",), ("bar_x_prob",), ("baz",)], "name string")
    got = discovery.stripped(names, spark.createDataFrame([("foo",)], "id string"), ["_x_prob", "_prob"])
    assert {r["name"]: r["owner"] for r in got.collect()} == {"foo_s1_prob": "foo", "bar_x_prob": "bar", "baz": "baz"}
    files = spark.createDataFrame([("d/a_prob.npy",), ("d/b.png",)], "path string")
    assert {r["id"] for r in discovery.ids_of([files, files], ["_prob"]).collect()} == {"a", "b"}


def test_small_rules(spark):
    with pytest.raises(Exception, match="no whole number"):
        graph.endpoint_ids(spark.createDataFrame([("1", "x")], "u string, v string")).collect()
    assert graph.endpoint_ids(spark.createDataFrame([("1", "2.0")], "u string, v string")).first()["v"] == 2
    got = spark.range(-3, 9).select(fn.reflected(F.col("id"), F.lit(4)).alias("i")).collect()
    assert [r["i"] for r in got] == [3, 2, 1, 0, 1, 2, 3, 2, 1, 0, 1, 2]
    assert learning.without_prefixes(["a_x", "b"], ["a_"]) == ["b"]
    rows = spark.createDataFrame([("i", "p"), ("i", "q"), ("j", "p")], "image string, panel string")
    assert [r["image"] for r in splits.image_conflicts(rows, "image", "panel").collect()] == ["i"]
    assert splits.contained(rows.filter("image = 'j'"), rows, ["image"]) and not splits.contained(rows, rows.filter("image = 'j'"), ["image"])


def test_folds_deal_groups_by_size(spark):
    rows = spark.createDataFrame([(f"g{k:03d}",) for k in range(200) for _ in range(k % 7 + 1)], "g string")
    got = splits.grouped_folds(rows, "g", 4).collect()
    want = sorted(got, key=lambda r: (-r["n"], r["group"]))
    assert [r["fold"] for r in want] == [(k % 4 if (k // 4) % 2 == 0 else 3 - k % 4) for k in range(200)]
    held = splits.holdout(rows, "g", 0.1).filter("held").count()
    assert held == 20


def test_classified_edges_abstain(spark):
    rows = spark.createDataFrame([(1, k, k, k + 1, float(k % 2), k % 2, k % 3) for k in range(60)], "image long, edge long, u long, v long, x double, y int, fold int")
    model = learning.fit_forest(rows, ["x"], "y", trees=3, depth=2)
    got = learning.classified(model, rows, ["x"], ["thin", "wide"], 0.6, "keep").collect()
    assert all(r["raw_label"] == ("wide" if r["y"] else "thin") and r["prob_wide"] + r["prob_thin"] == pytest.approx(1) for r in got)
    assert learning.importances(model, ["x"])[0][0] == "x"
    means, confusion = learning.cross_validation_report(rows, ["x"], "y", "fold", trees=3, depth=2)
    assert sum(r["n"] for r in confusion.collect()) == 60 and {r["metric"]: r["mean"] for r in means.collect()}["accuracy"] == 1.0


def test_borders(spark):
    assert raster.within(pixels(spark, {(0, 0), (-1, 2), (3, 3)}), 3, 3).count() == 1


def test_neighbour_sums_keep_an_edge_in_one_row(spark):
    """Loops, parallel edges both ways, a missing end and missing values; a row for each end would be a union."""
    rows = [(1, 1, 10, 11, 1.5), (1, 2, 11, 10, 2.0), (1, 3, 10, 11, None), (1, 4, 10, 10, 4.0), (1, 5, 11, 12, 8.0), (1, 6, None, 12, 16.0), (1, 7, 13, 14, 32.0), (1, 8, None, None, 3.0), (2, 9, 10, 11, 64.0)]
    got = graph.neighbour_sums(spark.createDataFrame(rows, "image long, edge long, u long, v long, x double"), ["x"], ("x",))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    ends = {(r[0], r[1]): {x for x in r[2:4] if x is not None} for r in rows}
    want = {}
    for image, edge, _, _, x in rows:
        if ends[image, edge]:
            near = [o[4] for o in rows if o[0] == image and o[1] != edge and ends[image, edge] & ends[image, o[1]]]
            some = [y for y in near if y is not None]
            want[edge] = (len(near), sum(some), len(some), x)
    assert {r["edge"]: (r["n"], float(r["sum_x"]), r["n_x"], r["x"]) for r in got.collect()} == want


def test_forests_of_folds_make_their_rows_once(spark):
    """What makes a row may be costly: a forest goes over it in many jobs."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x)

    rows = spark.range(90).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).alias("fold"), counted(F.col("id") % 2).alias("x"))
    done = learning.cross_validated(rows, ["x"], "y", "fold", trees=3, depth=2).collect()
    assert len(done) == 90 and all(r["prediction"] == r["y"] for r in done)
    assert made.value == 90


def test_ends_meet_the_nodes_before_they_are_made_distinct(spark):
    """Equal ends are told apart among those without a node only; repeated edges, loops and missing values are given once each."""
    edges = [(1, 1, 10, 11), (1, 1, 10, 11), (1, 1, 12, 11), (1, 2, 12, 12), (1, 3, None, 12), (1, 4, None, None), (None, 5, 10, 12), (2, None, 10, 12), (2, 6, 11, 13), (2, 6, 11, 13)]
    nodes = [(1, 10), (1, 10), (2, 12), (None, 10), (2, None)]
    got = graph.validate(spark.createDataFrame(edges, "image long, edge long, u long, v long"), spark.createDataFrame(nodes, "image long, node long"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Join LeftAnti") :]
    known = {n for n in nodes if None not in n}
    want = {(i, e, n, "missing node") for i, e, *ends in edges for n in ends if (i, n) not in known}
    rows = [tuple(r) for r in got.select("image", "edge", "node", "problem").collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert graph.validate(spark.createDataFrame([], "image long, edge long, u long, v long"), spark.createDataFrame(nodes, "image long, node long")).count() == 0


def test_messages_are_capped_and_counted_from_ends_that_met_the_nodes_once(spark):
    """The lists and the counts share what validate has dealt; empty messages are counted, not listed."""
    edges = spark.createDataFrame([(image, k, k % 7, 50 + k % 3) for image in (1, 2, None) for k in range(40)], "image long, edge long, u long, v long")
    bad = graph.validate(edges, spark.createDataFrame([(1, n) for n in range(7)] + [(2, n) for n in (*range(6), 50, 51)], "image long, node long"))
    bad = bad.withColumn("message", F.when(F.col("node") > 6, F.concat_ws(" ", "edge", "node")).otherwise(F.concat(F.lit("x"), F.col("edge").cast("string"))))
    said = graph.capped_messages(bad.withColumn("message", F.nullif("message", F.lit("x6"))), "image", "message", 3)
    got = {r["image"]: (r["n"], r["messages"]) for r in said.collect()}
    first = [f"{k} {50 + k % 3}" for k in (0, 1, 10)]
    assert got == {1: (40, first), 2: (13 + 5, ["11 52", "14 52"])}
    plan = said._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("LeftAnti") == 1


def test_a_missing_nodes_ends_are_dealt_to_many_tasks(spark):
    """All of them leave the join in one task; what makes them distinct and ranks them has as many tasks as the session asks for."""
    edges = spark.createDataFrame([(1, k, 7, k) for k in range(4000)], "image long, edge long, u long, v long")
    bad = graph.validate(edges, spark.createDataFrame([(1, n) for n in range(4000) if n != 7], "image long, node long"))
    sizes = Counter(r[0] for r in bad.select(F.spark_partition_id()).collect())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == tasks and sum(sizes.values()) == 4000 and max(sizes.values()) < 2 * 4000 / tasks


def test_edges_take_their_parallel_edges_along(spark):
    """Five shuffles, two of them of degrees. Loops, repeated names and missing ends, names and images count as in a join by name."""
    pairs = [(1, 1, 10, 11), (1, 2, 11, 10), (1, 3, 10, 10), (1, 4, None, 10), (1, 4, 10, 12), (1, 4, 12, 13), (1, 5, None, None), (1, 5, 14, 15), (1, 6, 16, None), (None, 7, 10, 11), (1, None, 11, 10), (2, 1, 10, 11), (2, 8, 20, 21), (2, 8, 20, 21), (2, 9, None, None)]
    rows = pairs + [(3, k, *((0, k + 1) if k % 2 else (k + 1, 0))) for k in range(200)]
    edges = spark.createDataFrame(rows, "image long, edge long, u long, v long")
    degree, alike = Counter((i, n) for i, _, *ends in rows for n in ends), Counter((i, *_ordered(u, v)) for i, _, u, v in rows)
    want = Counter()
    for i, e, u, v in rows:
        if None not in (i, e, u, v):
            a, b = degree[i, u], degree[i, v]
            want.update((i, e, min(a, b), max(a, b), a + b, (a == 1) + (b == 1), alike[i, *_ordered(x, y)] - 1) for j, f, x, y in rows if (j, f) == (i, e))
    got = graph.edge_topology(edges)
    assert got.columns == ["image", "edge", "degree_min", "degree_max", "degree_sum", "free_ends", "parallel"]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "int", "int", "int", "bigint"]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 5
    assert Counter(map(tuple, got.collect())) == want and want[1, 4, 1, 2, 3, 1, 1] == 1 and want[2, 8, 2, 2, 4, 0, 1] == 4
    assert graph.edge_topology(edges.limit(0)).count() == 0
    assert Counter(map(tuple, graph.parallel_edges(edges).collect())) == Counter((i, e, alike[i, *_ordered(u, v)] - 1) for i, e, u, v in rows)


def _ordered(u, v):
    """The lesser and the greater of two nodes, either of which may be missing."""
    some = [x for x in (u, v) if x is not None] or [None]
    return min(some), max(some)


def test_a_hub_is_dealt_by_half_of_its_edges(spark):
    """However its edges run and however low its number, and both edges of a pair alike."""
    rows = [(1, k, *((0, k // 2 + 1) if k % 2 else (k // 2 + 1, 0))) for k in range(2000)]
    at = graph.parallel_edges(spark.createDataFrame(rows, "image long, edge long, u long, v long"), with_ends=True).collect()
    assert 800 < sum(r["near"] == 0 for r in at) < 1200 and {r["parallel"] for r in at} == {1}
    assert all({r["near"], r["far"]} == {0, r["edge"] // 2 + 1} and r["whole"] for r in at)
