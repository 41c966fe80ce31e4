"""Reports on graphs and predictions, tables for spreadsheets, globs."""

from __future__ import annotations

import csv
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import sources
from weft.operators import discovery, graph, metrics


def bundle_brute(rows, classes):
    scored = [(t, p) for t, p, out in rows if not out]
    each = {}
    for c in classes:
        tp = sum(t == p == c for t, p in scored)
        said, true = sum(p == c for _, p in scored), sum(t == c for t, _ in scored)
        each[c] = (true, tp / said if said else 0.0, tp / true if true else 0.0, 2 * tp / (said + true) if said + true else 0.0)
    n = len(scored)
    present = [c for c in classes if each[c][0]]
    return each, (sum(t == p for t, p in scored) / n, np.mean([x[3] for x in each.values()]), sum(x[0] * x[3] for x in each.values()) / n, np.mean([each[c][2] for c in present]), n / len(rows))


def test_bundles_have_a_row_for_every_class(spark):
    rng = np.random.default_rng(1)
    rows = [("abc"[a], "abd"[b], bool(x)) for a, b, x in zip(rng.integers(0, 3, 80), rng.integers(0, 3, 80), rng.random(80) < 0.2, strict=True)]
    df = spark.createDataFrame(rows, "t string, p string, out boolean")
    counts, each, total = metrics.bundle(df, "t", "p", list("abcde"), abstained="out")
    want, overall = bundle_brute(rows, "abcde")
    got = {r["class"]: (r["support"], r["precision"], r["recall"], r["f1"]) for r in each.collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
    row = total.first()
    assert tuple(row[c] for c in ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy", "coverage")) == pytest.approx(overall)
    assert counts.count() == 25 and sum(r["n"] for r in counts.collect()) == sum(not x for _, _, x in rows) and row["notes"] == ["no true rows of: d, e"]


def test_bundles_say_what_they_lack(spark):
    df = spark.createDataFrame([("a", "a", True, 1), ("a", "b", True, 1), ("a", "b", False, 2), ("b", "b", None, 3)], "t string, p string, out boolean, fold int")
    _, _, by = metrics.bundle(df, "t", "p", ["a", "b"], ["fold"], "out")
    got = {r["fold"]: r for r in by.collect()}
    assert got[1]["notes"] == ["every prediction abstained; no scored rows"] and got[1]["accuracy"] is None and got[1]["coverage"] == 0
    assert got[2]["notes"] == ["no true rows of: b", "scored rows have a single true class"] and got[2]["accuracy"] == 0 and got[3]["accuracy"] == 1
    _, each, none = metrics.bundle(df.limit(0), "t", "p", ["a", "b"])
    assert none.first()["notes"] == ["empty evaluation set"] and none.first()["macro_f1"] is None and each.count() == 2


def test_graph_reports_and_problems(spark, tmp_path):
    nodes = spark.createDataFrame([("x", 1, "endpoint", True), ("x", 2, "junction", False), ("x", 3, "endpoint", False), ("x", 4, "isolated", False), ("x", 5, "endpoint", False), ("y", 9, "isolated", True)], "image string, node long, type string, border boolean")
    edges = spark.createDataFrame([("x", 1, 1, 2, 3.0), ("x", 2, 2, 3, 4.5), ("x", 3, 2, 77, 1.0), ("x", 4, 3, 3, 0.0)], "image string, edge long, u long, v long, length double")
    rows = {r["image"]: tuple(r)[1:] for r in graph.report(nodes, edges).collect()}
    assert rows == {"x": (5, 4, 3, 2, 1, 3, 8.5), "y": (1, 0, 0, 0, 0, 1, 0.0)}
    px = spark.createDataFrame([("x", 1, 0, 0, 0), ("x", 1, 1, 1, 1), ("x", 2, 0, 5, 5), ("x", 2, 1, 5, 7), ("x", 3, 0, 9, 10)], "image string, edge long, pos int, row int, col int")
    held = spark.createDataFrame([("x", n, n, 0) for n in (1, 2, 3, 4)] + [("x", 4, 1, 0), ("y", 9, 0, 0)], "image string, node long, row int, col int")
    got = sorted(tuple(r)[1:] for r in graph.problems(nodes, edges, px, 10, 10, held).collect())
    assert got == [
        ("error", "empty path", "4"), ("error", "leaves the image", "3"), ("error", "missing node", "3"), ("error", "path is not connected", "2"), ("error", "pixel of several nodes", "1,0"),
        ("warning", "no incident edge", "5"), ("warning", "no pixels", "5"),
    ]
    sources.write_summary(graph.report(nodes, edges), str(tmp_path / "s"))
    assert spark.read.json(f"{tmp_path}/s/json").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/s/csv").columns[0] == "image"


def test_border_nodes_by_frame_and_by_valid_region(spark):
    px = spark.createDataFrame([(0, 1, 10, 10), (0, 2, 1, 10), (0, 3, 10, 16), (0, 3, 10, 10), (0, 4, 12, 12)], "image int, node int, row int, col int")
    valid = spark.createDataFrame([(0, r, c) for r in range(20) for c in range(18) if (r, c) != (14, 12)], "image int, row int, col int")
    of = lambda v: {r["node"]: r["border"] for r in graph.border_nodes(px, 20, 20, 2, v).collect()}
    assert of(None) == {1: False, 2: True, 3: False, 4: False} and of(valid) == {1: False, 2: True, 3: True, 4: True}


def test_tables_with_a_mark_are_read_by_csv_readers(spark, tmp_path):
    rows = [(k, f'say "{k}", ünï\nnext' if k % 2 else f"plain {k}", None if k % 3 else 0.5) for k in range(20)]
    df = spark.createDataFrame(rows, "id int, text string, x double").repartition(3).sortWithinPartitions("id")
    sources.write_table_with_mark(df, str(tmp_path / "t"))
    (file,) = glob.glob(f"{tmp_path}/t/part-*")
    assert open(file, "rb").read(3) == b"\xef\xbb\xbf"
    with open(file, encoding="utf-8-sig", newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["id", "text", "x"] and sorted(got[1:], key=lambda r: int(r[0])) == [[str(a), b, "" if c is None else str(c)] for a, b, c in rows]
    assert {r["id"]: r["x"] for r in sources.read_review(spark, str(tmp_path / "t"), ["id"]).filter("id rlike '^[0-9]+$'").collect()}["0"] == "0.5"


def test_comma_separated_globs_take_the_first_that_matches(spark):
    files = spark.createDataFrame([("d/a_prob.npy",), ("d/a_prob.png",), ("d/sub.x/b.npy",), ("d/c.txt",), ("d/p1.png",), ("d/(odd)+.npy",)], "path string")
    got = {r["path"]: r["priority"] for r in discovery.matching(files, "*_prob.*, p[0-9].png ,*.npy").collect()}
    assert got == {"d/a_prob.npy": 0, "d/a_prob.png": 0, "d/p1.png": 1, "d/sub.x/b.npy": 2, "d/(odd)+.npy": 2}
    assert discovery.matching(files, "(odd)+.n?y").filter(F.col("priority") == 0).count() == 1
