"""Small drawn rasters and graphs with known answers."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import functions as fn
from weft import sources, streaming
from weft.operators import discovery, graph, kernels, labels, paths, policies, raster, skeleton_graph, splits, sweeps, tiles
from weft.operators.components import connected_components


def line(a, b):
    n = 2 * (max(abs(a[0] - b[0]), abs(a[1] - b[1])) + 1)
    return {(round(r), round(c)) for r, c in zip(np.linspace(a[0], b[0], n), np.linspace(a[1], b[1], n), strict=True)}


def pixels(spark, points, image=1):
    return spark.createDataFrame([(image, int(r), int(c)) for r, c in sorted(points)], "image long, row int, col int")


def test_hysteresis_keeps_weak_pixels_of_strong_components(spark):
    rows = [(1, 10, c, 0.9 if c < 10 else 0.4) for c in range(2, 16)] + [(1, 3, c, 0.4) for c in range(2, 10)]
    kept = raster.hysteresis(spark.createDataFrame(rows, "image long, row int, col int, p double"), 0.6, 0.25)
    assert {(r["row"], r["col"]) for r in kept.collect()} == {(10, c) for c in range(2, 16)}


def test_inverted_thresholds_are_an_error(spark):
    with pytest.raises(ValueError):
        raster.weak_and_strong(spark.createDataFrame([], "image long, row int, col int, p double"), 0.2, 0.8)


def test_faces_of_a_pinhole_and_a_ring(spark):
    block = {(r, c) for r in range(28, 32) for c in range(28, 32)} - {(29, 29), (29, 30), (30, 29), (30, 30)}
    mask = pixels(spark, block)
    assert raster.face_pixels(mask, mask, 60, 60, 1).select("face").distinct().count() == 1
    assert raster.face_pixels(mask, mask, 60, 60, 16).count() == 0


def test_junction_and_endpoints_of_a_thinned_cross(spark):
    thick = {(r + i, c + j) for r, c in line((5, 5), (35, 35)) | line((5, 35), (35, 5)) for i in (0, 1) for j in (0, 1)}
    thin = tiles.thinned(pixels(spark, thick))
    ends = raster.neighbour_count(thin).filter("neighbours = 1").count()
    assert ends == 4 and thin.count() < len(thick)


def test_thinning_keeps_components_and_holes():
    grid = np.zeros((40, 40), bool)
    grid[5:30, 5:30] = True
    grid[12:20, 12:20] = False
    out = kernels.thin(grid)
    assert out.sum() < 120 and out.any(axis=1).sum() > 10


def thin_path(rng, n):
    """A random walk whose pixels touch only the one before and the one after."""
    path = [(50, 50)]
    while len(path) < n:
        r, c = path[-1]
        free = [q for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) if sum(abs(q[0] - x) <= 1 and abs(q[1] - y) <= 1 for x, y in path) == 1]
        if not free:
            break
        path.append(rng.choice(free))
    return path


def test_places_follow_lines_and_rings():
    rng = random.Random(2)
    chains = [thin_path(rng, rng.randint(1, 60)) for _ in range(60)]
    ring = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)]
    rows = [(k, *p) for k, path in enumerate([*chains, ring]) for p in path]
    rng.shuffle(rows)
    chain, row, col = (np.array(x) for x in zip(*rows, strict=True))
    got = kernels.places(chain, row, col)
    for k, path in enumerate(chains):
        mine = np.flatnonzero(chain == k)
        walked = [(row[i], col[i]) for i in mine[np.argsort(got[mine])]]
        assert walked == (path if path[0] <= path[-1] else path[::-1])
    mine = np.flatnonzero(chain == len(chains))
    assert [(row[i], col[i]) for i in mine[np.argsort(got[mine])]] == ring
    with pytest.raises(ValueError):
        kernels.places(np.zeros(4, int), np.array([0, 0, 0, 1]), np.array([0, 1, 2, 1]))


def test_traced_chains_of_named_images(spark):
    rows = [(name, row, c) for name in ("a", "b") for row in (0, 5) for c in range(7)]
    at = raster.labelled(spark.createDataFrame(rows, "image string, row int, col int"))
    got = kernels.traced(at).orderBy("image", "component", "pos").collect()
    assert [(r["image"], r["row"], r["col"]) for r in got] == sorted(rows) and len({r["component"] for r in got}) == 4


def test_junctions_at_the_border_stay_apart(spark):
    tee = {(0, c) for c in range(9)} | {(r, 4) for r in range(6)}
    for names, kind in (((1, 2), "long"), (("x", "y"), "string")):
        skeleton = spark.createDataFrame([(k, r, c) for k in names for r, c in tee], f"image {kind}, row int, col int")
        at = skeleton_graph.node_pixels(skeleton, 1).filter("type = 'junction'")
        assert [r["n"] for r in at.groupBy("image").agg(F.countDistinct("node").alias("n")).collect()] == [1, 1]
        assert at.select("node").distinct().count() == 2
        nodes, edges, _ = skeleton_graph.build(skeleton, 1)
        assert {(r["image"], r["type"], r["n"]) for r in nodes.groupBy("image", "type").agg(F.count("*").alias("n")).collect()} == {(k, t, n) for k in names for t, n in (("junction", 1), ("endpoint", 3))}
        assert edges.groupBy("image").agg(F.count("*").alias("n")).filter("n = 3").count() == 2


def test_pixels_without_a_key_are_an_error(spark):
    with pytest.raises(Exception, match="no pixel key"):
        raster.labelled(spark.createDataFrame([(1, 1 << 20, 0)], "image long, row int, col int")).collect()


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_over_tile_borders(spark, monkeypatch, connectivity):
    monkeypatch.setattr(raster, "TILE", 4)
    rng = random.Random(connectivity)
    points = {(k, r, c) for k in (1, 2) for r in range(23) for c in range(19) if rng.random() < 0.5}
    near = [(r, c) for r, c in raster.square(1) if (r or c) and (connectivity == 8 or not (r and c))]
    want, left = {}, set(points)
    while left:
        first = min(left)
        heap = [first]
        left.discard(first)
        while heap:
            k, r, c = heap.pop()
            want[k, r, c] = first
            for i, j in near:
                if (q := (k, r + i, c + j)) in left:
                    left.discard(q)
                    heap.append(q)
    mask = spark.createDataFrame([(*p, "x") for p in sorted(points)], "image long, row int, col int, note string")
    got = raster.labelled(mask, connectivity)
    assert got.columns == [*mask.columns, "component"]
    assert {(r["image"], r["row"], r["col"]): r["component"] for r in got.collect()} == {p: (k << 40) + (r << 20) + c for p, (k, r, c) in want.items()}
    assert raster.labelled(mask.limit(0), connectivity).count() == 0


def test_orientation_of_a_horizontal_path(spark):
    p = spark.createDataFrame([(1, k, 20.0, float(k)) for k in range(50)], "edge long, pos int, row double, col double")
    o = paths.orientation(p, ["edge"]).first()
    assert abs(o["anisotropy"] - 1) < 1e-9 and abs(o["entropy"]) < 1e-9 and abs(o["dominant_deg"]) < 1e-9
    back = spark.createDataFrame([(1, k, 20.0, float(-k)) for k in range(50)], "edge long, pos int, row double, col double")
    assert abs(paths.orientation(back, ["edge"]).first()["anisotropy"] - 1) < 1e-9


def test_curved_path_is_longer_than_its_chord(spark):
    p = spark.createDataFrame([(1, k, float(int(100 + 35 * np.sin(k / 140 * np.pi))), float(k + 30)) for k in range(141)], "edge long, pos int, row double, col double")
    g = paths.geometry(p, ["edge"]).first()
    assert g["length_px"] / g["chord_px"] > 1.05


@pytest.mark.parametrize(("a", "b", "want"), [(10, 170, 20), (0, 180, 0), (0, 90, 90)])
def test_angle_difference(spark, a, b, want):
    assert spark.range(1).select(fn.angle_difference(F.lit(float(a)), F.lit(float(b)))).first()[0] == want


@pytest.mark.parametrize(("v", "e", "c", "want"), [(4, 4, 1, 1), (4, 3, 1, 0), (6, 4, 2, 0)])
def test_cycle_rank(spark, v, e, c, want):
    assert spark.range(1).select(fn.cycle_rank(F.lit(e), F.lit(v), F.lit(c))).first()[0] == want


def test_junction_policy(spark):
    rows = [("1", 0, 0, 1, "thin"), ("1", 1, 1, 2, "wide"), ("1", 2, 1, 3, "wide"), ("2", 0, 10, 11, "thin")]
    e = spark.createDataFrame(rows, "image string, edge long, u long, v long, raw_label string").withColumn("predicted_label", F.col("raw_label"))
    got = {(r["image"], r["edge"]): r["predicted_label"] for r in policies.junction_policy(e).collect()}
    assert got == {("1", 0): "uncertain", ("1", 1): "wide", ("1", 2): "wide", ("2", 0): "thin"}


def test_line_graph_of_two_edges(spark):
    e = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2)], "image long, edge long, u long, v long")
    assert sorted((r["src"], r["dst"]) for r in graph.line_graph(e).collect()) == [(0, 1), (1, 0)]


def test_line_graph_of_edges_without_a_second_end(spark):
    rows = [(1, 1, 10, None), (1, 2, 10, 11), (1, 3, 11, 10), (1, 4, None, 11), (1, 5, 10, 10), (1, 6, None, None), (1, 7, None, 10), (2, 8, 10, 11)]
    got = graph.line_graph(spark.createDataFrame(rows, "image long, edge long, u long, v long")).collect()
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and {x for x in a[2:] if x} & {x for x in b[2:] if x}}
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_self_loop_counts_twice(spark):
    e = spark.createDataFrame([(1, 0, 5, 5)], "image long, edge long, u long, v long")
    assert graph.degrees(e).first()["degree"] == 2


def test_folds_keep_groups_whole_and_need_two(spark):
    rows = spark.createDataFrame([(f"g{k % 6}", k % 2) for k in range(120)], "g string, y int")
    assert splits.grouped_folds(rows, "g", 3).groupBy("fold").count().count() == 3
    assert splits.grouped_folds(rows, "g", 9).select("fold").distinct().count() == 6
    with pytest.raises(ValueError):
        splits.grouped_folds(rows.filter("g = 'g0'"), "g", 3)


def test_exact_name_wins_over_a_longer_one(spark):
    files = spark.createDataFrame([("a/foo_prob.npy",), ("a/foobar_prob.npy",), ("a/foo.png",)], "path string")
    ids = spark.createDataFrame([("foo",), ("foobar",)], "id string")
    got = {r["id"]: r["path"] for r in discovery.best_file(files, ids).collect()}
    assert got == {"foo": "a/foo_prob.npy", "foobar": "a/foobar_prob.npy"}


def test_vote_ties_go_to_the_smallest(spark):
    rows = spark.createDataFrame([(1, 2), (1, 1), (2, 3)], "edge long, value int")
    assert {r["edge"]: r["value"] for r in labels.vote(rows, ["edge"], "value").collect()} == {1: 1, 2: 3}


def test_perfect_sweep(spark):
    rows = spark.createDataFrame([(1, 255, True), (1, 0, False)], "image long, score int, truth boolean")
    at = sweeps.curve(rows, "image", "score", "truth")
    assert sweeps.ods(at).first()["ods"] == 1.0 and sweeps.ois(at).first()["ois"] == 1.0


def test_components_of_an_empty_edge_table(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_arrays_are_scanned_and_bad_ones_journalled(spark, tmp_path):
    np.save(tmp_path / "one_prob.npy", np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "bad.npy", np.zeros(0))
    at = sources.array_pixels(spark, str(tmp_path))
    assert at.filter("error is null").count() == 6
    sources.journal(at, "load", str(tmp_path / "journal"))
    assert spark.read.json(str(tmp_path / "journal")).first()["image_id"] == "bad"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.hourly(stream, "3650 days").writeStream.format("memory").queryName("hourly_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((str(r["hour"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("hourly_out")) == key(streaming.hourly(events))


def skeleton(spark, points):
    n, e, p = skeleton_graph.build(pixels(spark, points))
    return n.collect(), e.collect(), p


def test_straight_line_graph(spark):
    n, e, _ = skeleton(spark, line((10, 3), (10, 40)))
    assert sorted(r["type"] for r in n) == ["endpoint", "endpoint"] and len(e) == 1 and not e[0]["is_loop"] and e[0]["length"] > 30


def test_y_junction_graph(spark):
    n, e, _ = skeleton(spark, line((50, 50), (50, 10)) | line((50, 50), (20, 80)) | line((50, 50), (80, 80)))
    kinds = [r["type"] for r in n]
    assert kinds.count("endpoint") == 3 and kinds.count("junction") == 1 and sum(r["length"] > 20 for r in e) == 3


def test_ring_and_lone_pixel_graph(spark):
    ring = {(0, c) for c in range(1, 9)} | {(9, c) for c in range(1, 9)} | {(r, 0) for r in range(1, 9)} | {(r, 9) for r in range(1, 9)}
    n, e, _ = skeleton(spark, ring | {(30, 30)})
    assert sorted(r["type"] for r in n) == ["isolated", "virtual_loop"] and len(e) == 1 and e[0]["is_loop"]


def test_close_junctions_merge(spark):
    cross = line((5, 20), (40, 20)) | line((19, 20), (19, 2)) | line((22, 20), (22, 38))
    assert [r["type"] for r in skeleton_graph.node_pixels(pixels(spark, cross), 2).select("node", "type").distinct().collect()].count("junction") == 1


def test_greedy_pairs_equal_the_sequential_choice(spark):
    import random

    rng = random.Random(4)
    pairs = sorted({(1, a, b, float(rng.randint(1, 5))) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.2}, key=lambda r: (r[3], r[1], r[2]))
    used, want = set(), []
    for r in pairs:
        if r[1] not in used and r[2] not in used:
            want.append((r[1], r[2]))
            used |= {r[1], r[2]}
    got = skeleton_graph.greedy_pairs(spark.createDataFrame(pairs, "image long, a long, b long, distance double")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want)


def test_greedy_pairs_of_a_line_take_as_many_rounds_as_needed(spark):
    rows = [(1, k, k + 1, 1.0) for k in range(109)] + [(1, 5, 5, 0.5), (None, 1, 2, 0.5), (1, None, 2, 0.5)]
    got = skeleton_graph.greedy_pairs(spark.createDataFrame(rows, "image long, a long, b long, distance double")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(k, k + 1) for k in range(0, 109, 2)]


def test_stored_tables_are_cleared(spark):
    from pathlib import Path

    from weft.session import clear, shared_dir, stored

    assert stored(spark.range(3), "t").count() == 3
    home = Path(shared_dir(spark).removeprefix("file:")) / f"weft-{spark.sparkContext.applicationId}"
    assert any(home.iterdir())
    clear(spark)
    assert not home.exists()


def test_png_pixels_are_bgr(spark, tmp_path):
    import struct
    import zlib as z

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", z.crc32(kind + data))

    rows = b"".join(b"\0" + bytes(px) for px in ([255, 0, 0, 0, 255, 0], [0, 0, 255, 9, 8, 7]))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", z.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    assert sources.list_images(spark, str(tmp_path)).count() == 1
    got = {(r["row"], r["col"]): (r["b"], r["g"], r["r"]) for r in sources.image_pixels(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (0, 0, 255), (0, 1): (0, 255, 0), (1, 0): (255, 0, 0), (1, 1): (7, 8, 9)}


def test_reviews_are_written_blank_and_merged(spark, tmp_path):
    rows = spark.createDataFrame([("i", "p", 0, k, 3.0, 1, 1) for k in range(3)], "image_id string, panel_id string, component_id int, edge_id int, length_px double, row int, col int")
    sources.write_review(rows, str(tmp_path / "a"))
    sources.write_review(rows, str(tmp_path / "b"))
    sources.merge_reviews(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "c"))
    merged = sources.read_review(spark, str(tmp_path / "c"), ["image_id", "label"])
    assert merged.count() == 6 and labels.progress(merged).first()["unlabelled"] == 6
    with pytest.raises(ValueError):
        sources.read_review(spark, str(tmp_path / "c"), ["nothing"])


def test_label_spellings(spark):
    rows = spark.createDataFrame([(" C ",), ("q",), ("nan",), (None,), ("255",), ("0",), ("2.0",), ("zzz",), ("99",)], "raw string")
    got = [r[0] for r in rows.select(labels.normalized(F.col("raw"), labels.Vocabulary({1: "thin", 2: "wide"}, {"C": "thin", "q": "wide", "nan": "unlabeled"}, {0: "unlabeled", 255: "uncertain"}))).collect()]
    assert got == ["thin", "wide", "unlabeled", "unlabeled", "uncertain", "unlabeled", "wide", None, None]


def test_components_of_a_line_and_of_hubs_take_few_tables(spark, monkeypatch):
    """Names that fall along a line are followed by doubling; loops and text are vertices too."""
    from weft.operators import components

    written = []
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df, label: written.append(label) or keep(df, label))
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k % 3, 2000 + k) for k in range(60)] + [(5000, 5000)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{h: 1000 + h % 1000 % 3 for h in (1000, 1001, 1002)}, **{2000 + k: 1000 + k % 3 for k in range(60)}, 5000: 5000}
    # edges are written once, and once more when none is left
    assert written.count("edges") == 2
