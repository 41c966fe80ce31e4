"""Rules on predictions, votes and faces by plain loops: junction conflicts, reasons of votes, face look-ups, keys at scale."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import features, graph, labels, policies
from weft.plans import relations
from weft.plans.catalogue import QUERIES

EDGES = "image string, edge long, u long, v long, raw_label string, predicted_label string"


def policy_brute(rows):
    out = {}
    for image, edge, u, v, raw, predicted in rows:
        near = {r[4] for r in rows if r[0] == image and r[1] != edge and {u, v} & {r[2], r[3]} and r[4] != "uncertain"}
        out[image, edge] = "uncertain" if raw != "uncertain" and near and raw not in near else predicted
    return out


def test_junction_policy_is_that_of_plain_loops(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), k, u := rng.randrange(12), rng.choice([u, rng.randrange(12)]), raw := rng.choice(["thin", "wide", "side", "uncertain", None]), rng.choice([raw, "uncertain"])) for k in range(160)]
    edges = spark.createDataFrame(rows, EDGES)
    got = {(r["image"], r["edge"]): r["predicted_label"] for r in policies.junction_policy(edges).collect()}
    assert got == policy_brute(rows) and len(got) == len(rows)
    assert policies.junction_policy(edges, "keep").collect() == edges.collect()
    with pytest.raises(ValueError, match="unknown policy"):
        policies.junction_policy(edges, "guess")
    with pytest.warns(UserWarning, match="without columns"):
        assert policies.junction_policy(edges.drop("u"), "uncertain").columns == edges.drop("u").columns


def test_an_uncertain_neighbour_is_no_evidence(spark):
    edges = spark.createDataFrame([("a", 1, 1, 2, "thin", "thin"), ("a", 2, 2, 3, "uncertain", "uncertain"), (None, 3, 1, 2, "thin", "thin"), (None, 4, 2, 3, "wide", "wide")], EDGES)
    got = {r["edge"]: r["predicted_label"] for r in policies.junction_policy(edges).collect()}
    assert got == {1: "thin", 2: "uncertain", 3: "uncertain", 4: "uncertain"}


def vote_brute(edges, samples, words, least):
    names = words.no_class | words.classes
    by = defaultdict(list)
    for edge, value, excluded in samples:
        if value is not None:
            by[edge].append((value, excluded))
    out = {}
    for e in edges:
        free = [v for v, x in by[e] if not x]
        counts = Counter(v for v in free if v in names)
        if not by[e]:
            out[e] = ("unlabeled", 0.0, 0, "no_samples")
        elif not free:
            out[e] = ("uncertain", 0.0, 0, "junction_only")
        elif not counts:
            out[e] = ("unlabeled", 0.0, 0, "no_annotation")
        else:
            best = min(counts, key=lambda v: (-counts[v], v))
            share = counts[best] / sum(counts.values())
            out[e] = (names[best], share, sum(counts.values()), "majority") if share >= least else ("uncertain", share, sum(counts.values()), "mixed_below_purity")
    return out


def test_votes_give_every_edge_a_reason(spark):
    words = labels.Vocabulary({1: "thin", 2: "wide"}, {}, {0: "unlabeled", 255: "uncertain"})
    rng = random.Random(5)
    samples = [(rng.randrange(25), rng.choice([0, 1, 1, 2, 7, 255, None]), rng.random() < 0.3) for _ in range(130)]
    samples += [(30, 1, True), (31, 7, False), (32, None, False), (33, 2, False), (33, 2, False), (34, 1, False), (34, 2, False)]
    edges = spark.range(40).withColumnRenamed("id", "edge")
    got = {r["edge"]: (r["label"], r["purity"], r["samples"], r["reason"]) for r in labels.edge_votes(edges, spark.createDataFrame(samples, "edge long, value int, excluded boolean"), ["edge"], words).collect()}
    assert got == vote_brute(range(40), samples, words, 0.6)
    assert {x[3] for x in got.values()} == {"no_samples", "junction_only", "no_annotation", "majority", "mixed_below_purity"}


def test_faces_near_a_path_are_those_of_a_maximum_filter(spark):
    rng = np.random.default_rng(7)
    faces, paths = [], []
    for image in ("p", "q"):
        plane = np.zeros((150, 200), int)
        for k in range(12):
            r, c, h, w = rng.integers(0, 130), rng.integers(0, 150), rng.integers(1, 20), rng.integers(1, 90)
            plane[r : r + h, c : c + w] = np.where(plane[r : r + h, c : c + w] > 0, plane[r : r + h, c : c + w], k + 1)
        faces += [(image, int(r), int(c), int(plane[r, c]), int((plane == plane[r, c]).sum())) for r, c in np.argwhere(plane)]
        paths += [(image, e, 0, int(rng.integers(0, 150)), int(rng.integers(0, 200)), plane) for e in range(60)]
    px = spark.createDataFrame([p[:5] for p in paths], "image string, edge int, pos int, row int, col int")
    runs = features.runs_of_faces(spark.createDataFrame(faces, "image string, row int, col int, face int, area int"))
    radius = F.when(F.col("image") == "p", 3).otherwise(17)
    got = {(r["image"], r["edge"]): (r["face"], r["area"]) for r in features.faces_near(px, runs, radius).collect()}
    want = {}
    for image, e, _, r, c, plane in paths:
        k = 3 if image == "p" else 17
        top = plane[max(0, r - k) : r + k + 1, max(0, c - k) : c + k + 1].max()
        if top:
            want[image, e] = (top, (plane == top).sum())
    assert got == want


def test_edge_keys_hold_at_large_sizes_and_are_checked(spark):
    row = spark.range(1).select(relations.edge_key(F.lit(4_000_000_000_000), F.lit(7), F.lit(255)).alias("k"), relations.edge_key(F.lit(3_999_999_999_999), F.lit(7), F.lit(0)).alias("j")).first()
    assert 0 < row["j"] < row["k"] < 1 << 63
    with pytest.raises(Exception, match="no edge key"):
        spark.range(1).select(relations.edge_key(F.lit(1), F.lit(8), F.lit(0))).collect()


@pytest.mark.parametrize("turn", [180, 360])
def test_angles_between_branches_are_those_of_all_pairs(spark, turn):
    rng = random.Random(turn)
    rows = [(node, float(round(rng.choice([rng.uniform(-400, 800), 0, 90, 180, 45]), rng.choice([0, 3, 9])))) for node in range(40) for _ in range(rng.choice([1, 2, 2, 3, 7, 40]))]
    got = {r["node"]: tuple(r)[1:] for r in graph.circular_spread(spark.createDataFrame(rows, "node int, angle double"), ["node"], "angle", turn).collect()}
    by = defaultdict(list)
    for node, angle in rows:
        by[node].append(angle)
    want = {}
    for node, angles in by.items():
        d = [min(x := abs(a - b) % turn, turn - x) for i, a in enumerate(angles) for b in angles[:i]]
        if d:
            want[node] = (min(d), max(d), np.mean(d), np.std(d))
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_contexts_within_a_radius_are_those_of_a_search(spark):
    rng = random.Random(9)
    place = {n: (rng.randint(0, 60), rng.randint(0, 60)) for n in range(80)}
    ends = [(k, rng.randrange(80), rng.choice([0, 1, rng.randrange(80)])) for k in range(200)]
    edges = spark.createDataFrame([(0, k, u, v) for k, u, v in ends], "image int, edge int, u int, v int")
    places = spark.createDataFrame([(0, n, *p) for n, p in place.items()], "image int, node int, row int, col int")
    middles = spark.createDataFrame([(0, k, *(float(x) for x in place[u])) for k, u, _ in ends], "image int, edge int, row double, col double")
    near = defaultdict(set)
    for _, u, v in ends:
        near[u].add(v)
        near[v].add(u)
    want = {}
    for k, u, v in ends:
        hop, front = {u: 0, v: 0}, {u, v}
        for h in (1, 2):
            front = {m for n in front for m in near[n] if m not in hop and (place[m][0] - place[u][0]) ** 2 + (place[m][1] - place[u][1]) ** 2 <= 225}
            hop |= dict.fromkeys(front, h)
        want |= {(k, n): h for n, h in hop.items()}
    assert {(r["edge"], r["node"]): r["hop"] for r in graph.khop(edges, 2, middles, places, 15.0).collect()} == want


def test_contexts_without_a_radius_are_whole(spark, sf_dir):
    """Two steps along edges between two kinds of nodes, which are taken by node, and along others; no place bounds those of the queries."""
    rng = random.Random(4)
    two = [(k % 3, k, 2 * rng.randrange(40), 2 * rng.randrange(12) + 1) for k in range(200)] + [(0, 900, 0, 1), (0, 901, 0, 1), (7, 902, 500, 501)]
    mixed = [(0, k, rng.randrange(60), rng.choice([0, rng.randrange(60)])) for k in range(150)]
    rows = [tuple(r) for r in relations.edges(spark, sf_dir).select("image", "edge", "u", "v").collect()]
    some = {e for _, e, _, _ in rows[::97]}
    found = QUERIES["khop_context"](spark, sf_dir).filter(F.col("edge").isin(*some))
    schema = "image long, edge long, u long, v long"
    made = [(ends, graph.khop(spark.createDataFrame(ends, schema), 2)) for ends in (two, mixed)]
    for ends, got in [*made, (rows, found)]:
        near = defaultdict(set)
        for image, _, u, v in ends:
            near[image, u].add(v)
            near[image, v].add(u)
        want = []
        for image, k, u, v in ends:
            if ends is rows and k not in some:
                continue
            hop, front = {u: 0, v: 0}, {u, v}
            for h in (1, 2):
                front = {m for n in front for m in near[image, n]} - hop.keys()
                hop |= dict.fromkeys(front, h)
            want += [(image, k, n, h) for n, h in hop.items()]
        assert sorted((r["image"], r["edge"], r["node"], r["hop"]) for r in got.collect()) == sorted(want)


def test_local_structure_is_that_of_whole_contexts(spark, sf_dir):
    """Summed by node and by cycles of four as from contexts that are written out, with parallel edges and lengths that are missing."""
    by = ["image", "edge"]
    for seed, (us, vs, many) in enumerate([(30, 8, 120), (10, 10, 60), (5, 40, 120)]):
        rng = random.Random(seed)
        length = lambda: rng.uniform(1, 1e5) if seed % 2 else rng.choice([None, 5.0, 5.0, 1e4])  # noqa: B023, E731
        rows = [(rng.randrange(2), k, 2 * rng.randrange(us), 2 * rng.randrange(vs) + 1, length()) for k in range(many)]
        edges = spark.createDataFrame(rows, "image long, edge long, u long, v long, length double")
        inside = graph.induced(edges, graph.khop(edges, 1), ("u", "v", "length"))
        got, want = (x.toPandas().sort_values(by).reset_index(drop=True).astype(float) for x in (graph.local_structure(edges), graph.structure(inside, by)))
        assert list(got.columns) == list(want.columns) and len(got) == many
        assert np.allclose(got, want, atol=1e-6, equal_nan=True)
    near, ends = defaultdict(set), {}
    for r in relations.edges(spark, sf_dir).select("edge", "u", "v").collect():
        near[r["u"]].add(r["v"])
        near[r["v"]].add(r["u"])
        ends[r["edge"]] = (r["u"], r["v"])
    nodes = {r["edge"]: r["nodes"] for r in QUERIES["local_structure"](spark, sf_dir).collect()}
    assert nodes == {e: len({u, v} | near[u] | near[v]) for e, (u, v) in ends.items()}


def test_contexts_hold_their_edges_and_structure_without_meeting_others(spark):
    """Edges inside contexts of more nodes than there are bits, and their structure counted in one pass as in several."""
    ends = [(k, k * 13 % 90, k * 31 % 90) for k in range(300)] + [(300, 5, 5), (301, 5, 5), (302, 0, 0)]
    edges = spark.createDataFrame([(0, k, u, v, None if k % 50 == 0 else k / 7) for k, u, v in ends], "image int, edge int, u int, v int, length double")
    held = {e: {n for n in range(90) if (n * 7 + e) % (e + 2) < 2} | {5} for e in range(6)} | {6: set(range(80)), 7: {89}}
    context = spark.createDataFrame([(0, e, n) for e, nodes in held.items() for n in nodes], "image int, edge int, node int")
    want = {(e, k, u, v) for e, nodes in held.items() for k, u, v in ends if u in nodes and v in nodes}
    inside = graph.induced(edges, context, ("u", "v", "length"))
    got = inside.select("edge", "other", "u", "v").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {(r["edge"], r["other"]) for r in graph.induced(edges, context).collect()} == {w[:2] for w in want}
    few, whole = (f(inside, ["image", "edge"]).toPandas().sort_values("edge").reset_index(drop=True) for f in (graph.structure_of_few, graph.structure))
    assert list(few.columns) == list(whole.columns) and few.round(9).equals(whole.astype(few.dtypes).round(9))


def test_angles_at_a_hub_take_one_pass(spark):
    """One row an angle and no frame that runs on to the end of its node, which costs the square of the node's branches."""
    rng = np.random.default_rng(5)
    angles = np.round(rng.uniform(-1e6, 1e6, 2000), 7)
    rows = [(1, float(a)) for a in angles] + [(2, 7.25), (2, 7.25), (3, 359.999999999), (3, 0.0), (4, 10.0), (4, None), (4, float("nan"))]
    got = graph.circular_spread(spark.createDataFrame(rows, "node int, angle double"), ["node"], "angle", 360)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan and "Generate" not in plan
    x = np.abs(angles[:, None] - angles[None, :])[np.triu_indices(len(angles), 1)] % 360
    d = np.minimum(x, 360 - x)
    got = {r["node"]: tuple(r)[1:] for r in got.collect()}
    assert got[1] == pytest.approx((d.min(), d.max(), d.mean(), d.std()), abs=1e-6)
    assert got[2] == got[3] == (0, 0, 0, 0) and set(got) == {1, 2, 3}
