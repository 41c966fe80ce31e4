"""Queries without SQL against plain computations over their own rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from weft.operators import kernels, skeleton_graph
from weft.plans import mosaic_queries, relations
from weft.plans.catalogue import QUERIES

AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def planes_of(rows):
    """image: the set of its pixels."""
    out = defaultdict(set)
    for r in rows.collect():
        out[r["image"]].add((r["row"], r["col"]))
    return out


def thinned(pixels):
    top, left = (min(p[k] for p in pixels) for k in (0, 1))
    grid = np.zeros((max(r for r, _ in pixels) - top + 3, max(c for _, c in pixels) - left + 3), bool)
    for r, c in pixels:
        grid[r - top + 1, c - left + 1] = True
    return {(int(r) + top - 1, int(c) + left - 1) for r, c in np.argwhere(kernels.thin(grid))}


def near(p, pixels):
    return [(p[0] + r, p[1] + c) for r, c in AROUND if (p[0] + r, p[1] + c) in pixels]


def parts(pixels):
    left, out = set(pixels), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            for q in near(todo.pop(), left):
                left.discard(q)
                part.add(q)
                todo.append(q)
        out.append(part)
    return out


def graph_of(thin):
    """Counts of nodes by kind, their pixels, and the number of edges of thinned pixels."""
    many = {p: len(near(p, thin)) for p in thin}
    clusters = [(c, "junction") for c in parts({p for p in thin if many[p] >= 3})]
    clusters += [({p}, "endpoint" if many[p] == 1 else "isolated") for p in thin if many[p] < 2]
    owner = {p: k for k, (c, _) in enumerate(clusters) for p in c}
    kinds, sizes, edges = Counter(k for _, k in clusters), Counter(), 0
    for c, k in clusters:
        sizes[k] += len(c)
    for chain in parts(thin - set(owner)):
        if any(q in owner for p in chain for q in near(p, thin)):
            edges += 1
        elif len(chain) >= 3:
            kinds["virtual_loop"] += 1
            sizes["virtual_loop"] += 1
            edges += 1
    edges += len({tuple(sorted((owner[p], owner[q]))) for p in owner for q in near(p, owner) if owner[p] != owner[q]})
    return kinds, sizes, edges


@pytest.fixture(scope="module")
def mosaic(spark, sf_dir):
    return planes_of(mosaic_queries._mask(spark, sf_dir))[0]


def test_the_mosaic_is_thinned_as_a_whole(spark, sf_dir, mosaic):
    assert planes_of(QUERIES["mosaic_thinned"](spark, sf_dir))[0] == thinned(mosaic)


def test_the_mosaic_graph_has_its_nodes_and_edges(spark, sf_dir, mosaic):
    kinds, sizes, edges = graph_of(thinned(mosaic))
    got = {r["kind"]: (r["n"], r["pixels"]) for r in QUERIES["mosaic_graph"](spark, sf_dir).collect()}
    assert got.pop("edge")[0] == edges and got == {k: (n, sizes[k]) for k, n in kinds.items()}


def test_skeleton_graphs_of_all_rasters(spark, sf_dir):
    want = {}
    for image, pixels in planes_of(relations.mask(spark, sf_dir)).items():
        kinds, _, edges = graph_of(thinned(pixels))
        want[image] = (sum(kinds.values()), kinds["junction"], kinds["endpoint"], edges)
    assert {r["image"]: (r["nodes"], r["junctions"], r["endpoints"], r["edges"]) for r in QUERIES["skeleton_graph"](spark, sf_dir).collect()} == want


def test_chains_of_all_rasters_are_traced(spark, sf_dir):
    chains = defaultdict(dict)
    for r in QUERIES["thin_and_trace"](spark, sf_dir).collect():
        chains[r["image"], r["component"]][r["pos"]] = (r["row"], r["col"])
    got = defaultdict(list)
    for (image, component), at in chains.items():
        path = [at[k] for k in range(len(at))]
        assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))
        assert component == (image << 40) + (min(path)[0] << 20) + min(path)[1]
        got[image].append(set(path))
    for image, pixels in planes_of(relations.mask(spark, sf_dir)).items():
        thin = thinned(pixels)
        assert sorted(map(sorted, got[image])) == sorted(map(sorted, parts({p for p in thin if len(near(p, thin)) <= 2})))


def test_gap_pairs_are_taken_one_by_one(spark, sf_dir):
    points = defaultdict(list)
    for r in relations.nodes(spark, sf_dir).collect():
        points[r["image"]].append((r["node"], r["row"], r["col"]))
    want = set()
    for image, ps in points.items():
        cells = defaultdict(list)
        for n, r, c in ps:
            cells[r // 3, c // 3].append((n, r, c))
        pairs = sorted({(((r - y) ** 2 + (c - x) ** 2) ** 0.5, n, m) for n, r, c in ps for i in (-1, 0, 1) for j in (-1, 0, 1) for m, y, x in cells[r // 3 + i, c // 3 + j] if n < m and (r - y) ** 2 + (c - x) ** 2 <= 9})
        used = set()
        for _, a, b in pairs:
            if not {a, b} & used:
                used |= {a, b}
                want.add((image, a, b))
    got = QUERIES["gap_pairs"](spark, sf_dir)
    assert {(r["image"], r["a"], r["b"]) for r in got.collect()} == want and got.count() == len(want)
    # the same in rounds
    candidates = spark.createDataFrame([(0, k, k + 1, 1.0) for k in range(40)] + [(0, k, k + 2, 2.0) for k in range(0, 40, 3)], "image int, a int, b int, distance double")
    one, two = ({tuple(r) for r in skeleton_graph.greedy_pairs(candidates, most).collect()} for most in (10**6, 0))
    assert one == two and len(one) == 20


def test_noise_goes_by_skeleton_and_box_first(spark, sf_dir):
    """The reasons that need no ratio: their counts over all rasters, and that the others take what is left."""
    want, total = Counter(), 0
    for pixels in planes_of(relations.mask(spark, sf_dir)).values():
        thin = thinned(pixels)
        for part in parts(pixels):
            r, c = (np.array([p[k] for p in part]) for k in (0, 1))
            total += 1
            want["skeleton_length" if len(part & thin) < 2 else "bbox_diagonal" if np.hypot(np.ptp(r) + 1, np.ptp(c) + 1) < 2.9 else "rest"] += 1
    got = {r["reason"]: r["n"] for r in QUERIES["noise_reasons"](spark, sf_dir).collect()}
    assert got["skeleton_length"] == want["skeleton_length"] and got.get("bbox_diagonal", 0) == want["bbox_diagonal"] and sum(got.values()) == total
    assert sum(n for k, n in got.items() if k in ("elongation", "confidence", "kept")) == want["rest"]
