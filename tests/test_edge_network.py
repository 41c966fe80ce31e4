"""The edge network against a dense computation with finite differences, and its training."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import edge_network as net
from weft.operators import models

FEATURES = ["f", "g"]
CLASSES = ["a", "b", "c"]


def graph_rows(seed=1, images=4, edges=14):
    rng, out = random.Random(seed), []
    for image in range(images):
        for k in range(edges):
            u = rng.randrange(6)
            v = rng.choice([u, 0, 0, rng.randrange(6)])
            f = rng.gauss(0, 1)
            out.append((image, k, u, v, f, rng.choice([rng.random(), None]), "a" if f > 0.3 else rng.choice(["b", "b", "c"]) if rng.random() < 0.9 else None, image % 2))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(graph_rows(), "image int, edge int, u int, v int, f double, g double, label string, fold int").cache()


def adjacency(data):
    n = len(data)
    a = np.zeros((n, n))
    for i, x in enumerate(data):
        for j, y in enumerate(data):
            if i != j and x[0] == y[0] and {x[2], x[3]} & {y[2], y[3]}:
                a[i, j] = 1
    return a


def dense_loss(p, x, y, w, a, layers, focal=0.0, fixed=None):
    """The loss with all pairs of edges at hand; fixed: probabilities that focal weights are held at."""
    tape = net.Tape(p)
    h = tape.start(x)[0]
    mean = a / np.maximum(a.sum(axis=1, keepdims=True), 1)
    for k in range(layers):
        h = tape.layer(k, h, mean @ h)[0]
    out = net.softmax(tape.logits(h)[0])
    own = out[np.arange(len(y)), np.maximum(y, 0)]
    held = own if fixed is None else fixed
    each = w * (np.maximum(1 - held, 1e-6) ** focal if focal else 1.0) * -np.log(own)
    return each[y >= 0].sum() / (y >= 0).sum(), own


def test_neighbour_sums_are_those_of_all_pairs(spark, rows):
    data = graph_rows()
    at = rows.withColumn("vec", F.array("f", F.lit(1.0)))
    got = {(r["image"], r["edge"]): r["near"] for r in net.near_sums(at, 2).collect()}
    a = adjacency(data)
    f = np.array([r[4] for r in data])
    for i, r in enumerate(data):
        assert np.allclose(got[r[0], r[1]], [a[i] @ f, a[i].sum()])


@pytest.mark.parametrize("focal", [0.0, 2.0])
def test_gradients_equal_finite_differences(spark, rows, focal):
    s = net.Settings(hidden=5, layers=2, seed=3)
    p = net.fresh(2, 3, s)
    rng = np.random.default_rng(0)
    p = {k: v + 0.3 * rng.normal(size=v.shape) for k, v in p.items()}
    state = net.prepared(rows, FEATURES, CLASSES, "label", [0.1, 0.4], [1.5, 0.3], {"a": 0.5, "b": 1.0, "c": 2.0})
    got = state.orderBy("image", "edge").collect()
    x, y, w = np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), np.array([r["w"] for r in got])
    a = adjacency(graph_rows())
    loss, grads = net.gradient(state, p, s.layers, focal)
    want, own = dense_loss(p, x, y, w, a, s.layers, focal)
    assert abs(loss - want) < 1e-9 and grads.keys() == p.keys()
    for name, value in p.items():
        for at in rng.permutation(value.size)[:6]:
            place, step = np.unravel_index(at, value.shape), 1e-6
            up, down = ({k: v.copy() for k, v in p.items()} for _ in "ab")
            up[name][place] += step
            down[name][place] -= step
            slope = (dense_loss(up, x, y, w, a, s.layers, focal, own)[0] - dense_loss(down, x, y, w, a, s.layers, focal, own)[0]) / (2 * step)
            assert abs(grads[name][place] - slope) < 1e-6, (name, place)


def test_training_lowers_the_loss_and_comes_back(spark, rows, tmp_path):
    network = net.train(rows, FEATURES, "label", CLASSES, net.Settings(hidden=8, layers=1, epochs=6, rate=0.05))
    assert network.history[-1] < network.history[0] - 0.05
    net.save(network, spark, str(tmp_path / "n"))
    again = net.load(spark, str(tmp_path / "n"))
    one, two = ({(r["image"], r["edge"]): r["probability"] for r in net.scored(rows, n).collect()} for n in (network, again))
    assert one == two and len(one) == len(graph_rows()) and all(abs(sum(p) - 1) < 1e-9 for p in one.values())
    with pytest.raises(ValueError, match="two classes"):
        net.train(rows.filter("label = 'a'"), FEATURES, "label", CLASSES)
    with pytest.raises(ValueError, match="missing"):
        net.scored(rows.drop("f"), network)


def test_folds_are_evaluated(rows):
    done = net.cross_validated(rows, FEATURES, "label", CLASSES, "fold", net.Settings(hidden=4, layers=1, epochs=2))
    counts, _, each = models.evaluate(done, "label", "predicted", ["fold"])
    labelled = sum(r[6] is not None for r in graph_rows())
    assert sum(r["n"] for r in counts.collect()) == labelled and {r["fold"] for r in each.collect()} == {0, 1}
    with pytest.raises(ValueError, match="several folds"):
        net.cross_validated(rows.withColumn("fold", F.col("edge") % 2), FEATURES, "label", CLASSES, "fold")
