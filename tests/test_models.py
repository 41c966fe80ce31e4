"""Boosted trees against plain loops, models saved and loaded, stratified folds."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import boosting, models, splits

COLUMNS = ["x", "y", "z"]
CLASSES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for k in range(400):
        x, y, z = rng.gauss(0, 1), rng.random(), rng.choice([0.0, 1.0, None, float("nan")])
        label = "a" if x + (z or 0 if z == z else 0) > 0.7 else "c" if y > 0.8 else "b" if x < -0.5 or rng.random() < 0.1 else "a"
        out.append((k, x, y, z, label, k % 3, k % 40, 0, k % 9, (k * 7) % 9))
    return spark.createDataFrame(out, "id long, x double, y double, z double, label string, fold int, edge long, image int, u long, v long").cache()


def boosted_brute(x, label, model, settings):
    """The same trees by loops over all rows, bins and features."""
    bins = model.binned(x)
    n, classes = len(label), len(model.present)
    counts = Counter(label.tolist())
    weight = np.array([n / (classes * counts[k]) for k in label])
    scores = np.zeros((n, classes))
    losses = []
    for _ in range(settings.rounds):
        p = boosting.softmax(scores)
        losses.append(-(weight * np.log(p[np.arange(n), label])).sum() / weight.sum())
        g, h = boosting.gradients(label, weight, scores)
        add = np.zeros_like(scores)
        for k in range(classes):
            def grow(members, depth):
                gt, ht = g[members, k].sum(), h[members, k].sum()
                best = (settings.least_gain, None)
                if depth < settings.depth:
                    for f in range(bins.shape[1]):
                        for cut in np.unique(bins[members, f])[:-1]:
                            left = bins[members, f] <= cut
                            gl, hl = g[members, k][left].sum(), h[members, k][left].sum()
                            gain = round(gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 9)
                            if gain > best[0]:
                                best = (gain, (f, cut))
                if best[1] is None:
                    add[members, k] = -settings.rate * gt / (ht + 1)
                else:
                    f, cut = best[1]
                    grow(members[bins[members, f] <= cut], depth + 1)
                    grow(members[bins[members, f] > cut], depth + 1)

            grow(np.arange(n), 0)
        scores += add
    return boosting.softmax(scores), losses


@pytest.fixture(scope="module")
def made(rows):
    return models.train(rows, COLUMNS, "label", CLASSES, settings=boosting.Settings(rounds=4, depth=2, rate=0.5, bins=16))


def test_boosting_is_that_of_plain_loops(rows, made):
    at = rows.orderBy("id").toPandas()
    x = np.where(at[COLUMNS].notna(), at[COLUMNS], 0.0).astype(float)
    label = np.array([made.model.present.index(CLASSES.index(v)) for v in at["label"]])
    want, losses = boosted_brute(x, label, made.model, boosting.Settings(rounds=4, depth=2, rate=0.5, bins=16))
    got = np.array([r["probability"] for r in made.probabilities(rows).orderBy("id").collect()])
    assert np.abs(got[:, made.model.present] - want).max() < 1e-9
    assert (got[:, 3] == 0).all() and np.allclose(got.sum(axis=1), 1)
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False)) and boosting.log_loss(rows, made.model, "label") < losses[-1]


def test_models_come_back_as_they_were(spark, rows, made, tmp_path):
    forest = models.train(rows, COLUMNS, "label", CLASSES, "forest", config="h1", trees=5, depth=3)
    for k, one in enumerate((made, forest)):
        models.save(one, spark, f"{tmp_path}/{k}")
        again = models.load(spark, f"{tmp_path}/{k}", CLASSES, one.metadata.config)
        assert again.metadata == one.metadata and again.metadata.training_rows == 400 and set(again.metadata.class_counts) == {"a", "b", "c"}
        a, b = ([(r["id"], r["raw_label"], r["predicted_label"], [r[f"prob_{c}"] for c in CLASSES]) for r in models.classify(m, rows).orderBy("id").collect()] for m in (one, again))
        assert a == b and {x[1] for x in a} == {"a", "b", "c"} and any(x[2] == "uncertain" for x in a)


def test_wrong_metadata_is_an_error(spark, rows, made, tmp_path):
    with pytest.raises(FileNotFoundError):
        models.load(spark, f"{tmp_path}/none")
    models.save(made, spark, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="classes"):
        models.load(spark, f"{tmp_path}/m", ["a", "b"])
    with pytest.raises(ValueError, match="configuration"):
        models.load(spark, f"{tmp_path}/m", config="other")
    for text in ('{"kind": "boosted"}', "no json", '{"kind": "linear", "features": [], "classes": []}', '{"kind": "boosted", "features": ["q"], "classes": ["a"]}'):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/m/metadata")
        with pytest.raises(ValueError):
            models.load(spark, f"{tmp_path}/m")
    with pytest.raises(ValueError, match="missing feature columns"):
        made.probabilities(rows.drop("y"))
    with pytest.raises(ValueError, match="single class"):
        models.train(rows.filter("label = 'a'"), COLUMNS, "label", CLASSES)
    with pytest.raises(ValueError, match="unknown kind"):
        models.train(rows, COLUMNS, "label", CLASSES, "linear")


def test_cross_validation_and_refit(rows):
    model, over, summed = models.refitted(rows, COLUMNS, "label", CLASSES, "fold", settings=boosting.Settings(rounds=2, depth=2, rate=0.5, bins=8))
    got = {r["metric"]: (r["mean"], r["folds"]) for r in over.collect()}
    assert got["accuracy"][1] == 3 and 0.6 < got["accuracy"][0] <= 1 and sum(r["n"] for r in summed.collect()) == 400 and model.metadata.training_rows == 400


def test_stratified_folds_keep_groups_and_shares(spark):
    rng = random.Random(6)
    data = []
    for g in range(60):
        lean = rng.choice("abc")
        data += [(f"g{g:02d}", lean if rng.random() < 0.7 else rng.choice("abc")) for _ in range(rng.randint(1, 40))]
    df = spark.createDataFrame(data, "panel string, label string")
    got = {r["group"]: r["fold"] for r in splits.stratified_folds(df, "panel", "label", 5).collect()}
    assert set(got) == {g for g, _ in data} and set(got.values()) == set(range(5))
    total, by = Counter(label for _, label in data), {f: Counter() for f in range(5)}
    for g, label in data:
        by[got[g]][label] += 1
    largest = max(Counter(g for g, _ in data).values())
    for f in by:
        for c, n in total.items():
            assert abs(by[f][c] - n / 5) <= largest
    plain = {r["group"]: r["fold"] for r in splits.grouped_folds(df, "panel", 5).collect()}
    off = lambda folds: sum((sum(1 for g, x in data if folds[g] == f and x == c) - n / 5) ** 2 for f in range(5) for c, n in total.items())
    assert off(got) < off(plain)
    # one group less, and none of them is split; few groups make few folds
    assert {r["fold"] for r in splits.stratified_folds(df.filter("panel in ('g01', 'g02')"), "panel", "label", 5).collect()} == {0, 1}
    with pytest.raises(ValueError, match="two groups"):
        splits.stratified_folds(df.filter("panel = 'g01'"), "panel", "label", 5)
    assert splits.one_class_folds(df.withColumn("fold", F.lit(1)).filter("label = 'a'"), "fold", "label").count() == 1
