"""Gradient-boosted trees of several classes, from sums that Spark makes.

Features become bins by quantiles. In each round every class gets a tree: softmax gradients and second derivatives are summed for
each (class, node, feature, bin), first in each task and then by key; the best split of each node is chosen from running sums
over its bins. Only the chosen splits and the leaves reach the driver. Scores are written once a round, so a lost executor costs
a task.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.metrics import balanced_weights
from weft.session import stored


@dataclass
class Settings:
    """Sizes of the trees and how fast they learn."""

    rounds: int = 30
    depth: int = 3
    rate: float = 0.1
    bins: int = 64
    penalty: float = 1.0
    least_gain: float = 1e-9


@dataclass
class Boosted:
    """Trees as arrays by node (the children of node k are 2k + 1 and 2k + 2): feature (-1: a leaf), last bin that goes left, value."""

    features: list
    classes: list
    present: list
    cuts: list
    settings: dict
    trees: list = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        return cls(**json.loads(text))

    def binned(self, x: np.ndarray) -> np.ndarray:
        """The bin of each value; what is missing or not finite counts as 0."""
        x = np.where(np.isfinite(x), x, 0.0)
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8) if len(self.cuts) else np.zeros((len(x), 0), np.uint8)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each class; classes that were absent from the training rows have 0."""
        bins = self.binned(x)
        scores = np.zeros((len(x), len(self.present)))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                scores[:, k] += values_of(tree, bins)
        out = np.zeros((len(x), len(self.classes)))
        out[:, self.present] = softmax(scores)
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def nodes_of(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node that each row has come down to."""
    feature, cut = np.array(tree["feature"]), np.array(tree["cut"])
    node = np.zeros(len(bins), np.int64)
    while len(some := np.flatnonzero(feature[node] >= 0)):
        at = node[some]
        node[some] = 2 * at + 1 + (bins[some, feature[at]] > cut[at])
    return node


def values_of(tree: dict, bins: np.ndarray) -> np.ndarray:
    return np.array(tree["value"])[nodes_of(tree, bins)]


def quantile_cuts(rows: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """At most ``bins - 1`` different cuts for each column."""
    clean = rows.select(*(F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0).alias(c) for c in columns))
    found = clean.agg(*(F.percentile_approx(c, F.array(*(F.lit(k / bins) for k in range(1, bins))), 10_000).alias(c) for c in columns)).first()
    return [sorted(set(found[c] or [])) for c in columns]


def _state(rows: DataFrame, model: Boosted, columns: list[str], label: str) -> DataFrame:
    """label (its place among the classes that are present), weight, bins and scores of each row."""
    place = {model.classes[k]: i for i, k in enumerate(model.present)}
    weights = balanced_weights(rows, label).select(F.col("class").alias(label), "weight")
    at = rows.join(F.broadcast(weights), label).select(F.col(label).alias("label"), F.col("weight").cast("double").alias("weight"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))

    def start(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column(2).to_pylist()], float)
            bins = model.binned(x)
            scores = np.zeros((len(batch), len(model.present)))
            yield pa.RecordBatch.from_arrays([pa.array([place[v] for v in batch.column(0).to_pylist()], pa.int32()), batch.column(1), pa.array([r.tobytes() for r in bins]), pa.array([r.tobytes() for r in scores])], ["label", "weight", "bins", "scores"])

    return at.mapInArrow(start, "label int, weight double, bins binary, scores binary")


def _arrays(batch, features: int, classes: int):
    label, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, features)
    scores = np.frombuffer(b"".join(batch.column(3).to_pylist()), float).reshape(-1, classes)
    return label, weight, bins, scores


def gradients(label: np.ndarray, weight: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log loss by each score."""
    p = softmax(scores)
    g = p.copy()
    g[np.arange(len(label)), label] -= 1
    return weight[:, None] * g, weight[:, None] * p * (1 - p)


def _sums(state: DataFrame, model: Boosted, trees: list, level: int) -> DataFrame:
    """Gradient and second derivative of each (class, node of this level, feature, bin)."""
    features, classes, bins = len(model.features), len(model.present), model.settings["bins"]
    first, many = 2**level - 1, 2**level

    def add(batches):
        held = np.zeros((classes, many, features, bins, 2))
        for batch in batches:
            if not len(batch):
                continue
            label, weight, b, scores = _arrays(batch, features, classes)
            g, h = gradients(label, weight, scores)
            for k in range(classes):
                node = nodes_of(trees[k], b) - first
                some = np.flatnonzero((node >= 0) & (node < many))
                for f in range(features):
                    cell = node[some] * bins + b[some, f]
                    for j, x in enumerate((g[some, k], h[some, k])):
                        held[k, :, f, :, j] += np.bincount(cell, x, many * bins).reshape(many, bins)
        at = np.argwhere(held[..., 1] > 0)
        sums = held[tuple(at.T)]
        yield pa.RecordBatch.from_arrays([*(pa.array(at[:, j].astype("i4")) for j in range(4)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["class", "node", "feature", "bin", "g", "h"])

    parts = state.mapInArrow(add, "class int, node int, feature int, bin int, g double, h double")
    return parts.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _splits(sums: DataFrame, penalty: float) -> DataFrame:
    """The split of greatest gain of each (class, node), the first of equals, with the sums of both sides."""
    cell = Window.partitionBy("class", "node", "feature")
    left = cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sums.select("class", "node", "feature", "bin", *(F.sum(c).over(left).alias(f"{c}l") for c in "gh"), *(F.sum(c).over(cell).alias(f"{c}t") for c in "gh"))
    score = lambda g, h: g * g / (h + penalty)
    at = at.withColumns({"gr": F.col("gt") - F.col("gl"), "hr": F.col("ht") - F.col("hl")})
    gain = score(F.col("gl"), F.col("hl")) + score(F.col("gr"), F.col("hr")) - score(F.col("gt"), F.col("ht"))
    at = at.withColumn("gain", F.when(F.col("hr") > 1e-12, gain).otherwise(0.0))
    best = F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "gr", "hr")).alias("x")
    return at.groupBy("class", "node").agg(best, F.first("gt").alias("gt"), F.first("ht").alias("ht")).select("class", "node", "x.*", "gt", "ht")


def fit(rows: DataFrame, columns: list[str], label: str, classes: list[str], settings: Settings = Settings()) -> Boosted:
    """Trees on rows whose label is one of the classes, balanced by class. At least two classes must occur."""
    if settings.bins < 2 or settings.bins > 256:
        raise ValueError("2 to 256 bins")
    have = {r[0] for r in rows.select(label).distinct().collect()}
    if unknown := have - set(classes):
        raise ValueError(f"labels that are no class: {sorted(map(str, unknown))}")
    present = [k for k, c in enumerate(classes) if c in have]
    if len(present) < 2:
        raise ValueError("the training rows have a single class" if present else "there are no training rows")
    model = Boosted(list(columns), list(classes), present, quantile_cuts(rows, columns, settings.bins), asdict(settings))
    state = stored(_state(rows, model, columns, label), "boost")
    size = 2 ** (settings.depth + 1) - 1
    for _ in range(settings.rounds):
        trees = [{"feature": [-1] * size, "cut": [0] * size, "value": [0.0] * size} for _ in present]
        worth = lambda g, h: -settings.rate * g / (h + settings.penalty)
        for level in range(settings.depth):
            for r in _splits(_sums(state, model, trees, level), settings.penalty).collect():
                tree, node = trees[r["class"]], 2**level - 1 + r["node"]
                if level == 0:
                    tree["value"][0] = worth(r["gt"], r["ht"])
                if r["gain"] > settings.least_gain:
                    tree["feature"][node], tree["cut"][node] = -r["f"], -r["b"]
                    tree["value"][2 * node + 1], tree["value"][2 * node + 2] = worth(r["gl"], r["hl"]), worth(r["gr"], r["hr"])
        model.trees.append(trees)
        state = stored(_advanced(state, model, trees), "boost")
    return model


def _advanced(state: DataFrame, model: Boosted, trees: list) -> DataFrame:
    """The state with the scores that a round's trees add."""
    features, classes = len(model.features), len(model.present)

    def add(batches):
        for batch in batches:
            if len(batch):
                _, _, bins, scores = _arrays(batch, features, classes)
                new = scores + np.stack([values_of(t, bins) for t in trees], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in new])], batch.schema.names)

    return state.mapInArrow(add, "label int, weight double, bins binary, scores binary")


def scored(rows: DataFrame, model: Boosted, column: str = "probability") -> DataFrame:
    """rows with the probabilities of all classes as an array."""
    missing = [c for c in model.features if c not in rows.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def probabilities(x):
        values = np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), len(shared.value.features))
        import pandas as pd

        return pd.Series(list(shared.value.probabilities(values)))

    return rows.withColumn(column, probabilities(F.array(*(F.col(c).cast("double") for c in model.features))))


def log_loss(rows: DataFrame, model: Boosted, label: str) -> float:
    """The mean log loss over rows, by class weights as in training."""
    at = scored(rows, model, "__p").join(F.broadcast(balanced_weights(rows, label).select(F.col("class").alias(label), "weight")), label)
    place = F.array_position(F.array(*map(F.lit, model.classes)), F.col(label)).cast("int")
    each = -F.log(F.greatest(F.element_at("__p", place), F.lit(1e-15)))
    return at.agg(F.sum(F.col("weight") * each) / F.sum("weight")).first()[0]
