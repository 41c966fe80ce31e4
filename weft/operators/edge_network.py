"""Message passing on line graphs, forward and backward, as joins: a classifier of edges that learns from their neighbours.

An edge's neighbours are the other edges that share a node with it. Their mean goes forward into each layer; backward, the same sums
carry the gradients, since neighbourhood is symmetric. Nodes sum their edges once, so a hub costs its edges, not their pairs. The dense
parts run in numpy on batches of rows; each task adds up its own parameter gradients, and only sums of parameters' size reach the driver.

A layer is h + relu(W2 relu(norm(W1 ((1 + eps) h + mean) + b1)) + b2), normalised. Training is full-batch AdamW with clipped gradients, on
weighted cross-entropy (a plain mean over labelled rows), with focal weights if wanted; there is no dropout. A table is written for each
layer and direction.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import metrics, policies
from weft.operators.kernels import _kind
from weft.session import stored

KEYS = ["image", "edge", "u", "v"]


@dataclass
class Settings:
    hidden: int = 32
    layers: int = 2
    epochs: int = 40
    rate: float = 3e-3
    decay: float = 1e-4
    clip: float = 5.0
    focal: float = 0.0
    seed: int = 7


@dataclass
class Network:
    """Features, classes, the scaling of features, and parameters by name."""

    features: list
    classes: list
    layers: int
    mean: list
    scale: list
    parameters: dict
    history: list = field(default_factory=list)

    def arrays(self) -> dict:
        return {k: np.array(v) for k, v in self.parameters.items()}


def fresh(inputs: int, classes: int, s: Settings) -> dict:
    """Parameters to start from: uniform by the number of inputs, norms at 1 and 0."""
    rng, out = np.random.default_rng(s.seed), {}

    def linear(name: str, m: int, n: int):
        out[f"{name}.w"], out[f"{name}.b"] = (rng.uniform(-1, 1, x) / np.sqrt(m) for x in ((m, n), n))

    def norm(name: str):
        out[f"{name}.g"], out[f"{name}.c"] = np.ones(s.hidden), np.zeros(s.hidden)

    linear("in", inputs, s.hidden)
    norm("in")
    for k in range(s.layers):
        out[f"{k}.eps"] = np.zeros(1)
        linear(f"{k}a", s.hidden, s.hidden)
        norm(f"{k}a")
        linear(f"{k}z", s.hidden, s.hidden)
        norm(f"{k}z")
    linear("head", s.hidden, s.hidden)
    linear("out", s.hidden, classes)
    return out


class Tape:
    """Dense steps on a batch that remember what their gradients need; gradients of parameters add up in ``grads``."""

    def __init__(self, parameters: dict):
        self.p, self.grads = parameters, {}

    def _add(self, name: str, value: np.ndarray):
        self.grads[name] = self.grads.get(name, 0) + value

    def linear(self, name: str, x: np.ndarray):
        def back(g):
            self._add(f"{name}.w", x.T @ g)
            self._add(f"{name}.b", g.sum(axis=0))
            return g @ self.p[f"{name}.w"].T

        return x @ self.p[f"{name}.w"] + self.p[f"{name}.b"], back

    def norm(self, name: str, x: np.ndarray):
        centred = x - x.mean(axis=1, keepdims=True)
        deviation = np.sqrt((centred * centred).mean(axis=1, keepdims=True) + 1e-5)
        unit = centred / deviation

        def back(g):
            self._add(f"{name}.g", (g * unit).sum(axis=0))
            self._add(f"{name}.c", g.sum(axis=0))
            d = g * self.p[f"{name}.g"]
            return (d - d.mean(axis=1, keepdims=True) - unit * (d * unit).mean(axis=1, keepdims=True)) / deviation

        return unit * self.p[f"{name}.g"] + self.p[f"{name}.c"], back

    @staticmethod
    def relu(x: np.ndarray):
        return np.maximum(x, 0), lambda g: g * (x > 0)

    def run(self, x: np.ndarray, *steps):
        """x after the steps, and what takes a gradient back through all of them."""
        backs = []
        for step in steps:
            x, back = step(x)
            backs.append(back)

        def back(g):
            for b in reversed(backs):
                g = b(g)
            return g

        return x, back

    def start(self, x: np.ndarray):
        return self.run(x, lambda v: self.linear("in", v), lambda v: self.norm("in", v), self.relu)

    def layer(self, k: int, h: np.ndarray, mean: np.ndarray):
        """The next h, and what gives the gradients of h (through this edge alone) and of the mean."""
        eps = self.p[f"{k}.eps"][0]
        changed, inner = self.run((1 + eps) * h + mean, lambda v: self.linear(f"{k}a", v), lambda v: self.norm(f"{k}a", v), self.relu, lambda v: self.linear(f"{k}z", v), self.relu)
        out, outer = self.norm(f"{k}z", h + changed)

        def back(g):
            g = outer(g)
            into = inner(g)
            self._add(f"{k}.eps", np.array([(into * h).sum()]))
            return g + (1 + eps) * into, into

        return out, back

    def logits(self, h: np.ndarray):
        return self.run(h, lambda v: self.linear("head", v), self.relu, lambda v: self.linear("out", v))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def near_sums(rows: DataFrame, width: int) -> DataFrame:
    """rows (image, edge, u, v, vec, ...) with ``near``: the sum of vec over an edge's neighbours.

    An edge takes its nodes' sums, less what parallel edges have at both, less its own.
    """
    parts = F.array(*(F.sum(F.get("vec", F.lit(i))) for i in range(width)))
    ends = rows.select("image", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"), "vec")
    at_node = stored(ends.groupBy("image", "node").agg(parts.alias("t")), "node-sums")
    pair = [F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")]
    both = rows.filter("u <> v").select("image", *pair, "vec").groupBy("image", "a", "b").agg(parts.alias("both"))
    at = rows.withColumns({"a": pair[0], "b": pair[1]})
    at = at.join(at_node.select("image", F.col("node").alias("u"), F.col("t").alias("tu")), ["image", "u"])
    at = at.join(at_node.select("image", F.col("node").alias("v"), F.col("t").alias("tv")), ["image", "v"]).join(both, ["image", "a", "b"], "left")
    two = F.zip_with("tu", F.zip_with("tv", "both", lambda x, y: x - y), lambda x, y: x + y)
    near = F.zip_with(F.when(F.col("u") == F.col("v"), F.col("tu")).otherwise(two), "vec", lambda x, y: x - y)
    return at.select(*rows.columns, near.alias("near"))


VEC = "array<double>"


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def _table(batch, keys: int, *columns) -> pa.RecordBatch:
    names = [*KEYS[:keys], *(n for n, _ in columns)]
    arrays = [*batch.columns[:keys], *(c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(list(c), pa.list_(pa.float64())) for _, c in columns)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _schema(rows: DataFrame, more: str) -> str:
    return ", ".join(f"{k} {_kind(rows, k)}" for k in KEYS) + f", {more}"


def prepared(rows: DataFrame, features: list[str], classes: list[str], label: str | None, mean: list, scale: list, weights: dict) -> DataFrame:
    """KEYS, x (scaled; what is missing or not finite is 0 before), y (the place of the label, -1: none) and w."""
    value = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0)
    x = F.array(*((value(c) - float(m)) / float(s) for c, m, s in zip(features, mean, scale, strict=True)))
    y = F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1, F.lit(-1)) if label else F.lit(-1)
    w = F.element_at(F.array(*(F.lit(float(weights.get(c, 1.0))) for c in classes)), F.greatest(y, F.lit(0)) + 1)
    return rows.select(*KEYS, x.alias("x"), y.alias("y"), w.alias("w"))


def forward(state: DataFrame, parameters: dict, layers: int) -> DataFrame:
    """KEYS, x, y, w and acts: h before the first layer, then for each layer the neighbours' mean (its last cell their number) and h."""
    width = len(parameters["in.b"])

    def begin(batches):
        for batch in batches:
            if len(batch):
                h, _ = Tape(parameters).start(_matrix(batch.column(4)))
                yield _table(batch, 4, ("x", batch.column(4)), ("y", batch.column(5)), ("w", batch.column(6)), ("acts", pa.array([[r] for r in h.tolist()], pa.list_(pa.list_(pa.float64())))))

    schema = _schema(state, f"x {VEC}, y int, w double, acts array<{VEC}>")
    rows = stored(state.mapInArrow(begin, schema), "forward")
    for k in range(layers):

        def step(batches, k=k):
            for batch in batches:
                if len(batch):
                    near, acts = _matrix(batch.column(8)), batch.column(7).to_pylist()
                    n = near[:, -1:]
                    mean = near[:, :-1] / np.maximum(n, 1)
                    h, _ = Tape(parameters).layer(k, np.array([a[-1] for a in acts]), mean)
                    new = [[*a, m, r] for a, m, r in zip(acts, np.hstack([mean, n]).tolist(), h.tolist(), strict=True)]
                    yield _table(batch, 4, ("x", batch.column(4)), ("y", batch.column(5)), ("w", batch.column(6)), ("acts", pa.array(new, pa.list_(pa.list_(pa.float64())))))

        vec = F.concat(F.element_at("acts", -1), F.array(F.lit(1.0)))
        summed = near_sums(rows.withColumn("vec", vec), width + 1).select(*KEYS, "x", "y", "w", "acts", "near")
        rows = stored(summed.mapInArrow(step, schema), "forward")
    return rows


def _flat(grads: dict, parameters: dict) -> list:
    return np.concatenate([np.ravel(grads.get(k, np.zeros_like(v))) for k, v in parameters.items()]).tolist()


def gradient(state: DataFrame, parameters: dict, layers: int, focal: float = 0.0) -> tuple[float, dict]:
    """The loss over labelled rows and its gradient by every parameter."""
    n = state.filter("y >= 0").count()
    if not n:
        raise ValueError("no labelled rows")
    rows = forward(state, parameters, layers)
    total = np.zeros(1 + sum(v.size for v in parameters.values()))
    schema = _schema(state, f"x {VEC}, acts array<{VEC}>, base {VEC}, vec {VEC}, grads {VEC}")

    def partial(loss: float, grads: dict, batch):
        """What a task adds up, as a row without an edge."""
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, batch.schema.field(k).type) for k in range(4)), *(pa.nulls(1, t) for t in (pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.list_(pa.float64()))), pa.array([[loss, *_flat(grads, parameters)]], pa.list_(pa.float64()))], [*KEYS, "x", "acts", "base", "vec", "grads"])

    def through(tape: Tape, k: int, acts: list, g: np.ndarray, batch):
        """The rows that take a gradient back through layer k."""
        mean = np.array([a[2 * k + 1] for a in acts])
        _, back = tape.layer(k, np.array([a[2 * k] for a in acts]), mean[:, :-1])
        base, into = back(g)
        into = into / np.maximum(mean[:, -1:], 1)
        none = pa.nulls(len(batch), pa.list_(pa.float64()))
        return _table(batch, 4, ("x", batch.column(4)), ("acts", batch.column(batch.schema.get_field_index("acts"))), ("base", base.tolist()), ("vec", into.tolist()), ("grads", none))

    def head(batches):
        tape, loss, last = Tape(parameters), 0.0, None
        for batch in batches:
            if not len(batch):
                continue
            last, acts = batch, batch.column(7).to_pylist()
            y, w = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            out, back = tape.logits(np.array([a[-1] for a in acts]))
            p = softmax(out)
            at = np.arange(len(y))
            own = np.where(y >= 0, p[at, np.maximum(y, 0)], 1.0)
            w = np.where(y >= 0, w, 0.0) * (np.maximum(1 - own, 1e-6) ** focal if focal > 0 else 1.0) / n
            loss -= float((w * np.log(np.maximum(own, 1e-300))).sum())
            p[at, np.maximum(y, 0)] -= 1
            yield through(tape, layers - 1, acts, back(p * w[:, None]), batch)
        if last is not None:
            yield partial(loss, tape.grads, last)

    def summed(table: DataFrame):
        cells = table.filter("grads is not null").select(F.posexplode("grads").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g"))
        for r in cells.toLocalIterator():
            total[r["k"]] += r["g"]
        return table.filter("grads is null").drop("grads")

    rows = summed(stored(rows.mapInArrow(head, schema), "backward"))
    width = len(parameters["in.b"])
    for k in reversed(range(layers)):

        def step(batches, k=k):
            tape, last = Tape(parameters), None
            for batch in batches:
                if not len(batch):
                    continue
                last, acts = batch, batch.column(5).to_pylist()
                g = _matrix(batch.column(6)) + _matrix(batch.column(8))
                if k:
                    yield through(tape, k - 1, acts, g, batch)
                else:
                    tape.start(_matrix(batch.column(4)))[1](g)
            if last is not None:
                yield partial(0.0, tape.grads, last)

        back = near_sums(rows, width).select(*KEYS, "x", "acts", "base", "vec", "near")
        rows = summed(stored(back.mapInArrow(step, schema), "backward"))
    out, at = {}, 1
    for name, v in parameters.items():
        out[name] = total[at : at + v.size].reshape(v.shape)
        at += v.size
    return float(total[0]), out


def train(rows: DataFrame, features: list[str], label: str, classes: list[str], settings: Settings = Settings()) -> Network:
    """A network on the edges (image, edge, u, v, features, label) of whole graphs; rows without a class only pass messages on."""
    known = rows.filter(F.col(label).isin(list(classes)))
    weights = {r["class"]: r["weight"] for r in metrics.balanced_weights(known, label).collect()}
    if len(weights) < 2:
        raise ValueError("at least two classes must occur in the training rows")
    scales = {r["feature"]: (r["mean"], r["scale"]) for r in metrics.scaler(rows, features).collect()}
    mean, scale = [scales[c][0] for c in features], [scales[c][1] for c in features]
    state = stored(prepared(rows, features, classes, label, mean, scale, weights), "network-rows")
    p = fresh(len(features), len(classes), settings)
    first, second, history = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, []
    for epoch in range(1, settings.epochs + 1):
        loss, grads = gradient(state, p, settings.layers, settings.focal)
        history.append(loss)
        size = np.sqrt(sum((g * g).sum() for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, settings.clip / (size + 1e-6))
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            move = first[k] / (1 - 0.9**epoch) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
            p[k] = p[k] * (1 - settings.rate * settings.decay) - settings.rate * move
    return Network(list(features), list(classes), settings.layers, mean, scale, {k: v.tolist() for k, v in p.items()}, history)


def scored(rows: DataFrame, network: Network) -> DataFrame:
    """image, edge and the probabilities of all classes as an array."""
    missing = [c for c in network.features if c not in rows.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    p = network.arrays()
    done = forward(prepared(rows, network.features, network.classes, None, network.mean, network.scale, {}), p, network.layers)

    def last(batches):
        for batch in batches:
            if len(batch):
                out = softmax(Tape(p).logits(np.array([a[-1] for a in batch.column(2).to_pylist()]))[0])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.tolist(), pa.list_(pa.float64()))], ["image", "edge", "probability"])

    kinds = ", ".join(f"{k} {_kind(rows, k)}" for k in KEYS[:2])
    return done.select("image", "edge", "acts").mapInArrow(last, f"{kinds}, probability {VEC}")


def cross_validated(rows: DataFrame, features: list[str], label: str, classes: list[str], fold: str, settings: Settings = Settings()) -> DataFrame:
    """image, edge, label, fold, predicted and confidence of every labelled row, by a network that has not seen its fold.

    An image that lies in several folds is an error: its graph would be cut.
    """
    rows = stored(rows.select(*dict.fromkeys([*KEYS, *features, label, fold])), "rows")
    if rows.groupBy("image").agg(F.countDistinct(fold).alias("n")).filter("n > 1").count():
        raise ValueError("an image lies in several folds")
    out = None
    for k in sorted(r[0] for r in rows.select(fold).distinct().collect()):
        network = train(rows.filter(F.col(fold) != k), features, label, classes, settings)
        predicted, confidence = policies.best_class(F.col("probability"), classes)
        mine = rows.filter(F.col(fold) == k)
        part = scored(mine, network).select("image", "edge", predicted.alias("predicted"), confidence.alias("confidence")).join(mine.filter(F.col(label).isin(list(classes))).select("image", "edge", label, fold), ["image", "edge"])
        out = part if out is None else out.unionByName(part)
    return out


def save(network: Network, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(network)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Network:
    return Network(**json.loads(spark.read.text(path, wholetext=True).first()["value"]))
