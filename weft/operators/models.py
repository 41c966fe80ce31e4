"""Models with what belongs to them: saved, loaded, applied to feature tables and evaluated.

A saved model is a folder: ``metadata`` (one JSON line) tells its kind, features, classes, configuration and training rows; ``model``
holds boosted trees as JSON text, or a forest as a pipeline of Spark ML. All of it is written and read by Spark, so the folder may lie in
any store that the cluster reads.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import boosting, learning, metrics, policies
from weft.session import stored

KINDS = ("boosted", "forest")


@dataclass
class Metadata:
    """What a saved model says of itself."""

    kind: str
    features: list
    classes: list
    config: str = ""
    seed: int = 7
    training_rows: int = 0
    class_counts: dict = field(default_factory=dict)


@dataclass
class Classifier:
    metadata: Metadata
    model: object

    def probabilities(self, rows: DataFrame, column: str = "probability") -> DataFrame:
        """rows with an array of one probability for each class, in the metadata's order."""
        said = self.metadata
        if said.kind == "boosted":
            return boosting.scored(rows, self.model, column)
        at = self.model.transform(learning.assembled(rows, said.features)).withColumn(column, vector_to_array("probability"))
        return at.drop("features", "rawPrediction", "prediction", *(["probability"] if column != "probability" else []))


def train(rows: DataFrame, features: list[str], label: str, classes: list[str], kind: str = "boosted", config: str = "", seed: int = 7, settings: boosting.Settings = boosting.Settings(), **forest) -> Classifier:
    """A model on the rows whose label is one of the classes; other rows are left out."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}: one of {KINDS}")
    rows = stored(rows.filter(F.col(label).isin(list(classes))).select(*features, label), "training")
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    if len(counts) < 2:
        raise ValueError(f"the training rows have {'a single class' if counts else 'no class'}: {sorted(counts)}")
    if kind == "boosted":
        model = boosting.fit(rows, features, label, classes, settings)
    else:
        place = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
        model = learning.fit_forest(rows.withColumn("__class", place.cast("double")), features, "__class", seed=seed, **forest)
        if model.numClasses < len(classes):  # the last classes are absent: their columns are 0
            model = _Padded(model, len(classes))
    return Classifier(Metadata(kind, list(features), list(classes), config, seed, sum(counts.values()), counts), model)


class _Padded:
    """A forest whose last classes did not occur."""

    def __init__(self, model: RandomForestClassificationModel, classes: int):
        self.model, self.classes = model, classes

    def transform(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        full = F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), self.classes - self.model.numClasses))
        return self.model.transform(rows).withColumn("probability", array_to_vector(full))


def save(made: Classifier, spark: SparkSession, path: str) -> None:
    """Writes the model's folder; an older one there is replaced. Metadata comes last, so half a model is none."""
    if made.metadata.kind == "boosted":
        spark.createDataFrame([(made.model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    else:
        (made.model.model if isinstance(made.model, _Padded) else made.model).write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(asdict(made.metadata)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str, classes: list[str] | None = None, config: str | None = None) -> Classifier:
    """A saved model. Missing or broken metadata is an error, and so are other classes or another configuration than asked for."""
    try:
        lines = [r["value"] for r in spark.read.text(f"{path}/metadata").collect()]
    except AnalysisException as why:
        raise FileNotFoundError(f"no model metadata in {path}") from why
    try:
        said = Metadata(**json.loads("\n".join(lines)))
    except (ValueError, TypeError) as why:
        raise ValueError(f"the metadata of {path} is no model's: {why}") from why
    if said.kind not in KINDS:
        raise ValueError(f"unknown kind {said.kind!r} in {path}")
    for what, have, want in (("classes", said.classes, classes), ("configuration", said.config, config)):
        if want is not None and have != want:
            raise ValueError(f"{path} has {what} {have}, not {want}")
    if said.kind == "boosted":
        model = boosting.Boosted.from_json(spark.read.text(f"{path}/model", wholetext=True).first()["value"].strip())
        if (model.features, model.classes) != (said.features, said.classes):
            raise ValueError(f"the metadata of {path} is another model's")
        return Classifier(said, model)
    model = RandomForestClassificationModel.load(f"{path}/model")
    if model.numFeatures != len(said.features) or model.numClasses > len(said.classes):
        raise ValueError(f"the metadata of {path} is another model's")
    return Classifier(said, model if model.numClasses == len(said.classes) else _Padded(model, len(said.classes)))


def classify(made: Classifier, edges: DataFrame, least: float = 0.55, policy: str = policies.UNCERTAIN) -> DataFrame:
    """edges with prob_<class>, confidence, raw_label and predicted_label: uncertain below ``least``, or by the junction policy."""
    names = made.metadata.classes
    scored = made.probabilities(edges, "__p")
    scored = scored.withColumns({f"prob_{n}": F.get("__p", F.lit(k)) for k, n in enumerate(names)})
    label, confidence = policies.best_class(F.col("__p"), names)
    scored = scored.withColumn("__label", label).withColumn("confidence", confidence).drop("__p")
    return policies.junction_policy(policies.abstain(scored, "confidence", "__label", least).drop("__label"), policy)


def cross_validated(rows: DataFrame, features: list[str], label: str, classes: list[str], fold: str, keep: list[str], kind: str = "boosted", **settings) -> DataFrame:
    """keep, label, fold, predicted and confidence of every row by a model that has not seen its fold.

    A fold whose other rows have a single class is an error.
    """
    rows = stored(rows.select(*dict.fromkeys([*keep, *features, label, fold])), "rows")
    out = None
    for k in sorted(r[0] for r in rows.select(fold).distinct().collect()):
        made = train(rows.filter(F.col(fold) != k), features, label, classes, kind, **settings)
        at = made.probabilities(rows.filter(F.col(fold) == k), "__p")
        predicted, confidence = policies.best_class(F.col("__p"), classes)
        part = at.select(*dict.fromkeys([*keep, label, fold]), predicted.alias("predicted"), confidence.alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(rows: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confusion, metrics of each class and their summary of rows with a label and a prediction."""
    counts = metrics.confusion(rows.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()), label, predicted, by)
    each = metrics.per_class(counts, by)
    return counts, each, metrics.summary(each, by)


def refitted(rows: DataFrame, features: list[str], label: str, classes: list[str], fold: str, **settings) -> tuple[Classifier, DataFrame, DataFrame]:
    """A model on all rows; its cross-validation: mean and deviation of each metric over folds, and the confusion summed over them."""
    done = stored(cross_validated(rows, features, label, classes, fold, [], **settings), "validated")
    counts, _, each = evaluate(done, label, "predicted", [fold])
    summed = counts.groupBy("truth", "predicted").agg(F.sum("n").alias("n"))
    return train(rows, features, label, classes, **settings), metrics.over_folds(each, [c for c in each.columns if c != fold]), summed
