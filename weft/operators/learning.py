"""A tree baseline on feature tables, and mean-neighbour features on line graphs."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import metrics, policies
from weft.operators.metrics import balanced_weights
from weft.session import stored


def numeric_columns(rows: DataFrame, without: list[str]) -> list[str]:
    return [c for c, t in rows.dtypes if c not in without and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with a vector of features, what is missing or not finite as 0."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    filled = rows.withColumns({f"__{c}": F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0) for c in columns})
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="features").transform(filled).drop(*(f"__{c}" for c in columns))


def fit_forest(rows: DataFrame, columns: list[str], label: str, trees: int = 20, depth: int = 5, seed: int = 7):
    """A forest with balanced class weights."""
    weights = balanced_weights(rows, label).select(F.col("class").alias(label), "weight")
    at = assembled(rows, columns).join(F.broadcast(weights), label)
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(at)


def cross_validated(rows: DataFrame, columns: list[str], label: str, fold: str, **settings) -> DataFrame:
    """Every row with the prediction and confidence of a forest that has not seen its fold.

    A forest goes over its rows once for each of many jobs, so rows are made once and written.
    """
    rows = stored(rows, "rows")
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    out = None
    for k in folds:
        model = fit_forest(rows.filter(F.col(fold) != k), columns, label, **settings)
        part = model.transform(assembled(rows.filter(F.col(fold) == k), columns))
        part = part.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("features", "rawPrediction", "probability")
        out = part if out is None else out.unionByName(part)
    return out


def without_prefixes(columns: list[str], prefixes: list[str]) -> list[str]:
    """The columns that start with none of the prefixes."""
    return [c for c in columns if not c.startswith(tuple(prefixes))]


def importances(model, columns: list[str]) -> list[tuple[str, float]]:
    """Each feature's share in the splits of a forest, the largest first."""
    return sorted(zip(columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def classified(model, rows: DataFrame, columns: list[str], names: list[str], least: float, policy: str = policies.UNCERTAIN) -> DataFrame:
    """Edges (image, edge, u, v and features) with prob_<class>, confidence, raw_label and predicted_label: what is less sure
    than ``least``, and by the policy what contradicts all its neighbours, is uncertain."""
    scored = model.transform(assembled(rows, columns)).withColumn("__p", vector_to_array("probability"))
    scored = scored.withColumns({f"prob_{n}": F.get("__p", F.lit(k)) for k, n in enumerate(names)})
    label, confidence = policies.best_class(F.col("__p"), names)
    scored = scored.withColumn("__label", label).withColumn("confidence", confidence).drop("__p", "features", "rawPrediction", "probability", "prediction")
    return policies.junction_policy(policies.abstain(scored, "confidence", "__label", least).drop("__label"), policy)


def cross_validation_report(rows: DataFrame, columns: list[str], label: str, fold: str, **settings) -> tuple[DataFrame, DataFrame]:
    """Mean and deviation over folds of accuracy, F1 and recall (metric, mean, std), and the confusion summed over folds."""
    done = cross_validated(rows, columns, label, fold, **settings).withColumn("predicted", F.col("prediction").cast("int"))
    counts = metrics.confusion(done, label, "predicted", [fold])
    each = metrics.summary(metrics.per_class(counts, [fold]), [fold])
    summed = counts.groupBy("truth", "predicted").agg(F.sum("n").alias("n"))
    return metrics.over_folds(each, [c for c in each.columns if c != fold]), summed
