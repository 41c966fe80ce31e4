"""What becomes of predictions: abstention, conflicts at junctions, review samples."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCERTAIN = "uncertain"


def best_class(probabilities: Column, names: list[str]) -> tuple[Column, Column]:
    """The class of the greatest probability (the first of equals) and that probability."""
    top = F.array_max(probabilities)
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(probabilities, top).cast("int")), top


def abstain(rows: DataFrame, confidence: str, label: str, least: float) -> DataFrame:
    """raw_label, and predicted_label where the confidence is enough."""
    return rows.withColumn("raw_label", F.col(label)).withColumn("predicted_label", F.when(F.col(confidence) >= least, F.col(label)).otherwise(UNCERTAIN))


def junction_conflicts(edges: DataFrame) -> DataFrame:
    """(image, edge, conflict): has neighbours with labels, and none of them the same. Rows: image, edge, u, v, raw_label.

    Uncertain edges are in no conflict and no evidence for one. Rows without an image are those of one image, and no label is a
    label like any other. Each node counts its labels once; an edge compares its own with its nodes' counts, so a hot node
    is not paired out.
    """
    # a struct of one column is equal to itself where the column is null
    own = edges.select(F.struct("image").alias("of"), "edge", "u", "v", F.struct("raw_label").alias("label")).filter(F.coalesce(F.col("raw_label") != UNCERTAIN, F.lit(True)))
    e = own.select("of", "edge", "label", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))
    labels = e.groupBy("of", "node", "label").agg(F.count("*").alias("alike"))
    degree = labels.groupBy("of", "node").agg(F.sum("alike").alias("all"))
    at = e.join(labels.join(degree, ["of", "node"]), ["of", "node", "label"])
    found = at.groupBy("of", "edge").agg((F.bool_or(F.col("all") > 1) & ~F.bool_or(F.col("alike") > 1)).alias("conflict"))
    return found.select("of.image", "edge", "conflict")


def junction_policy(edges: DataFrame, policy: str = UNCERTAIN) -> DataFrame:
    """edges with predicted_label, which conflicts turn to uncertain unless the policy is ``keep``.

    Tables without ends or labels are left as they are, with a warning; another policy is an error.
    """
    if policy not in (UNCERTAIN, "keep"):
        raise ValueError(f"unknown policy {policy!r}: {UNCERTAIN!r} or 'keep'")
    if policy == "keep":
        return edges
    if missing := sorted({"image", "edge", "u", "v", "raw_label", "predicted_label"} - set(edges.columns)):
        warnings.warn(f"no junction policy without columns {missing}", stacklevel=2)
        return edges
    found = junction_conflicts(edges).filter("conflict").select(F.col("image").alias("__image"), F.col("edge").alias("__edge"), "conflict")
    at = edges.join(found, F.col("image").eqNullSafe(F.col("__image")) & (F.col("edge") == F.col("__edge")), "left")
    return at.withColumn("predicted_label", F.when(F.col("conflict"), UNCERTAIN).otherwise(F.col("predicted_label"))).drop("conflict", "__image", "__edge")


def review_sample(rows: DataFrame, key: str, group: str, length: str, least: float, most: int) -> DataFrame:
    """Of each group the longest half of ``most`` rows and as many others by hash, from those long enough."""
    fit = rows.filter(F.col(length) >= least)
    w = Window.partitionBy(group).orderBy(F.desc(length), key)
    ranked = fit.withColumn("rank", F.row_number().over(w))
    head = most // 2
    tail = Window.partitionBy(group, (F.col("rank") > head)).orderBy(F.md5(F.col(key).cast("string")), key)
    return ranked.withColumn("nth", F.row_number().over(tail)).filter((F.col("rank") <= head) | (F.col("nth") <= most - head)).select(group, key, length, (F.col("rank") <= head).alias("longest"))


def top_by_size(rows: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """The k rows of greatest absolute value."""
    return rows.orderBy(F.desc(F.abs(F.col(value))), name).limit(k).select(name, value)
