"""Classification metrics over (truth, prediction) rows, weighted or not, with abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _share(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Counts of each (truth, prediction), in long form."""
    return rows.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each class of a long confusion; 0 where undefined."""
    by = by or []
    sides = counts.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "n", (F.col("truth") == F.col("predicted")).alias("hit"))
    sums = sides.groupBy(*by, F.col("s.class").alias("class")).agg(
        F.sum(F.col("n") * F.col("s.t")).alias("support"), F.sum(F.col("n") * F.col("s.p")).alias("predicted"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.t")).otherwise(0)).alias("tp")
    )
    precision, recall = _share(F.col("tp"), F.col("predicted")), _share(F.col("tp"), F.col("support"))
    return sums.select(*by, "class", "support", precision.alias("precision"), recall.alias("recall"), _share(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def summary(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and weighted F1, and recall averaged over the classes that occur."""
    total = F.sum("support")
    aggs = [
        F.try_divide(F.sum(F.col("recall") * F.col("support")), total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    ]
    return classes.groupBy(*by).agg(*aggs) if by else classes.agg(*aggs)


def bundle(rows: DataFrame, truth: str, predicted: str, classes: list, by: list[str] | None = None, abstained: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confusion over all pairs of classes, metrics of every class, and one row of summary with notes, for each ``by``.

    Rows that abstain are not scored, only counted in coverage and abstention_rate. Classes that don't occur have rows of zeros, and
    count in macro_f1; balanced_accuracy is over those that occur. Without scored rows the summary's metrics are NULL.
    """
    by = by or []
    out = F.coalesce(F.col(abstained), F.lit(False)) if abstained else F.lit(False)
    spine = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    every = lambda name: F.explode(F.array(*map(F.lit, classes))).alias(name)
    joined = lambda a, b, keys: a.join(b, [*by, *keys], "left")
    counts = confusion(rows.filter(~out), truth, predicted, by)
    full = joined(spine.select(*by, every("truth")).select(*by, "truth", every("predicted")), counts, ["truth", "predicted"]).na.fill(0, ["n"])
    each = per_class(full, by)
    of = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(~out).alias("scored")) if by else rows.agg(F.count("*").alias("rows"), F.count_if(~out).alias("scored"))
    missing = F.array_sort(F.collect_list(F.when(F.col("support") == 0, F.col("class").cast("string"))))
    sums = summary(each, by)
    gaps = each.groupBy(*by).agg(missing.alias("__missing"), F.count_if(F.col("support") > 0).alias("__present")) if by else each.agg(missing.alias("__missing"), F.count_if(F.col("support") > 0).alias("__present"))
    at = joined(of, sums, []).join(gaps, by, "left") if by else of.withColumn("__k", F.lit(1)).join(sums.withColumn("__k", F.lit(1)), "__k").join(gaps.withColumn("__k", F.lit(1)), "__k").drop("__k")
    none = F.col("scored") == 0
    notes = F.filter(F.array(
        F.when(F.col("rows") == 0, "empty evaluation set"), F.when((F.col("rows") > 0) & none, "every prediction abstained; no scored rows"),
        F.when(~none & (F.size("__missing") > 0), F.concat(F.lit("no true rows of: "), F.array_join("__missing", ", "))),
        F.when(~none & (F.col("__present") < 2), "scored rows have a single true class"),
    ), lambda x: x.isNotNull())
    values = [F.when(~none, F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")]
    share = F.try_divide(F.col("scored").cast("double"), F.col("rows"))
    return full, each, at.select(*by, "rows", *values, share.alias("coverage"), (1 - share).alias("abstention_rate"), notes.alias("notes"))


def length_weighted(rows: DataFrame, truth: str, predicted: str, length: str) -> DataFrame:
    """Recall of each class and of all (class NULL), by length; NULL where the lengths sum to nothing."""
    hit = F.when(F.col(truth) == F.col(predicted), F.col(length)).otherwise(0).cast("double")
    sums = rows.rollup(F.col(truth).alias("class")).agg(F.sum(hit).alias("right"), F.sum(F.col(length).cast("double")).alias("length"))
    return sums.select("class", "length", F.when(F.col("length") > 0, F.col("right") / F.col("length")).alias("recall"))


def coverage(rows: DataFrame, abstained: str, truth: str, predicted: str) -> DataFrame:
    """How many rows are decided, and how many of those are right."""
    decided = ~F.col(abstained)
    return rows.agg(
        F.count("*").alias("n"), F.count_if(decided).alias("decided"),
        F.try_divide(F.count_if(decided).cast("double"), F.count("*")).alias("coverage"),
        F.try_divide(F.count_if(decided & (F.col(truth) == F.col(predicted))).cast("double"), F.count_if(decided)).alias("accuracy"),
    )


def over_folds(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over folds, NULLs left out, in long form."""
    long = folds.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds"))


def contingency(rows: DataFrame, group: str, label: str, labels: list) -> DataFrame:
    """Rows of each group under each label, one column a label."""
    return rows.groupBy(group).pivot(label, labels).count().na.fill(0)


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class) for each class."""
    counts = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    return counts.select("class", "n", (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("weight"))


def scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and scale of each column in long form: missing is 0, and a deviation under 1e-6 scales by 1."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value")) for c in columns))).alias("x")
    sums = rows.select(values).groupBy("x.feature").agg(F.avg("x.value").alias("mean"), F.stddev_pop("x.value").alias("std"))
    return sums.select("feature", "mean", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")).alias("scale"))


def share_of_total(rows: DataFrame, label: str, length: str) -> DataFrame:
    """Count, length and share of all length of each label."""
    sums = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum(length).alias("length"))
    return sums.withColumn("share", F.try_divide(F.col("length").cast("double"), F.sum("length").over(Window.partitionBy()).cast("double")))
