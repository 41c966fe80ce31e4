"""Threshold sweeps over scored pixels.

Scores are integers from 0 to ``top``; thresholds are i * step of the way up. A pixel is predicted where its score is
strictly above the threshold. No row meets a threshold: scores are counted per image and level with map-side sums, and
the counts above each threshold are running sums over those few rows, so the cost does not grow with the thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(scored: DataFrame, image: str, score: str, truth: str) -> DataFrame:
    """image, level, pos and neg: pixels of each score with and without the truth."""
    t = F.col(truth).cast("boolean")
    return scored.groupBy(F.col(image).alias("image"), F.col(score).cast("int").alias("level")).agg(F.count_if(t).alias("pos"), F.count_if(~t).alias("neg"))


def curve(scored: DataFrame, image: str, score: str, truth: str, top: int = 255, step: float = 0.01) -> DataFrame:
    """image, k, threshold, tp, fp, fn, tn of every image at every threshold."""
    n = round(1 / step)
    levels = histogram(scored, image, score, truth)
    # a level is above thresholds 0 to last: level > k * step * top
    last = F.least(F.ceil(F.col("level") / F.lit(top * step)) - 1, F.lit(n - 1)).cast("int")
    cells = levels.withColumn("k", last).groupBy("image", "k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = cells.select("image").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("threshold", F.col("k") * F.lit(float(step)))
    filled = grid.join(cells, ["image", "k"], "left").na.fill(0, ["pos", "neg"])
    above = Window.partitionBy("image").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    totals = levels.groupBy("image").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    run = filled.select("image", "k", "threshold", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp")).join(totals, "image")
    return run.select("image", "k", "threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing is right."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def micro_curve(at: DataFrame) -> DataFrame:
    """Precision (1 where nothing is predicted), recall and F1 of all images together at each threshold."""
    s = at.groupBy("k", "threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(1.0))
    recall = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    return s.select("k", "threshold", "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def ods(at: DataFrame) -> DataFrame:
    """The best threshold for the whole dataset, by the mean of the images' F1."""
    mean = at.groupBy("k", "threshold").agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("ods"))
    return mean.orderBy(F.desc(F.round("ods", 9)), "k").limit(1)


def ois(at: DataFrame) -> DataFrame:
    """The mean over images of the F1 at each image's own best threshold."""
    best = at.groupBy("image").agg(F.max(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("best"))
    return best.agg(F.avg("best").alias("ois"), F.count("*").alias("images"))


def best_miou(at: DataFrame) -> DataFrame:
    """The best over thresholds of the mean over images of the two classes' mean IoU; an empty class has none."""
    on = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))
    off = F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp") + F.col("fn")).cast("double"))
    return at.groupBy("k", "threshold").agg(F.avg((on + off) / 2).alias("miou")).agg(F.max("miou").alias("best_miou"))


def report(at: DataFrame) -> DataFrame:
    """One row: independent best F1, precision and recall of the micro curve, with ODS, OIS and the best mIoU."""
    m = micro_curve(at).agg(F.max("f1").alias("f1"), F.max("precision").alias("precision"), F.max("recall").alias("recall"))
    return m.select("*", ods(at).select("ods").scalar().alias("ods"), ois(at).select("ois").scalar().alias("ois"), best_miou(at).scalar().alias("best_miou"))


def accuracy(scored: DataFrame, predicted: str, truth: str) -> DataFrame:
    return scored.agg(F.count_if(F.col(predicted) == F.col(truth)).alias("right"), F.count("*").alias("pixels"))


def at_half_of_most(scored: DataFrame, image: str, score: str, truth: str) -> DataFrame:
    """Precision, recall and F1 of all images together, each cut at half of its own greatest score."""
    top = scored.groupBy(F.col(image).alias("image")).agg(F.max(score).alias("top"))
    at = scored.select(F.col(image).alias("image"), F.col(score).alias("s"), F.col(truth).alias("t")).join(top, "image").withColumn("p", F.col("s") > F.col("top") / 2)
    n = at.agg(F.count_if(F.expr("p and t")).alias("tp"), F.count_if(F.expr("p and not t")).alias("fp"), F.count_if(F.expr("not p and t")).alias("fn"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return n.select("tp", "fp", "fn", F.coalesce(d(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), d(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def segment_metrics(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Share of right pixels, and accuracy and IoU averaged over the classes that occur."""
    c = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = c.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("p").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("x"), "n", (F.col("t") == F.col("p")).alias("hit"))
    k = sides.groupBy("x.k").agg(F.sum(F.col("n") * F.col("x.a")).alias("truths"), F.sum(F.col("n") * F.col("x.b")).alias("guesses"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.a")).otherwise(0)).alias("hits"))
    return k.agg(
        (F.sum("hits") / F.sum("truths")).alias("accuracy"), F.avg(F.try_divide(F.col("hits").cast("double"), F.col("truths"))).alias("class_accuracy"),
        F.avg(F.try_divide(F.col("hits").cast("double"), F.col("truths") + F.col("guesses") - F.col("hits"))).alias("mean_iou"),
    )


def soft_losses(rows: DataFrame, image: str, p: str, truth: str, smooth: float = 1.0, least: float = 1e-7) -> DataFrame:
    """Dice loss and binary cross entropy of each image's probabilities."""
    t, x = F.col(truth).cast("double"), F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col(p)))
    return rows.groupBy(F.col(image).alias("image")).agg(
        (1 - (2 * F.sum(F.col(p) * t) + smooth) / (F.sum(F.col(p)) + F.sum(t) + smooth)).alias("dice_loss"), F.avg(-(t * F.ln(x) + (1 - t) * F.ln(1 - x))).alias("bce")
    )
