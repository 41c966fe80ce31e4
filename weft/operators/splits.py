"""Splits that keep groups whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import stored


def _dealt(sizes: DataFrame, order: list, dealt: int = 64) -> DataFrame:
    """sizes with rank: the place of each row by ``order``. Rows are sorted by ranges over all tasks, not in one."""
    ranged = sizes.repartitionByRange(dealt, *order).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("__part").orderBy(*order)
    at = ranged.withColumn("__place", F.row_number().over(within) - 1).join(F.broadcast(firsts), "__part")
    return at.withColumn("rank", F.col("__first") + F.col("__place")).drop("__part", "__place", "__first")


def grouped_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): groups by size dealt to folds back and forth, so folds are of about equal size.

    Fewer groups than folds make as many folds as groups; a single group is an error. Groups are counted with map-side sums
    and ranked by ranges, so that even with an image a group none of it is done in one task.
    """
    sizes = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"))
    many = sizes.count()
    if many < 2:
        raise ValueError("at least two groups are needed")
    k = min(folds, many)
    turn, place = F.floor(F.col("rank") / k), F.col("rank") % k
    return _dealt(sizes, [F.desc("n"), "group"]).select("group", "n", F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int").alias("fold"))


#: Groups that are dealt to folds one after the other; more are first put together by what classes they have.
MOST_GROUPS = 100_000


def stratified_folds(rows: DataFrame, group: str, label: str, folds: int, most_groups: int = MOST_GROUPS) -> DataFrame:
    """(group, fold): groups stay whole, and each fold has about the classes that all rows have.

    Groups are taken in order of how far their counts of the classes lie apart, the farthest first (then by name), and each goes
    to the fold where the classes' shares then differ least between folds (then to the one of fewest rows). This goes over the small
    table of groups and classes; where it has more than ``most_groups`` groups, those of like profile are dealt
    as one by turns, so no more than that ever reach the driver.
    """
    counts = stored(rows.groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count("*").alias("n")), "group-classes")
    many = counts.select("group").distinct().count()
    if many < 2:
        raise ValueError("at least two groups are needed")
    k = min(folds, many)
    profile = counts.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("classes"), F.sum("n").alias("n"))
    if many <= most_groups:
        units = profile.select("group", F.col("group").cast("string").alias("unit"))
        table = counts.select(F.col("group").cast("string").alias("unit"), "label", "n")
    else:
        # groups ranked by profile: neighbours are alike, and one in ``each`` goes to each of as many units
        ranked = _dealt(profile.select("group", "classes", "n"), ["classes", "n", "group"])
        units = stored(ranked.select("group", (F.col("rank") % most_groups).cast("string").alias("unit")), "units")
        table = counts.join(units, "group").groupBy("unit", "label").agg(F.sum("n").alias("n"))
    names = sorted({r[0] for r in table.select("label").distinct().collect()}, key=str)
    held: dict = {}
    for r in table.collect():
        held.setdefault(r["unit"], np.zeros(len(names)))[names.index(r["label"])] += r["n"]
    total = sum(held.values())
    have, out = np.zeros((k, len(names))), []
    for unit in sorted(held, key=lambda u: (-held[u].std(), u)):
        after = have[None] + np.eye(k)[:, :, None] * held[unit]
        spread = (after / total).std(axis=1).mean(axis=1)
        fold = min(range(k), key=lambda f: (round(float(spread[f]), 12), have[f].sum(), f))
        have[fold] += held[unit]
        out.append((unit, fold))
    found = rows.sparkSession.createDataFrame(out, "unit string, fold int")
    return units.join(found, "unit").select("group", "fold")


def holdout(rows: DataFrame, group: str, share: float) -> DataFrame:
    """(group, held): the groups of least hash are held out, share of them rounded up."""
    groups = rows.select(F.col(group).alias("group")).distinct()
    n = groups.count()
    ranked = _dealt(groups, [F.md5(F.col("group").cast("string")), "group"])
    return ranked.select("group", (F.col("rank") < -int(-share * n // 1)).alias("held"))


def leaks(assigned: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that are in more than one fold."""
    return assigned.groupBy(F.col(group).alias("group")).agg(F.countDistinct(fold).alias("folds")).filter("folds > 1")


def shared_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    return train.select(group).intersect(test.select(group))


def one_class_folds(rows: DataFrame, fold: str, label: str) -> DataFrame:
    """Folds in which only one class occurs."""
    return rows.groupBy(F.col(fold).alias("fold")).agg(F.countDistinct(label).alias("classes")).filter("classes < 2")


def image_conflicts(rows: DataFrame, image: str, group: str) -> DataFrame:
    """Images that are in more than one group (or on more than one side of a split)."""
    return rows.groupBy(F.col(image).alias("image")).agg(F.countDistinct(group).alias("groups")).filter("groups > 1")


def contained(part: DataFrame, whole: DataFrame, keys: list[str]) -> bool:
    """Whether every key of part is one of whole."""
    return part.join(whole.select(*keys).distinct(), keys, "left_anti").isEmpty()
