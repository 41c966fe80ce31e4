"""Finding and pairing files by name: ranks, prefixes, first and last wins.

Prefix joins are made equi joins: a name is exploded into its own prefixes (as many as it has separators), which are
joined by key, so no side is compared with all of the other.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The file name without folders and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def pair_key(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def prefixes(name: Column, separator: str = "_") -> Column:
    """name and its prefixes that end before a separator."""
    parts = F.split(name, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))


def owner(names: DataFrame, ids: DataFrame, name: str = "name", separator: str = "_") -> DataFrame:
    """names with the longest id that is the name or a prefix of it before a separator (NULL: none)."""
    each = names.withColumn("id", F.explode(prefixes(F.col(name), separator)))
    held = each.join(ids.select("id").distinct(), "id").groupBy(name).agg(F.max_by("id", F.length("id")).alias("owner"))
    return names.join(held, name, "left")


def best_file(files: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, path): the best file of each id: arrays before images, exact names before longer ones, then by path."""
    at = owner(files.withColumn("name", stem(F.col("path"))), ids).filter("owner is not null")
    score = F.when(F.col("path").endswith(".npy"), 0).otherwise(2) + F.when(F.col("name") == F.col("owner"), 0).otherwise(1)
    best = at.groupBy(F.col("owner").alias("id")).agg(F.min(F.struct(score.alias("score"), F.col("path"))).alias("x"))
    return best.select("id", "x.path", "x.score")


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of each key's last row; blank keys and values do not count."""
    k, v = F.trim(F.col(key)), F.trim(F.col(value))
    return rows.filter((k != "") & (v != "")).groupBy(k.alias(key)).agg(F.max_by(v, order).alias(value))


def catalogue(images: DataFrame, prob: DataFrame, masks: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """One row an image: its files where there are any, and its group, which is the image itself if none is given."""
    at = images
    for part, column in ((prob, "probability_path"), (masks, "mask_path"), (labels, "label_path")):
        at = at.join(part.select("image_id", F.col("path").alias(column)), "image_id", "left")
    at = at.join(groups.select("image_id", F.col("group").alias("__group")), "image_id", "left")
    return at.withColumn("panel_id", F.coalesce("__group", "image_id")).drop("__group")


def stale(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Inputs whose signature is not in the cache."""
    return current.join(cached, ["image_id", "signature"], "left_anti")


def matching(files: DataFrame, globs: str, path: str = "path") -> DataFrame:
    """files (a path) with ``priority``: the place of the first of comma-separated globs that their names match; others are left out.

    ``*`` stands for any characters, ``?`` for one, and brackets for one of some.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    place = F.lit(None).cast("int")
    for k, glob in reversed(list(enumerate(g.strip() for g in globs.split(",") if g.strip()))):
        place = F.when(name.rlike("^" + fnmatch.translate(glob).replace(r"\Z", r"\z")), k).otherwise(place)
    return files.withColumn("priority", place).filter("priority is not null")


def pairs(truths: DataFrame, predictions: DataFrame, truth_suffix: str, prediction_suffix: str) -> DataFrame:
    """(name, truth, prediction): files whose names differ in the suffix only; just the end of a name counts."""
    bare = lambda rows, suffix, out: rows.filter(F.col("path").endswith(suffix)).select(F.expr(f"substring(path, 1, length(path) - {len(suffix)})").alias("name"), F.col("path").alias(out))
    return bare(truths, truth_suffix, "truth").join(bare(predictions, prediction_suffix, "prediction"), "name")


def stripped(names: DataFrame, ids: DataFrame, suffixes: list[str], name: str = "name") -> DataFrame:
    """As ``owner``; a name without an id loses the first of the suffixes that it ends in, or owns itself."""
    bare = F.col(name)
    for suffix in reversed(suffixes):
        bare = F.when(F.col(name).endswith(suffix), F.expr(f"substring({name}, 1, length({name}) - {len(suffix)})")).otherwise(bare)
    return owner(names, ids, name).withColumn("owner", F.coalesce("owner", bare))


def ids_of(files: list[DataFrame], suffixes: list[str]) -> DataFrame:
    """The distinct ids of files (path) of several folders: their stems without a suffix."""
    paths = files[0].select("path")
    for more in files[1:]:
        paths = paths.union(more.select("path"))
    names = paths.select(stem(F.col("path")).alias("name")).distinct()
    return stripped(names, names.limit(0).select(F.col("name").alias("id")), suffixes).select(F.col("owner").alias("id")).distinct()


def selected(records: DataFrame, only: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Records of the images asked for (all, if none are), the first by image."""
    at = records if not only else records.filter(F.col("image_id").isin(only))
    return at if most is None else at.orderBy("image_id").limit(most)
