"""Exact dedup by content sort: equal texts are found as neighbours of one sorted order of the corpus, without user functions.

A text is compared without the characters of ASCII white space. Rows are ordered by that content (its first characters,
then its SHA-256, which keeps keys short) and, where it is equal, by the order in which rows stay: most code points in the
original text, then smallest id. The order is made in three steps:

* sampled splitters: a sample of short keys, of a size that follows the number of partitions, is cut into as many ranges;
  each row finds its range by a binary search over the splitters and is dealt there. Since ids are part of the key, a
  group of copies that holds a third of all rows is cut into as many ranges as its share asks for;
* external sorting: each range is sorted by Spark, which spills;
* neighbouring comparisons: each row's whole text is compared with the one before it. Where they differ a run begins, and
  its first row is the one that stays.

From here on only short rows are left. Runs at the borders of ranges, two a range at most, are put together by their
digests, and what they add up to is broadcast: as many rows as there are ranges at most.

Defined results: null text counts as empty; all texts without other characters than white space are equal; a null id
comes before all others; of rows that repeat an id and a text one is kept; an empty table gives an empty result; other
columns are never looked at.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.tables import SPACE
from weft.session import stored

#: Sampled keys a range, and characters of the text in a key.
SAMPLED = 40
HEAD = 32
#: A key: content, then the order in which rows of equal content stay.
KEY = ["head", "sha", "shorter", "id"]
KEY_TYPE = "head string, sha string, shorter int, id long"


def normalised(text: Column) -> Column:
    """A text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the normalised text and the columns of its key."""
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text).alias("norm"), (-F.coalesce(F.length(text), F.lit(0))).alias("shorter"))
    return base.select("doc_id", "norm", F.substring("norm", 1, HEAD).alias("head"), F.sha2("norm", 256).alias("sha"), "shorter", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))


def splitters(docs: DataFrame, id_col: str, text_col: str, parts: int) -> list[dict]:
    """At most ``parts - 1`` keys that cut a sample of about ``SAMPLED * parts`` rows into equal shares, in order."""
    n = docs.count()
    if n == 0 or parts < 2:
        return []
    sample = docs.sample(min(1.0, SAMPLED * parts / n), seed=13)
    keys = sorted({tuple(r) for r in keyed(sample, id_col, text_col).select(*KEY).collect()})
    return [dict(zip(KEY, keys[k], strict=True)) for k in sorted({len(keys) * i // parts for i in range(1, parts)} - {0}) if k < len(keys)]


def range_of(cuts: list[dict]) -> Column:
    """The number of splitters up to a row's key, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(cuts, ensure_ascii=True)), f"array<struct<{KEY_TYPE.replace(' ', ':')}>>".replace(",:", ","))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    key = F.struct(*KEY)
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.coalesce(F.get(table, lo + step - 1) <= key, F.lit(False)), lo + step).otherwise(lo))


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Every row with its range ``part``, its place ``nth`` in its run there, and whether the run is the range's first or last."""
    cuts = splitters(docs, id_col, text_col, parts)
    ranged = keyed(docs, id_col, text_col).withColumn("part", range_of(cuts)).repartitionById(parts, "part")
    order = Window.partitionBy("part").orderBy(*KEY, "norm")
    # the whole texts of neighbours are compared here and dropped
    fresh = F.when(F.col("norm") == F.lag("norm").over(order), 0).otherwise(1)
    marked = ranged.select("part", "doc_id", *KEY[1:], fresh.alias("fresh"), F.row_number().over(order).alias("place"))
    so_far = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = marked.withColumn("run", F.sum("fresh").over(so_far))
    last = F.max("run").over(Window.partitionBy("part"))
    run = Window.partitionBy("part", "run")
    return runs.select(
        "part", "doc_id", "sha", "shorter", "id",
        F.row_number().over(run.orderBy("place")).alias("nth"),
        F.first("doc_id").over(run.orderBy("place")).alias("keep_id"),
        F.count("*").over(run).alias("size"),
        ((F.col("run") == 1) | (F.col("run") == last)).alias("border"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    parts: ranges of the sorted order; as many as there are shuffle partitions if not given.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = stored(sorted_runs(docs, id_col, text_col, parts), "content-sort")
    # at most two runs a range: the groups that are cut are fewer than the ranges
    ends = runs.filter("border and nth = 1")
    first = F.min(F.struct("shorter", "id", "part", "doc_id"))
    cut = ends.groupBy("sha").agg(F.count("*").alias("pieces"), F.sum("size").alias("whole"), first.alias("first")).filter("pieces > 1")
    cut = cut.select("sha", "whole", F.col("first.doc_id").alias("first_id"), F.col("first.part").alias("first_part"))
    out = runs.join(F.broadcast(cut), "sha", "left")
    return out.select(
        "doc_id",
        F.when(F.col("whole").isNull(), F.col("keep_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        ((F.col("nth") == 1) & F.coalesce(F.col("part") == F.col("first_part"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
