"""What the operators on repeated passages share: runs of windows, their classes, and texts joined with verdicts.

``a`` groups the runs that can share windows; within it ``c`` is a class of runs that cover the same units in the same
way. A group with one class is settled by counts. Where several classes meet, their windows are compared once per
class, however many copies a class has, and never in pairs. Groups are read with map-side aggregation and joined by
key, so that a hot passage is one row a task on one side and can be split on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "doc_id long, h long, a long, c long, lo int, n int"
KEY = ["doc_id", "h"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h and text; h tells texts apart that repeat a doc_id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def joined(texts: DataFrame, found: DataFrame, packed: Column) -> DataFrame:
    """Every text once more with an array ``found`` of what was found in it (null: nothing).

    A left join, so that all uses of the same texts read one shuffle of them.
    """
    each = found.groupBy(*KEY).agg(F.collect_list(packed).alias("found"))
    return texts.join(each, KEY, "left").select(*KEY, "text", "found")
