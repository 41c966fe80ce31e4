"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): every end of an edge with the least id it is connected to.

    A round gives each vertex the least of its neighbours and itself, follows these to their ends by pointer jumping, and makes
    each tree one vertex, named by its least: at least every second vertex goes, and with it most edges, so all rounds together
    move little more than the first. The least vertex of a component always keeps its name. Least neighbours are taken on the
    map side, and joins with a hot vertex's one label can be split. Edges with a null end are ignored.
    """
    left = stored(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null"), "edges")
    found = None
    while True:
        least = left.union(left.select("dst", "src")).groupBy("src").agg(F.min("dst").alias("least"))
        labels = _to_roots(least.select(F.col("src").alias("id"), F.least("src", "least").alias("component")))
        further = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        found = labels if found is None else stored(found.join(further, "component", "left").select("id", F.coalesce("further", "component").alias("component")), "labels")
        to = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"to_{c}"))
        moved = left.join(to("src"), "src").join(to("dst"), "dst").filter("to_src <> to_dst")
        left = stored(moved.select(F.col("to_src").alias("src"), F.col("to_dst").alias("dst")).distinct(), "edges")
        if left.isEmpty():
            return found


def _to_roots(labels: DataFrame) -> DataFrame:
    """Labels (id, component), each no more than its id and itself an id, followed until they stay: the way doubles each time."""
    labels = stored(labels, "labels")
    while True:
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = stored(labels.join(jump, "component").select("id", F.col("component").alias("was"), F.col("further").alias("component")), "labels")
        labels = after.select("id", "component")
        if after.filter("was <> component").isEmpty():
            return labels
