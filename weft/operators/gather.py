"""Values of rasters along paths, and messages along line graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import ratio
from weft.operators.graph import neighbour_sums
from weft.operators.paths import normals, series
from weft.operators.raster import PIXEL


def sampled(paths: DataFrame, values: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Series statistics of a raster along each path, and whether there are any values."""
    at = paths.join(values.select(*PIXEL, F.col(value).alias("__v")), PIXEL)
    s = series(at, keys, "__v", prefix)
    return paths.select(*keys).distinct().join(s, keys, "left").withColumn(f"{prefix}_available", F.col(f"{prefix}_mean").isNotNull().cast("int"))


def flanks(paths: DataFrame, values: DataFrame, keys: list[str], value: str, offset: float) -> DataFrame:
    """Mean value on each path and at either side ``offset`` away along the normal, contrast and asymmetry.

    Pixels outside the raster do not count.
    """
    n = normals(paths, keys)
    side = lambda k: n.select(*keys, "image", F.rint(F.col("row") + k * offset * F.col("normal_row")).cast("int").alias("row"), F.rint(F.col("col") + k * offset * F.col("normal_col")).cast("int").alias("col"))
    v = values.select(*PIXEL, F.col(value).cast("double").alias("__v"))
    mean = lambda rows, name: rows.join(v, PIXEL).groupBy(*keys).agg(F.avg("__v").alias(name))
    at = paths.select(*keys).distinct()
    for rows, name in ((paths, "on"), (side(1), "left"), (side(-1), "right")):
        at = at.join(mean(rows, name), keys, "left")
    flank = (F.coalesce("left", "right") + F.coalesce("right", "left")) / 2
    return at.withColumn("contrast", flank - F.col("on")).withColumn("asymmetry", F.abs(F.col("left") - F.col("right")))


def line_graph_layer(edges: DataFrame, columns: list[str], weights: list[list[float]], bias: list[float], eps: float = 0.0) -> DataFrame:
    """One layer of message passing on the line graph: relu(W ((1 + eps) h + mean of the neighbours' h) + b) as out_0, out_1, ...

    Nodes sum their edges once, so a hot node costs as much as its edges, not their pairs.
    """
    at = neighbour_sums(edges, columns, tuple(columns))
    h = [(1 + eps) * F.col(c) + F.coalesce(ratio(F.col(f"sum_{c}").cast("double"), F.col("n")), F.lit(0.0)) for c in columns]
    out = [F.greatest(sum((w * x for w, x in zip(row, h, strict=True)), F.lit(float(b))), F.lit(0.0)).alias(f"out_{k}") for k, (row, b) in enumerate(zip(weights, bias, strict=True))]
    return at.select("image", "edge", *out)
