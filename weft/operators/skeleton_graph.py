"""Multigraphs of skeletons: nodes at junctions, ends and rings, edges along the pixels between them.

Clusters and chains are connected components of pixel relations; only the order of a chain's pixels is traced one chain
at a time, so images of any size are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators import kernels, raster
from weft.operators.components import connected_components
from weft.operators.graph import medoids, pairs_within
from weft.operators.raster import PIXEL
from weft.session import stored

AROUND = [o for o in raster.square(1) if o != (0, 0)]


def node_pixels(skeleton: DataFrame, radius: int = 0) -> DataFrame:
    """(image, row, col, node, type): junction clusters, ends and lone pixels. node: the least pixel key of its cluster.

    Junction pixels (three neighbours or more) that touch are a cluster. Where several clusters lie within ``radius``, so that
    the discs around their pixels touch, the skeleton's pixels inside the discs that hang together with them are one cluster.
    Only places inside the frame count: what lies outside joins nothing.
    """
    at = raster.neighbour_count(skeleton)
    junctions = stored(raster.labelled(at.filter("neighbours >= 3").select(*PIXEL)).withColumnRenamed("component", "node"), "junctions")
    clusters = junctions
    if radius:
        grown = raster.shifted(junctions, raster.disk(radius)).filter("row >= 0 and col >= 0").distinct()
        regions = stored(raster.labelled(grown).withColumnRenamed("component", "region"), "regions")
        many = junctions.join(regions, PIXEL).groupBy("region").agg(F.countDistinct("node").alias("n")).filter("n > 1").select("region")
        inside = regions.join(many, "region", "left_semi").select(*PIXEL)
        pieces = stored(raster.labelled(inside.join(skeleton.select(*PIXEL), PIXEL)).withColumnRenamed("component", "node"), "bridges")
        held = pieces.join(junctions.select(*PIXEL), PIXEL, "left_semi").select("image", "node").distinct()
        clusters = raster.minus(junctions, inside).unionByName(pieces.join(held, ["image", "node"], "left_semi"))
    clusters = clusters.select(*PIXEL, "node", F.lit("junction").alias("type"))
    tips = raster.minus(at.filter("neighbours < 2"), clusters)
    return clusters.unionByName(tips.select(*PIXEL, raster.pixel_id(at).alias("node"), F.when(F.col("neighbours") == 1, "endpoint").otherwise("isolated").alias("type")))


def _direct_id(pixels: DataFrame, u: str, v: str) -> Column:
    """The number, or for images that are no numbers the text, of an edge without pixels."""
    number = F.xxhash64(u, v)
    return number if isinstance(pixels.schema["image"].dataType, T.IntegralType) else F.concat(F.lit("direct:"), F.col(u), F.lit("-"), F.col(v))


def build(skeleton: DataFrame, radius: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (image, node, type, row, col, pixels and their extents), edges (image, edge, u, v, length, pixels, is_loop) and
    paths (image, edge, pos, row, col).

    A chain of pixels between nodes is an edge; one that leaves and meets the same node is a loop; one that meets a single
    node at one end comes back to it. Its path starts and ends at the nearest pixel of either node. A ring of three pixels or
    more without nodes gets a virtual node, and its path ends where it starts. Nodes that touch are joined by an edge of the
    first two pixels that do.
    """
    px = stored(node_pixels(skeleton, radius), "node-pixels")
    chains = stored(raster.labelled(raster.minus(skeleton.select(*PIXEL), px)), "chains")
    walked = stored(kernels.traced(chains).withColumnRenamed("component", "edge"), "chains-in-order")

    key = ["image", "edge"]
    last = F.max("pos").over(Window.partitionBy(*key))
    tips = walked.withColumn("last", last).filter("pos = 0 or pos = last")
    near = raster.shifted(px.withColumns({"nr": F.col("row"), "nc": F.col("col")}), AROUND, ["node", "nr", "nc"])
    far = (F.col("row") - F.col("nr")) * (F.col("row") - F.col("nr")) + (F.col("col") - F.col("nc")) * (F.col("col") - F.col("nc"))
    met = tips.join(near, PIXEL).groupBy(*key, "pos", "last", "node").agg(F.min(F.struct(far.alias("far"), F.col("nr").alias("row"), F.col("nc").alias("col"))).alias("at"))
    # a chain of one pixel meets its two nodes at the same place
    side = F.struct("node", "at")
    sides = met.groupBy(*key).agg(F.min(F.when(F.col("pos") == 0, side)).alias("a"), F.max(F.when(F.col("pos") == F.col("last"), side)).alias("b"))
    sides = sides.select(*key, F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b"))

    sizes = walked.groupBy(*key).agg(F.count("*").alias("pixels"), F.min(F.struct("pos", "row", "col")).alias("first")).join(sides, key, "left")
    rings = sizes.filter("a is null and pixels >= 3")
    ring_nodes = rings.select("image", F.col("edge").alias("node"), F.lit("virtual_loop").alias("type"), F.col("first.row").alias("row"), F.col("first.col").alias("col"), F.lit(1).cast("long").alias("pixels"), *(F.col(f"first.{c}").alias(n) for n, c in (("top", "row"), ("bottom", "row"), ("left", "col"), ("right", "col"))))
    along = sizes.filter("a is not null").select(*key, F.col("a.node").alias("u"), F.col("b.node").alias("v")).unionByName(rings.select(*key, F.col("edge").alias("u"), F.col("edge").alias("v")))

    other = px.select(*PIXEL, F.col("node").alias("v"))
    pair = F.struct(F.struct("nr", "nc").alias("x"), F.struct("row", "col").alias("y"))
    touching = near.withColumnRenamed("node", "u").join(other, PIXEL).filter("u < v").groupBy("image", "u", "v").agg(F.min(pair).alias("at"))
    direct = stored(touching.select("image", _direct_id(skeleton, "u", "v").alias("edge"), "u", "v", "at"), "touching")

    place = lambda rows, pos, row, col: rows.select(*key, F.lit(pos).cast("int").alias("pos") if isinstance(pos, int) else pos.cast("int").alias("pos"), F.col(row).alias("row"), F.col(col).alias("col"))
    inner = sizes.filter("a is not null")
    parts = [
        walked.join(inner.select(*key), key, "left_semi").select(*key, (F.col("pos") + 1).alias("pos"), "row", "col"),
        place(inner, 0, "a.at.row", "a.at.col"), place(inner, F.col("pixels") + 1, "b.at.row", "b.at.col"),
        walked.join(rings.select(*key), key, "left_semi").select(*key, "pos", "row", "col"), place(rings, F.col("pixels"), "first.row", "first.col"),
        place(direct, 0, "at.x.nr", "at.x.nc"), place(direct, 1, "at.y.row", "at.y.col"),
    ]
    paths = parts[0]
    for part in parts[1:]:
        paths = paths.unionByName(part)
    paths = stored(paths, "paths")

    hop = Window.partitionBy(*key).orderBy("pos")
    step = F.sqrt(F.pow(F.col("row") - F.lag("row").over(hop), F.lit(2.0)) + F.pow(F.col("col") - F.lag("col").over(hop), F.lit(2.0)))
    lengths = paths.withColumn("step", step).groupBy(*key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.count("*").alias("pixels"))
    edges = along.unionByName(direct.drop("at")).join(lengths, key).withColumn("is_loop", F.col("u") == F.col("v"))

    centres = medoids(px, ["image", "node", "type"])
    counts = px.groupBy("image", "node").agg(F.count("*").alias("pixels"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))
    nodes = centres.join(counts, ["image", "node"]).select("image", "node", "type", "row", "col", "pixels", "top", "bottom", "left", "right").unionByName(ring_nodes)
    return nodes, edges, paths


#: Pairs of one component of candidates that are settled in one task; larger components are settled in rounds.
MOST_PAIRS = 1_000_000


def greedy_pairs(pairs: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """The pairs (image, a, b, distance) that taking them by (distance, a, b), each point once, would take.

    Points that no pair joins, not even by way of others, have nothing to do with each other: each component of candidates is
    sorted and gone through in one pass, as many components to a task as fall to it. Components of more than ``most`` pairs are
    settled over all tasks (see ``_in_rounds``). Equal rows are one pair; rows without an image or two points are none.
    """
    pairs = stored(pairs.filter("image is not null and a <> b").select("image", "a", "b", "distance").distinct(), "pairs")
    end = lambda c: F.struct("image", F.col(c).alias("point"))
    of = connected_components(pairs.select(end("a").alias("a"), end("b").alias("b")), "a", "b")
    at = stored(pairs.withColumn("id", end("a")).join(of, "id").drop("id"), "pairs-by-component")
    large = at.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("component")
    few = at.join(large, "component", "left_anti")

    def settle(frames):
        now, used = None, set()
        for frame in frames:
            keep = []
            for component, image, a, b in zip(frame["key"], frame["image"], frame["a"], frame["b"], strict=True):
                if component != now:
                    now, used = component, set()
                keep.append((image, a) not in used and (image, b) not in used)
                if keep[-1]:
                    used |= {(image, a), (image, b)}
            yield frame[keep][["image", "a", "b", "distance"]]

    # components are told apart by their text, which is unique for an image and a point
    dealt = few.withColumn("key", F.to_json("component")).repartition("key").sortWithinPartitions("key", "distance", "a", "b")
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in pairs.columns)
    done = dealt.select("key", *pairs.columns).mapInPandas(settle, kinds)
    return done if large.isEmpty() else done.unionByName(_in_rounds(at.join(large, "component", "left_semi").select(*pairs.columns)))


def greedy_within(points: DataFrame, radius: float) -> DataFrame:
    """What greedy_pairs takes of the pairs of different points (image, point, row, col) within ``radius``, each point given once.

    Points at one place come first, the least with the next, so they pair off in their order; all but the last of an odd number
    are used before any other distance is looked at. Only those are paired with their surroundings: the work grows with the
    points and the places, not with the square of the points at a place.
    """
    place = Window.partitionBy(*PIXEL).orderBy("point")
    at = points.select("image", "point", "row", "col").filter("image is not null and point is not null and row is not null and col is not null")
    at = at.withColumn("nth", F.row_number().over(place)).withColumn("next", F.lead("point").over(place)).filter("nth % 2 = 1")
    at = stored(at.select("image", "point", "row", "col", "next"), "places")
    together = at.filter("next is not null").select("image", F.col("point").alias("a"), F.col("next").alias("b"), F.lit(0.0).alias("distance"))
    return together.unionByName(greedy_pairs(pairs_within(at.filter("next is null"), radius)))


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """As greedy_pairs. Each round takes every pair that is the first of both its points; the order is total, so this is the same
    choice. Of the pairs left the first is always taken, so rounds end when none is left."""
    left, taken = stored(pairs, "pairs"), None
    while not left.isEmpty():
        ends = left.select("image", "a", "b", F.struct("distance", "a", "b").alias("k"))
        both = ends.select("image", F.col("a").alias("p"), "k").union(ends.select("image", F.col("b").alias("p"), "k"))
        first = both.groupBy("image", "p").agg(F.min("k").alias("k"))
        won = first.groupBy("image", "k").agg(F.count("*").alias("n")).filter("n = 2").select("image", "k.*")
        won = stored(won.select("image", "a", "b", "distance"), "won")
        taken = won if taken is None else taken.unionByName(won)
        used = won.select("image", F.explode(F.array("a", "b")).alias("p"))
        left = stored(left.join(used.withColumnRenamed("p", "a"), ["image", "a"], "left_anti").join(used.withColumnRenamed("p", "b"), ["image", "b"], "left_anti").select("image", "a", "b", "distance"), "pairs")
    return taken if taken is not None else left.limit(0)
