"""One row of named features for each edge of a skeleton graph: blocks computed by key and joined on (image, edge).

Every block is by (image, edge) and written before the next is planned.
What is not available is NULL, and a companion column says so where 0 could be meant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import clipped, ratio
from weft.operators import gather, graph, paths, raster
from weft.operators.raster import PIXEL
from weft.session import stored

EDGE = ["image", "edge"]
KINDS = ["endpoint", "junction", "virtual_loop", "isolated"]


@dataclass(frozen=True)
class Settings:
    """Sizes are in pixels."""

    bins: int = 12
    stride: int = 5
    margin: int = 5
    window: int = 7
    hops: int = 2
    radius: float = 256.0
    least_face: int = 16
    closing: int = 1
    offset: float = 2.0
    patch: int = 7
    samples: int = 128


def at_border(top: Column, bottom: Column, left: Column, right: Column, height: int, width: int, margin: int) -> Column:
    """Whether pixels of these extents come within ``margin`` of the frame."""
    return (top < margin) | (left < margin) | (bottom >= height - margin) | (right >= width - margin)


def geometry_block(edges: DataFrame, px: DataFrame, s: Settings) -> DataFrame:
    g = paths.geometry(px, EDGE).withColumnsRenamed({"chord_px": "euclidean_px", "residual": "straightness_residual", "bbox_fill": "bbox_fill_ratio"})
    middle = px.groupBy(*EDGE).agg(F.avg("row").alias("row"), F.avg("col").alias("col"))
    k = paths.curvature(px, EDGE, s.stride)
    k = k.withColumn("total_turning_deg", F.degrees("turn_total")).withColumn("net_turning_deg", F.degrees("turn_net")).drop("turn_total", "turn_net")
    at = edges.select(*EDGE, F.col("is_loop").cast("double").alias("is_loop"))
    return at.join(middle, EDGE, "left").join(g, EDGE, "left").join(k, EDGE, "left")


def segment_sums(px: DataFrame, lag: int, bins: int) -> DataFrame:
    """Of each edge's segments, by length: weight, sums on the doubled angle, histogram, and the extremes of the angle.

    The sums of several edges add up, so any scope's orientation follows from its edges'.
    """
    w = Window.partitionBy(*EDGE).orderBy("pos")
    seg = px.withColumn("dr", F.lead("row", lag).over(w) - F.col("row")).withColumn("dc", F.lead("col", lag).over(w) - F.col("col"))
    seg = seg.withColumn("w", F.sqrt((F.col("dr") ** 2 + F.col("dc") ** 2).cast("double"))).filter("w > 0").withColumn("angle", F.pmod(F.atan2("dr", "dc"), F.lit(math.pi)))
    seg = seg.withColumn("bin", F.least(F.floor(F.col("angle") * bins / math.pi).cast("int"), F.lit(bins - 1)))
    hist = [F.sum(F.when(F.col("bin") == b, F.col("w")).otherwise(0.0)).alias(f"h_{b:02d}") for b in range(bins)]
    return seg.groupBy(*EDGE).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.cos(2 * F.col("angle"))).alias("c"), F.sum(F.col("w") * F.sin(2 * F.col("angle"))).alias("s"), *hist, F.min("angle").alias("low"), F.max("angle").alias("high"))


def orientation_columns(prefix: str, bins: int) -> list[Column]:
    """Dominant angle, anisotropy, variance, entropy and histogram from sums w, c, s and h_*; without segments NULL and zeros."""
    some = F.col("w") > 0
    r = clipped(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("w"), 0.0, 1.0)
    share = [F.when(some, F.col(f"h_{b:02d}") / F.col("w")).otherwise(0.0) for b in range(bins)]
    entropy = sum((F.when(x > 0, -x * F.ln(x)).otherwise(0.0) for x in share), F.lit(0.0)) / math.log(bins)
    named = {"dominant_deg": F.pmod(F.degrees(F.atan2("s", "c")) / 2, F.lit(180.0)), "anisotropy": r, "circular_variance": 1 - r, "entropy": entropy}
    return [*(F.when(some, x).alias(f"{prefix}_{n}") for n, x in named.items()), *(x.alias(f"{prefix}_hist_{b:02d}") for b, x in enumerate(share))]


def orientation_block(edges: DataFrame, sums: DataFrame, s: Settings) -> DataFrame:
    at = edges.select(*EDGE).join(sums, EDGE, "left")
    return at.select(*EDGE, *orientation_columns("orientation", s.bins), F.coalesce(F.degrees(F.col("high") - F.col("low")), F.lit(0.0)).alias("orientation_range_deg"))


def node_block(edges: DataFrame, nodes: DataFrame, px: DataFrame, height: int, width: int, s: Settings) -> DataFrame:
    """Degree, border, cluster size, kind and the angles between the branches of each node.

    Branches are undirected, 0 to 180 degrees; an edge that comes back leaves its node twice.
    """
    degree = graph.degrees(edges, nodes)
    n = F.count("*").over(Window.partitionBy(*EDGE))
    ends = px.withColumn("n", n).filter((F.col("n") >= 2) & ((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1) | (F.col("pos") == F.least(F.lit(s.window), F.col("n")) - 1) | (F.col("pos") == F.col("n") - F.least(F.lit(s.window), F.col("n")))))
    place = F.struct("row", "col")
    pick = lambda pos: F.max(F.when(F.col("pos") == pos, place))
    far = F.least(F.lit(s.window), F.col("n"))
    leaving = ends.groupBy(*EDGE).agg(pick(F.lit(0)).alias("a0"), pick(far - 1).alias("a1"), pick(F.col("n") - 1).alias("b0"), pick(F.col("n") - far).alias("b1"))
    turn = lambda x, y: F.when((x["row"] != y["row"]) | (x["col"] != y["col"]), F.pmod(F.degrees(F.atan2((y["row"] - x["row"]).cast("double"), (y["col"] - x["col"]).cast("double"))), F.lit(180.0)))
    sides = edges.select(*EDGE, "u", "v").join(leaving, EDGE)
    sides = sides.select(*EDGE, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("node"), turn(F.col("a0"), F.col("a1")).alias("angle")), F.struct(F.lit(1).alias("side"), F.col("v").alias("node"), turn(F.col("b0"), F.col("b1")).alias("angle")))).alias("x"))
    sides = sides.select(*EDGE, "x.*").filter("angle is not null")
    # lines without direction differ by 90 degrees at most, so orthogonality follows from the mean
    angles = graph.circular_spread(sides, ["image", "node"], "angle", 180)
    angles = angles.select("image", "node", *(F.col(f"angle_{x}").alias(f"branch_angle_{x}") for x in ("min", "max", "mean", "std")), (F.col("angle_mean") / 90).alias("branch_angle_orthogonality"))
    border = at_border(F.col("top"), F.col("bottom"), F.col("left"), F.col("right"), height, width, s.margin)
    at = nodes.join(degree, ["image", "node"]).join(angles, ["image", "node"], "left")
    return at.select("image", "node", "row", "col", "type", "degree", border.alias("border"), F.col("pixels").alias("cluster_size"), *(F.col(f"branch_angle_{x}") for x in ("min", "max", "mean", "std", "orthogonality")))


NODE_KEYS = ["degree", "is_border", "cluster_size", *(f"type_{k}" for k in KINDS), *(f"branch_angle_{x}" for x in ("min", "max", "mean", "std", "orthogonality"))]


def topology_block(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees, free ends and borders of the two ends, parallel edges, and all node features as least, greatest and mean."""
    n = nodes.withColumns({"is_border": F.col("border").cast("double"), **{f"type_{k}": (F.col("type") == k).cast("double") for k in KINDS}})
    ends = graph.endpoint_features(edges, n, NODE_KEYS)
    ends = ends.select(*EDGE, *(F.col(f"{k}_{x}").alias(f"node_{k}_{x}") for k in NODE_KEYS for x in ("min", "max", "mean")))
    t = graph.edge_topology(edges).select(*EDGE, "degree_min", "degree_max", "degree_sum", F.col("free_ends").alias("free_end_count"), F.col("parallel").alias("parallel_edge_count"))
    return t.join(ends, EDGE).withColumn("touches_border", F.col("node_is_border_max")).withColumn("both_ends_border", F.col("node_is_border_min"))


def structure_block(members: DataFrame, inside: DataFrame, nodes: DataFrame, edges: DataFrame, sums: DataFrame, scope: list[str], prefix: str, bins: int, components: Column | None = None) -> DataFrame:
    """Counts, ratios, degrees, lengths, box, density and orientation of each scope.

    members: scope, member (an edge) and its image; inside: scope, image and node. Degrees are those in the whole graph.
    """
    name = lambda x: f"{prefix}_{x}"
    of = edges.select("image", F.col("edge").alias("member"), F.col("length").cast("double").alias("length")).join(sums.withColumnRenamed("edge", "member").drop("low", "high"), ["image", "member"], "left")
    sides = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("w", "c", "s", *(f"h_{b:02d}" for b in range(bins)))]
    e = members.join(of, ["image", "member"]).groupBy(*scope).agg(
        F.count("*").cast("double").alias(name("edge_count")), F.sum("length").alias(name("length_total")), F.avg("length").alias(name("length_mean")),
        F.stddev_pop("length").alias(name("length_std")), F.max("length").alias(name("length_max")), *sides,
    )
    ends, free = F.col("type") == "endpoint", (F.col("type") == "endpoint") & ~F.col("border")
    n = inside.join(nodes.select("image", "node", "row", "col", "type", "degree", "border"), ["image", "node"]).groupBy(*scope).agg(
        F.count("*").cast("double").alias(name("node_count")), F.count_if(ends).cast("double").alias(name("endpoint_count")), F.count_if(free).cast("double").alias(name("free_endpoint_count")),
        F.count_if(F.col("type") == "junction").cast("double").alias(name("junction_count")),
        F.avg("degree").alias(name("degree_mean")), F.max("degree").cast("double").alias(name("degree_max")), F.stddev_pop("degree").alias(name("degree_std")),
        (F.max("row") - F.min("row") + 1).cast("double").alias(name("bbox_height")), (F.max("col") - F.min("col") + 1).cast("double").alias(name("bbox_width")),
    )
    at = n.join(e, scope, "left").na.fill(0.0, [name("edge_count"), name("length_total"), "w"])
    c = lambda x: F.col(name(x))
    at = at.withColumn(name("component_count"), (F.lit(1) if components is None else components).cast("double"))
    at = at.withColumn(name("cycle_rank"), c("edge_count") - c("node_count") + c("component_count"))
    more = {
        "cycle_rank_per_edge": F.try_divide(c("cycle_rank"), c("edge_count")), "endpoint_ratio": c("endpoint_count") / c("node_count"), "junction_ratio": c("junction_count") / c("node_count"),
        "length_cv": ratio(c("length_std"), c("length_mean"), 1e-9), "bbox_diagonal": F.sqrt(c("bbox_height") ** 2 + c("bbox_width") ** 2),
        "line_density": c("length_total") / F.greatest(c("bbox_height") * c("bbox_width"), F.lit(1.0)),
    }
    at = at.withColumns({name(k): x for k, x in more.items()})
    return at.select(*scope, *(F.col(x) for x in structure_names(prefix, bins) if "_orient_" not in x), *orientation_columns(f"{prefix}_orient", bins))


def component_block(edges: DataFrame, nodes: DataFrame, sums: DataFrame, s: Settings, strict: DataFrame | None = None, tolerant: DataFrame | None = None) -> DataFrame:
    """The structure of each edge's component, with the faces of its whole image, by component."""
    own = edges.filter("component is not null")
    members = own.select("image", "component", F.col("edge").alias("member"))
    inside = graph.ends(own).join(own.select(*EDGE, "component"), EDGE).select("image", "component", "node").distinct()
    at = structure_block(members, inside, nodes, edges, sums, ["image", "component"], "comp", s.bins)
    zero = F.lit(0.0)
    for faces, prefix in ((strict, "strict"), (tolerant, "tolerant")):
        if faces is None:
            at = at.withColumns({f"__{prefix}_n": F.lit(None).cast("double"), f"__{prefix}_mean": F.lit(None).cast("double")})
            continue
        each = faces.select("image", "face", "area").distinct().groupBy("image").agg(F.count("*").cast("double").alias(f"__{prefix}_n"), F.avg("area").alias(f"__{prefix}_mean"))
        at = at.join(each, "image", "left").na.fill(0.0, [f"__{prefix}_n", f"__{prefix}_mean"])
    at = at.withColumns({
        "comp_strict_face_count": F.col("__strict_n"), "comp_strict_face_area_mean": F.col("__strict_mean"), "comp_tolerant_face_count": F.col("__tolerant_n"),
        "comp_face_closure_gain": F.col("__tolerant_n") - F.coalesce("__strict_n", zero),
    })
    return at.drop("__strict_n", "__strict_mean", "__tolerant_n", "__tolerant_mean")


def local_block(edges: DataFrame, nodes: DataFrame, px: DataFrame, sums: DataFrame, s: Settings) -> DataFrame:
    """The structure around each edge: nodes a few steps from its ends and near its middle, and the edges among them."""
    u = nodes.select("image", F.col("node").alias("u"), F.col("row").alias("r"), F.col("col").alias("c"))
    middles = edges.select("image", "edge", "u").join(u, ["image", "u"]).join(paths.midpoint(px, EDGE), EDGE, "left")
    middles = middles.select(*EDGE, F.coalesce(F.col("row").cast("double"), "r").alias("row"), F.coalesce(F.col("col").cast("double"), "c").alias("col"))
    context = stored(graph.khop(edges, s.hops, middles, nodes, s.radius).select(*EDGE, "node"), "contexts")
    members = graph.induced(edges, context).withColumnRenamed("other", "member")
    at = structure_block(members, context, nodes, edges, sums, EDGE, "local", s.bins)
    at = at.join(edges.select(*EDGE, F.col("length").cast("double").alias("__own")), EDGE)
    return at.withColumn("local_length_share", ratio("__own", "local_length_total", 1e-9)).withColumn("local_length_ratio", ratio("__own", "local_length_mean", 1e-9)).drop("__own")


#: Columns of one bucket of a row, by which runs of pixels and what looks for them meet.
BUCKET = 64


def runs_of_faces(faces: DataFrame) -> DataFrame:
    """(image, row, start, end, face, area, bucket): the runs of a face's pixels along rows, once for each bucket they reach."""
    w = Window.partitionBy("image", "row", "face").orderBy("col")
    at = faces.select(*PIXEL, "face", "area").withColumn("run", F.col("col") - F.row_number().over(w))
    runs = at.groupBy("image", "row", "face", "area", "run").agg(F.min("col").alias("start"), F.max("col").alias("end")).drop("run")
    return runs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))))


def faces_near(px: DataFrame, runs: DataFrame, radius: Column) -> DataFrame:
    """(image, edge, face, area): of the faces within ``radius`` of each pixel of a path, in both directions, the last.

    A pixel asks the rows within its radius for runs that reach its columns; no face is spread out.
    """
    at = px.select(*PIXEL, "edge", radius.cast("int").alias("__r")).withColumnsRenamed({"row": "__row", "col": "__col"})
    at = at.select("*", (F.col("__col") - F.col("__r")).alias("lo"), (F.col("__col") + F.col("__r")).alias("hi"), F.explode(F.sequence(F.col("__row") - F.col("__r"), F.col("__row") + F.col("__r"))).alias("row"))
    at = at.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(F.col("hi") / BUCKET))))
    met = at.join(runs, ["image", "row", "bucket"]).filter((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")))
    last = met.groupBy(*EDGE, "__row", "__col").agg(F.max(F.struct("face", "area")).alias("x"))
    return last.select(*EDGE, "x.face", "x.area").distinct()


def face_block(edges: DataFrame, px: DataFrame, faces: DataFrame, radius: int, wider: DataFrame | None, prefix: str) -> DataFrame:
    """The faces that an edge's pixels touch: of those within ``radius`` of a pixel the last counts.

    Edges that touch none are looked up once more with the radius that ``wider`` (image, wider) has for their image, where
    that is more.
    """
    runs = stored(runs_of_faces(faces), "runs")
    found = faces_near(px, runs, F.lit(radius))
    if wider is not None:
        found = stored(found, "faces")
        rest = px.join(found.select(*EDGE).distinct(), EDGE, "left_anti").join(wider.filter(F.col("wider") > radius), "image")
        found = found.unionByName(faces_near(rest, runs, F.col("wider")))
    g = found.groupBy(*EDGE).agg(F.count("*").cast("double").alias(f"{prefix}_face_count"), F.avg("area").alias(f"{prefix}_face_area_mean"), F.max("area").cast("double").alias(f"{prefix}_face_area_max"), F.min("area").cast("double").alias(f"{prefix}_face_area_min"))
    at = edges.select(*EDGE).join(g, EDGE, "left").na.fill(0.0)
    return at.withColumn(f"{prefix}_borders_face", (F.col(f"{prefix}_face_count") > 0).cast("double"))


def appearance_block(edges: DataFrame, px: DataFrame, planes: DataFrame, distance: DataFrame | None, s: Settings) -> DataFrame:
    """Grey and saturation on an edge and at either side, and the deviation around it. planes: image, row, col, grey, saturation."""
    n = F.count("*").over(Window.partitionBy(*EDGE))
    at = paths.normals(px, EDGE).withColumn("n", n).withColumn("every", F.ceil(F.col("n") / s.samples)).filter(F.col("pos") % F.col("every") == 0)
    off = F.lit(1.0 + s.offset)
    if distance is not None:
        at = at.join(distance.select(*PIXEL, F.col("distance").alias("__d")), PIXEL, "left")
        off = F.coalesce("__d", F.lit(0.0)) + s.offset
    at = stored(at.withColumn("off", off).select(*EDGE, "row", "col", "normal_row", "normal_col", "off"), "samples")
    side = lambda k: (F.rint(F.col("row") + k * F.col("off") * F.col("normal_row")).cast("int"), F.rint(F.col("col") + k * F.col("off") * F.col("normal_col")).cast("int"))
    spots = F.array(*(F.struct(F.lit(k).alias("k"), r.cast("int").alias("row"), c.cast("int").alias("col")) for k, (r, c) in ((0, (F.col("row"), F.col("col"))), (1, side(1)), (-1, side(-1)))))
    seen = at.select(*EDGE, F.explode(spots).alias("x")).select(*EDGE, "x.*").join(planes.select(*PIXEL, F.col("grey").cast("double").alias("g"), F.col("saturation").cast("double").alias("t")), PIXEL)
    on, left, right, flank = (lambda c: F.when(F.col("k") == 0, F.col(c))), (lambda c: F.when(F.col("k") == 1, F.col(c))), (lambda c: F.when(F.col("k") == -1, F.col(c))), (lambda c: F.when(F.col("k") != 0, F.col(c)))
    g = seen.groupBy(*EDGE).agg(
        F.avg(on("g")).alias("line_gray_mean"), F.stddev_pop(on("g")).alias("line_gray_std"), F.avg(flank("g")).alias("side_gray_mean"), F.avg(left("g")).alias("__l"), F.avg(right("g")).alias("__r"),
        F.avg(on("t")).alias("line_saturation_mean"), F.avg(flank("t")).alias("side_saturation_mean"),
    ).filter("line_gray_mean is not null and side_gray_mean is not null")
    both = F.abs("__l") + F.abs("__r")
    g = g.withColumn("contrast", F.col("side_gray_mean") - F.col("line_gray_mean")).withColumn("contrast_normalized", F.col("contrast") / (F.col("side_gray_mean") + 1e-6))
    g = g.withColumn("side_asymmetry", F.when(both > 0, F.abs(F.col("__l") - F.col("__r")) / (both + 1e-6)))
    # the deviation in a box follows from running sums along its rows: two look-ups a row, however wide it is
    w = Window.partitionBy("image", "row").orderBy("col")
    ahead = planes.select(*PIXEL, F.sum(F.col("grey").cast("double")).over(w).alias("s1"), F.sum(F.col("grey").cast("double") ** 2).over(w).alias("s2"), F.row_number().over(w).alias("m"), F.max("col").over(Window.partitionBy("image", "row")).alias("end"), F.min("col").over(Window.partitionBy("image", "row")).alias("begin"))
    last = ahead.groupBy("image").agg(F.max("end").alias("end"), F.min("begin").alias("begin"))
    box = at.groupBy(*EDGE).agg(F.count("*").cast("double").alias("sample_count"), (F.min("row") - s.patch).alias("r0"), (F.max("row") + s.patch).alias("r1"), (F.min("col") - s.patch - 1).alias("c0"), (F.max("col") + s.patch).alias("c1"))
    rows = box.join(last, "image").select(*EDGE, F.explode(F.sequence("r0", "r1")).alias("row"), F.greatest("c0", F.col("begin") - 1).cast("int").alias("c0"), F.least("c1", "end").cast("int").alias("c1"))
    cut = rows.select(*EDGE, "row", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("c0").alias("col")), F.struct(F.lit(1).alias("sign"), F.col("c1").alias("col")))).alias("x")).select(*EDGE, "row", "x.*")
    part = cut.join(ahead.select(*PIXEL, "s1", "s2", "m"), PIXEL).groupBy(*EDGE).agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("s1", "s2", "m")))
    spread = part.select(*EDGE, F.sqrt(F.greatest(F.col("s2") / F.col("m") - (F.col("s1") / F.col("m")) ** 2, F.lit(0.0))).alias("patch_gray_std"))
    out = edges.select(*EDGE).join(g.join(box.select(*EDGE, "sample_count"), EDGE).join(spread, EDGE, "left"), EDGE, "left")
    return out.withColumn("appearance_available", F.col("line_gray_mean").isNotNull().cast("double")).drop("__l", "__r")


def structure_names(prefix: str, bins: int = 12) -> list[str]:
    counts = "node_count edge_count component_count cycle_rank cycle_rank_per_edge endpoint_count free_endpoint_count junction_count endpoint_ratio junction_ratio degree_mean degree_max degree_std".split()
    sizes = "length_total length_mean length_std length_max length_cv bbox_height bbox_width bbox_diagonal line_density".split()
    return [f"{prefix}_{x}" for x in (*counts, *sizes)] + orientation_names(f"{prefix}_orient", bins)


def orientation_names(prefix: str, bins: int = 12) -> list[str]:
    return [f"{prefix}_{x}" for x in ("dominant_deg", "anisotropy", "circular_variance", "entropy")] + [f"{prefix}_hist_{b:02d}" for b in range(bins)]


def names(bins: int = 12) -> list[str]:
    """All feature columns, in order."""
    series = lambda p: [f"{p}_{x}" for x in ("mean", "std", "min", "max", "p10", "p90", "cv")]
    return [
        *"length_px pixel_count euclidean_px tortuosity straightness straightness_residual bbox_height bbox_width bbox_diagonal bbox_fill_ratio is_loop".split(),
        *"curvature_mean curvature_max curvature_std total_turning_deg net_turning_deg".split(),
        *orientation_names("orientation", bins), "orientation_range_deg",
        *series("width"), "width_length_ratio", *series("prob"), "prob_available",
        *"degree_min degree_max degree_sum free_end_count touches_border both_ends_border parallel_edge_count".split(),
        *(f"node_{k}_{x}" for k in NODE_KEYS for x in ("min", "max", "mean")),
        *structure_names("local", bins), "local_length_share", "local_length_ratio",
        *structure_names("comp", bins), "comp_strict_face_count", "comp_strict_face_area_mean", "comp_tolerant_face_count", "comp_face_closure_gain",
        *(f"{p}_{x}" for p in ("strict", "tolerant") for x in ("face_count", "face_area_mean", "face_area_max", "face_area_min", "borders_face")),
        *"line_gray_mean line_gray_std side_gray_mean contrast contrast_normalized side_asymmetry line_saturation_mean side_saturation_mean patch_gray_std sample_count appearance_available".split(),
    ]


def table(nodes: DataFrame, edges: DataFrame, px: DataFrame, height: int, width: int, mask: DataFrame | None = None, distance: DataFrame | None = None, prob: DataFrame | None = None, planes: DataFrame | None = None, groups: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """image, group, component, edge, u, v, row, col and every feature of ``names``, one row an edge.

    nodes, edges and px (paths) are those of ``skeleton_graph.build``; mask: image, row, col; distance: to the background;
    prob: image, row, col, p; planes: image, row, col, grey, saturation; groups: image, group (else the image itself).
    """
    s = settings
    nodes, px = stored(nodes, "nodes"), stored(px, "paths")
    distance = None if distance is None else stored(distance, "distance")
    of = graph.components(edges)
    edges = stored(edges.join(of.select(F.col("node").alias("u"), "component"), "u", "left").select("image", "edge", "u", "v", "component", "length", "is_loop"), "edges")
    sums = stored(segment_sums(px, s.stride, s.bins), "segments")
    info = stored(node_block(edges, nodes, px, height, width, s), "node-features")
    blocks = [geometry_block(edges, px, s), orientation_block(edges, sums, s), topology_block(edges, info), local_block(edges, info, px, sums, s)]
    if distance is not None:
        wide = px.join(distance.select(*PIXEL, (2 * F.col("distance")).alias("__w")), PIXEL)
        blocks.append(paths.series(wide, EDGE, "__w", "width"))
    if prob is not None:
        blocks.append(gather.sampled(px, prob, EDGE, "p", "prob"))
    if planes is not None:
        blocks.append(appearance_block(edges, px, planes, distance, s))
    strict = tolerant = None
    if mask is not None:
        images = mask.select("image").distinct()
        strict = stored(raster.face_pixels(mask, images, height, width, s.least_face), "faces")
        tolerant = stored(raster.face_pixels(raster.close(mask, raster.disk(s.closing), height, width), images, height, width, s.least_face), "faces")
        # each image by its own widest line
        wider = distance.groupBy("image").agg((F.ceil(F.max("distance") / 2) + 1).alias("wider")) if distance is not None else None
        for faces, prefix in ((strict, "strict"), (tolerant, "tolerant")):
            blocks.append(face_block(edges, px, faces, max(1, s.closing + 1), wider, prefix))
    at = edges.select("image", "edge", "u", "v", "component")
    # each block is a job of its own: one plan of all of them is more than a driver should hold
    for block in blocks:
        at = at.join(stored(block, "block"), EDGE, "left")
    at = at.join(stored(component_block(edges, info, sums, s, strict, tolerant), "block"), ["image", "component"], "left")
    if distance is not None:
        at = at.withColumn("width_length_ratio", ratio("width_mean", "length_px", 1e-9))
    flags = {"prob_available": 0.0, "appearance_available": 0.0, "sample_count": 0.0}
    have = set(at.columns)
    at = at.withColumns({n: F.lit(flags.get(n, 0.0 if n.startswith(("strict_", "tolerant_")) else None)).cast("double") for n in names(s.bins) if n not in have})
    at = at.join(groups.select("image", "group"), "image", "left").withColumn("group", F.coalesce("group", F.col("image").cast("string"))) if groups is not None else at.withColumn("group", F.col("image").cast("string"))
    return at.select("image", "group", "component", "edge", "u", "v", "row", "col", *(F.col(n).cast("double").alias(n) for n in names(s.bins)))
