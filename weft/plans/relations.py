"""The library's relations read off the test tables, in Spark and in SQL.

The tables hold no images. Embeddings stand for rasters (a vector of 64 is 8 by 8), line items for scored pixels and for
the edges of multigraphs, a user's events in order for a path, labels with documents for predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.session import table

SIDE = 8


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "e"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.col("e").cast("double")))
    return e.select("image", F.floor(F.col("i") / SIDE).cast("int").alias("row"), (F.col("i") % SIDE).cast("int").alias("col"), p.alias("p"))


#: Vectors side by side in the mosaic.
ACROSS = 64


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rasters as one, ``ACROSS`` to a row: one image that is larger than a tile."""
    at = prob(spark, sf_dir)
    return at.select(F.lit(0).cast("long").alias("image"), (F.floor(F.col("image") / ACROSS) * SIDE + F.col("row")).cast("int").alias("row"), (F.col("image") % ACROSS * SIDE + F.col("col")).cast("int").alias("col"), "p")


def mosaic_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    most = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    return (most // ACROSS + 1) * SIDE, ACROSS * SIDE


def mask(spark: SparkSession, sf_dir: str, least: float = 0.55) -> DataFrame:
    return prob(spark, sf_dir).filter(F.col("p") >= least).select("image", "row", "col")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("image"), (F.round(F.col("l_discount") * 100).cast("int") * 25).alias("score"), (F.col("l_returnflag") == "R").alias("truth"))


#: A node is its image times this, and twice the number of a part, or of a supplier plus one.
NODES = 1 << 40


def edge_key(order: Column, line: Column, nth: Column) -> Column:
    """A number for each line item: 52 bits of its order, 3 of its line, 8 for rows that have both alike; an error outside of them."""
    key = F.shiftleft(order.cast("long"), 11).bitwiseOR(F.shiftleft(line.cast("long"), 8)).bitwiseOR(nth.cast("long"))
    held = order.between(0, (1 << 52) - 1) & line.between(0, 7) & nth.between(0, 255)
    return F.when(held, key).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no edge key for"), order.cast("string"), line.cast("string"), nth.cast("string"))).cast("long"))


def node_number(node: Column) -> Column:
    """The number of a node's part or supplier."""
    return F.floor(node % NODES / 2)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    base = F.col("l_linenumber").cast("long") * NODES
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")) - 1
    return li.withColumn("nth", nth).select(
        F.col("l_linenumber").cast("long").alias("image"), edge_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("nth")).alias("edge"), (base + 2 * F.col("l_partkey")).alias("u"),
        (base + 2 * F.col("l_suppkey") + 1).alias("v"), F.col("l_extendedprice").alias("length"), F.col("l_linestatus").alias("raw_label"), F.col("l_discount").alias("discount"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every end of an edge lies, and an edge's middle: that of its end u."""
    e = edges(spark, sf_dir).select("image", F.explode(F.array("u", "v")).alias("node")).distinct()
    key = node_number(F.col("node"))
    return e.select("image", "node", (key % 97).alias("row"), (F.floor(key / 97) % 89).alias("col"))


def with_middles(e: DataFrame) -> DataFrame:
    """Edges with their middles."""
    key = node_number(F.col("u"))
    return e.withColumns({"row": key % 97, "col": F.floor(key / 97) % 89})


def middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_middles(edges(spark, sf_dir)).select("image", "edge", "row", "col")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of edges, but for suppliers divisible by 10, as points with two features."""
    e = edges(spark, sf_dir).select("image", F.explode(F.array("u", "v")).alias("node")).distinct()
    n = e.withColumn("key", node_number(F.col("node"))).withColumn("row", F.col("key") % 97).withColumn("col", F.floor(F.col("key") / 97) % 89)
    return n.filter("not (node % 2 = 1 and key % 10 = 0)").select("image", "node", "row", "col", (F.col("key") % 7).alias("f"), F.when(F.col("key") % 5 > 0, F.col("key") % 11).alias("g"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return ev.select(F.col("user_id").alias("edge"), pos.alias("pos"), F.col("value").alias("row"), F.get_json_object("props", "$.k").cast("int").alias("col"), "event_type")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("edge"), F.length("event_type").alias("value"), "event_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    at = table(spark, sf_dir, "labels").join(d, "doc_id")
    return at.select("doc_id", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("yhat"), F.col("n_chars").alias("length"), (F.col("n_chars") < 200).alias("abstained"), "source", "lang", (F.col("doc_id") % 5).cast("int").alias("fold"))


#: The same relations as SQL common table expressions.
SQL = {
    "prob": f"prob AS (SELECT vec_id AS image, ((i - 1) // {SIDE})::INT AS row, ((i - 1) % {SIDE})::INT AS col, greatest(0.0, least(1.0, 0.5 + e::DOUBLE)) AS p FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))",
    "mask": "mask AS (SELECT image, row, col FROM prob WHERE p >= 0.55::DOUBLE)",
    "mosaic": f"mosaic AS (SELECT 0::BIGINT AS image, (image // {ACROSS} * {SIDE} + row)::INT AS row, (image % {ACROSS} * {SIDE} + col)::INT AS col, p FROM prob)",
    "scores": "scores AS (SELECT l_suppkey AS image, CAST(round(l_discount * 100) AS INT) * 25 AS score, l_returnflag = 'R' AS truth FROM lineitem)",
    "edges": f"edges AS (SELECT l_linenumber::BIGINT AS image, l_orderkey::BIGINT * 2048 + l_linenumber::BIGINT * 256 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 AS edge, l_linenumber::BIGINT * {NODES} + 2 * l_partkey AS u, l_linenumber::BIGINT * {NODES} + 2 * l_suppkey + 1 AS v, l_extendedprice AS length, l_linestatus AS raw_label, l_discount AS discount FROM lineitem)",
    "ends": "ends AS (SELECT image, edge, u AS node FROM edges UNION ALL SELECT image, edge, v FROM edges)",
    "nodes": f"nodes AS (SELECT image, node, key % 97 AS row, (key // 97) % 89 AS col, key % 7 AS f, CASE WHEN key % 5 > 0 THEN key % 11 END AS g FROM (SELECT DISTINCT image, node, node % {NODES} // 2 AS key FROM ends) WHERE NOT (node % 2 = 1 AND key % 10 = 0))",
    "places": f"places AS (SELECT DISTINCT image, node, node % {NODES} // 2 % 97 AS row, (node % {NODES} // 2 // 97) % 89 AS col FROM ends)",
    "middles": f"middles AS (SELECT image, edge, u % {NODES} // 2 % 97 AS row, (u % {NODES} // 2 // 97) % 89 AS col FROM edges)",
    "paths": "paths AS (SELECT user_id AS edge, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS row, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT) AS col, event_type FROM events)",
    "predictions": "predictions AS (SELECT doc_id, quality AS y, 1 - toxic AS yhat, n_chars AS length, n_chars < 200 AS abstained, source, lang, (doc_id % 5)::INT AS fold FROM labels JOIN documents USING (doc_id))",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
