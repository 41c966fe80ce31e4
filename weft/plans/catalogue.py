"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.plans import feature_queries, graph_queries, label_queries, mosaic_queries, path_queries, pixel_queries, prediction_queries, raster_queries, sweep_queries
from weft.session import sized

FLAGSHIP = "threshold_sweep_ods"
_PARTS = (sweep_queries, path_queries, graph_queries, raster_queries, pixel_queries, prediction_queries, label_queries, feature_queries, mosaic_queries)


def _planned(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session that knows what compressed files come to in memory."""
    return lambda spark, sf_dir: query(sized(spark), sf_dir)


QUERIES = {name: _planned(query) for part in _PARTS for name, (query, _) in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
