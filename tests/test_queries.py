"""Every query of the library against its SQL, and the shape of those without."""

from __future__ import annotations

import pytest

from tests.conftest import same
from weft.plans.catalogue import FLAGSHIP, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


#: Queries without SQL that ``test_query_rows`` holds against plain computations.
BY_HAND = {"mosaic_thinned", "mosaic_graph", "skeleton_graph", "thin_and_trace", "gap_pairs", "noise_reasons"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - BY_HAND))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert entry.entry(spark).count() == 1
