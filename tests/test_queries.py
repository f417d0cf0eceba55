"""Every query with an oracle, on the smallest tables."""
import pytest

import __spark_entry__ as entry
from check import compare
from tests.conftest import SMALL

from rastrum.plans import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    msg, ok, _secs = compare(spark, oracle, name, QUERIES[name], ORACLES.get(name), SMALL)
    assert ok, msg


#: what SQL cannot say; tests/test_raster.py, tests/test_regions.py and tests/test_tiles.py hold these against hand-made rasters and brute force
NO_SQL = {"g12_merge_overlaps", "g13_merge_similar", "r12_detector_tile_scores", "r22_coherence", "r24_mask_stability", "r30_extract_feature_maps"}


def test_only_these_have_no_oracle():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
