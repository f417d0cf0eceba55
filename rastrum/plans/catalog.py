"""Every registered query; importing the modules fills the registry."""

from . import fusion_queries, matching_queries, raster_queries, region_queries, registry_queries, results_queries, split_queries, store_queries  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "a07_aggregate_v2"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
