"""Logical plans: the view catalogue and the registered queries."""

from fleetlens.plans import entity_queries, fleet_queries, path_queries, series_queries, stream_queries
from fleetlens.plans.registry import ORACLES, QUERIES

flagship = fleet_queries.detect_anomaly

__all__ = ["ORACLES", "QUERIES", "flagship"]
