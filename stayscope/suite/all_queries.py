"""Imports every query module so that the registry is complete."""

from stayscope.suite import discovery_queries, feature_queries, first_silver_queries, io_queries, layer_queries, model_queries, policy_queries, report_queries, sofa_queries, stats_queries, stream_queries, validation_queries, windowed_queries  # noqa: F401
from stayscope.suite.registry import ORACLE, QUERIES  # noqa: F401
