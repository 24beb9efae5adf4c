"""Registered queries of the library and their SQL."""

from . import area_plans, check_plans, flow_plans, graph_plans, match_plans, pipeline_plans, product_plans, record_plans, review_plans, route_plans, stream_plans, table_plans, temporal_plans, text_plans, tree_plans, vector_plans  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
