"""Registered query plans over the driver tables, each with its oracle SQL."""

from .registry import QUERIES, ORACLE_SQL  # noqa: F401
from . import analytics_plans, catalog_plans, check_plans, keyed_plans, order_plans, search_plans, streaming_plans  # noqa: F401  (registration side effects)
