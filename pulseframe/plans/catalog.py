"""All queries of the engine's own operators."""

from . import alarm_queries, extra_queries, feature_queries, quality_queries, series_queries, signal_queries, sweep_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "alarm_queries", "extra_queries", "feature_queries", "quality_queries", "series_queries", "signal_queries", "sweep_queries"]
