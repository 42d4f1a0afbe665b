"""Loads every module that registers queries."""

from stellwerk.plans import (  # noqa: F401
    analytics_queries,
    identity_queries,
    quality_queries,
    scoring_queries,
    source_queries,
    streaming_queries,
    text_queries,
)
from stellwerk.plans.registry import CHECKS, QUERIES  # noqa: F401
