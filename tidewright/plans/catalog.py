"""Imports every query module so that the registry is complete."""

from tidewright.plans import (  # noqa: F401
    interval_queries,
    job_queries,
    matrix_queries,
    question_queries,
    relational_queries,
    routine_queries,
    scoring_queries,
    series_queries,
    similarity_queries,
    streaming_queries,
    synthesis_queries,
    text_queries,
    tool_queries,
)
from tidewright.plans.registry import ORACLES, QUERIES  # noqa: F401
