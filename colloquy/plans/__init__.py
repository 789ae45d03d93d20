"""All registered queries."""

from colloquy.plans import document_queries, fact_queries, ingest_queries, meeting_queries, ops_queries, processor_queries, review_queries  # noqa: F401
from colloquy.plans.registry import QUERIES

__all__ = ["QUERIES"]
