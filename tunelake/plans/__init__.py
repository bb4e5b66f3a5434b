"""Queries over the shared tables, each next to the SQL that states the same result."""

from tunelake.plans import catalog, conversations, curation, feedback, generation, runs, sequences, streams
from tunelake.plans.registry import QUERIES

__all__ = ["QUERIES", "catalog", "conversations", "curation", "feedback", "generation", "runs", "sequences",
           "streams"]
