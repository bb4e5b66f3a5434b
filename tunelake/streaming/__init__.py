"""Structured Streaming forms of ingest, ratings, run metrics, parameters and status."""
