"""Structured Streaming ingest jobs (STR1-STR3)."""
