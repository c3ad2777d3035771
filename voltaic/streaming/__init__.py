"""Structured Streaming versions of the ingest path."""
